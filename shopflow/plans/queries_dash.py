"""Queries behind the dashboard, retention and report tables.

Filter and search parameters are fixed per query (they are arguments of
the operators); the data read is always the whole event log.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shopflow.operators import behavior, explore, funnel, retention, revenue, segments, temporal
from shopflow.plans.catalog import register
from shopflow.plans.queries_core import BREADTH, FUNNEL, LOYALTY, MONTHLY, NZQ4, REVENUE, WEEKEND
from shopflow.plans.sqlfrag import r6

# Fixed query parameters.
DATE_RANGE = (dt.date(1997, 1, 1), dt.date(1998, 12, 31))
BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8"]
BRAND_TERM = "#1"
CATEGORY_TERM = "g"
SEARCH_PATTERN = "brand#2[0-5]|WIDGET"
SEARCH_TYPE = "purchase"
SESSION_RANGE = (dt.date(1996, 1, 1), dt.date(1996, 3, 31))

_brand_sql = ", ".join(f"'{b}'" for b in BRANDS)
FILTERED = f"""
, fe AS (SELECT * FROM ev WHERE CAST(event_time AS DATE) >= DATE '{DATE_RANGE[0]}'
                          AND CAST(event_time AS DATE) <= DATE '{DATE_RANGE[1]}' AND brand IN ({_brand_sql}))"""


def _filtered(c):
    return explore.apply_filters(c.events, DATE_RANGE, BRANDS, None)


def _flags_sql(src: str, *keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT {k}user_session,
         max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS hv,
         max(CASE WHEN event_type = 'cart' THEN 1 ELSE 0 END) AS hc,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS hp,
         sum(CASE WHEN event_type = 'purchase' THEN purchase_spending END) AS ps,
         count(CASE WHEN event_type = 'purchase' THEN purchase_spending END) AS pc
  FROM {src} GROUP BY {k}user_session"""


# -- D1-D6 ---------------------------------------------------------------------
register("date_bounds", """
SELECT min(CAST(event_time AS DATE)) AS min_date, max(CAST(event_time AS DATE)) AS max_date FROM ev""")(
    lambda c: explore.date_bounds(c.events))

register("brand_list", "SELECT DISTINCT brand FROM ev WHERE brand IS NOT NULL")(
    lambda c: explore.brand_list(c.events))

register("category_list", "SELECT DISTINCT category_code FROM ev WHERE category_code IS NOT NULL")(
    lambda c: explore.category_list(c.events))

LEAF = """
, leaf AS (SELECT split_part(category_code, '.', -1) AS category_display, max(category_code) AS category_code
           FROM (SELECT DISTINCT category_code FROM ev WHERE category_code IS NOT NULL) GROUP BY 1)"""
register("category_leaf_map", LEAF + "\nSELECT category_display, category_code FROM leaf")(
    lambda c: explore.category_leaf_map(c.events))

register("brand_search", f"""
, m AS (SELECT DISTINCT brand FROM ev WHERE brand IS NOT NULL AND contains(lower(brand), lower('{BRAND_TERM}')))
SELECT CAST(row_number() OVER (ORDER BY brand) AS INTEGER) AS match_rank, brand,
       (SELECT count(*) FROM m) AS total_matches
FROM m ORDER BY brand LIMIT 5""")(lambda c: explore.brand_search(c.events, BRAND_TERM, 5))

register("category_search", LEAF + f"""
, m AS (SELECT * FROM leaf WHERE contains(lower(category_display), lower('{CATEGORY_TERM}')))
SELECT CAST(row_number() OVER (ORDER BY category_display) AS INTEGER) AS match_rank, category_display,
       category_code, (SELECT count(*) FROM m) AS total_matches
FROM m ORDER BY category_display LIMIT 10""")(lambda c: explore.category_search(c.events, CATEGORY_TERM, 10))

register("filtered_events", FILTERED + f"""
SELECT user_id, user_session, event_type, product_id, brand, category_code, {r6('price', 'price')}, event_time,
       hour, weekday, month, event_period, {r6('purchase_spending', 'purchase_spending')} FROM fe""")(
    lambda c: _filtered(c))

# -- D7-D9 ---------------------------------------------------------------------
register("filtered_kpis", FILTERED + f"""
, fs AS ({_flags_sql('fe')})
SELECT count(*) AS total_sessions, CAST(sum(hv) AS BIGINT) AS sessions_with_views,
       CAST(sum(hc) AS BIGINT) AS sessions_with_carts, CAST(sum(hp) AS BIGINT) AS sessions_with_purchases,
       {r6('coalesce(sum(ps), 0)', 'total_revenue')},
       {r6('coalesce(CAST(sum(hc) AS DOUBLE) / nullif(sum(hv), 0), 0.0) * 100', 'view_to_cart_rate')},
       {r6('coalesce(CAST(sum(hp) AS DOUBLE) / nullif(sum(hv), 0), 0.0) * 100', 'view_to_purchase_rate')},
       {r6('sum(ps) / nullif(sum(pc), 0)', 'avg_order_value')}
FROM fs""")(lambda c: explore.filtered_kpis(_filtered(c)))

register("filtered_kpis_empty", """
SELECT count(*) AS total_sessions, CAST(0 AS BIGINT) AS sessions_with_views, CAST(0 AS BIGINT) AS sessions_with_carts,
       CAST(0 AS BIGINT) AS sessions_with_purchases, 0.0 AS total_revenue, 0.0 AS view_to_cart_rate,
       0.0 AS view_to_purchase_rate, 0.0 AS avg_order_value
FROM sessions WHERE false""")(
    lambda c: explore.filtered_kpis(explore.apply_filters(c.events, brands=["no such brand"])))

PERIODS_SQL = FILTERED + f"""
, fp AS (SELECT *, CASE WHEN hour(event_time) < 6 THEN 'Night' WHEN hour(event_time) < 12 THEN 'Morning'
                        WHEN hour(event_time) < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_period
         FROM fe WHERE event_time IS NOT NULL)
, fps AS ({_flags_sql('fp', 'time_period')})
, per AS (SELECT time_period, coalesce(CAST(sum(hp) AS DOUBLE) / nullif(sum(hv), 0), 0.0) AS view_to_purchase_rate,
                 count(*) AS user_session FROM fps GROUP BY time_period)"""
register("filtered_periods", PERIODS_SQL + f"""
SELECT time_period, {r6('view_to_purchase_rate', 'view_to_purchase_rate')}, user_session FROM per""")(
    lambda c: explore.filtered_periods(_filtered(c)))

register("best_period", PERIODS_SQL + f"""
SELECT time_period, {r6('view_to_purchase_rate * 100', 'conversion_pct')} FROM per
ORDER BY view_to_purchase_rate DESC,
         list_position(['Night', 'Morning', 'Afternoon', 'Evening'], time_period) LIMIT 1""")(
    lambda c: explore.best_period(explore.filtered_periods(_filtered(c))))

# -- D10-D20 ---------------------------------------------------------------------
register("loyalty_premium", LOYALTY + f"""
SELECT {r6('coalesce((SELECT max(CASE WHEN casual_user_avg_spend > 0 THEN (loyal_user_avg_spend / casual_user_avg_spend - 1) * 100 END) FROM loy), 0.0)', 'loyalty_premium_pct')},
       CAST(coalesce((SELECT max(loyal_user_count) FROM loy), 0) AS BIGINT) AS loyal_user_count""")(
    lambda c: explore.loyalty_premium(segments.loyalty(c.users)))

register("weekend_gap", WEEKEND + f"""
SELECT {r6('weekend_conversion_rate * 100', 'weekend_conversion_pct')},
       {r6('weekday_conversion_rate * 100', 'weekday_conversion_pct')},
       CASE WHEN weekday_conversion_rate * 100 > weekend_conversion_rate * 100 THEN 'Weekdays' ELSE 'Weekends' END AS leader,
       {r6('abs(weekday_conversion_rate * 100 - weekend_conversion_rate * 100)', 'gap_pp')} FROM wk""")(
    lambda c: explore.weekend_gap(temporal.weekend_conversion(c.sessions)))

OVD = """
, ovd AS (SELECT CASE WHEN session_total_spending <= 25 THEN 'Small' WHEN session_total_spending <= 100 THEN 'Medium'
                      WHEN session_total_spending <= 500 THEN 'Large' ELSE 'Premium' END AS order_value_category
          FROM sessions WHERE session_total_spending > 0)"""
register("premium_order_share", OVD + f"""
SELECT CAST(count_if(order_value_category = 'Premium') AS BIGINT) AS premium_orders,
       CAST(count(*) AS BIGINT) AS total_orders,
       {r6("CASE WHEN count(*) > 0 THEN CAST(count_if(order_value_category = 'Premium') AS DOUBLE) / count(*) * 100 END", 'premium_pct')}
FROM ovd""")(lambda c: explore.premium_order_share(revenue.order_value_distribution(c.sessions)))

register("nonzero_segments", NZQ4 + f"""
SELECT spending_segment, count(user_id) AS user_count,
       {r6('round_even(avg(user_total_spending), 2)', 'avg_total_spending_per_user')},
       {r6('round_even(avg(user_total_sessions), 2)', 'avg_total_sessions_per_user')},
       {r6('round_even(avg(user_view_to_purchase_rate), 2)', 'avg_conversion_rate')},
       {r6('round_even(avg(user_purchase_per_session), 2)', 'avg_purchases_per_session')}
FROM useg WHERE spending_segment <> 'Zero Spender' GROUP BY spending_segment""")(
    lambda c: explore.nonzero_segments(segments.segment_stats(segments.spending_segments(c.users, index=c.spend_index))))

register("recovery_scenarios", REVENUE + f"""
SELECT CAST(x.r AS DOUBLE) AS recovery_rate, {r6('cart_abandonment_sessions * avg_order_value * x.r', 'recovered_revenue')}
FROM rev, (VALUES (0.25), (0.5)) x(r)""")(
    lambda c: explore.recovery_scenarios(revenue.cart_abandonment(c.sessions)))

register("upgrade_potential", LOYALTY + f"""
SELECT CAST(casual_user_count AS BIGINT) AS casual_user_count,
       {r6('casual_user_count * (loyal_user_avg_spend - casual_user_avg_spend)', 'upgrade_potential')},
       {r6('CASE WHEN casual_user_avg_spend > 0 THEN loyal_user_avg_spend / casual_user_avg_spend END', 'spend_multiplier')}
FROM loy""")(lambda c: explore.upgrade_potential(segments.loyalty(c.users)))

register("brand_breadth_gap", BREADTH + f"""
SELECT {r6('multi_brand_conversion * 100', 'multi_brand_conv_pct')},
       {r6('single_brand_conversion * 100', 'single_brand_conv_pct')},
       {r6('CASE WHEN multi_brand_conversion * 100 > single_brand_conversion * 100 THEN multi_brand_conversion * 100 - single_brand_conversion * 100 END', 'gap_pp')}
FROM breadth""")(lambda c: explore.brand_breadth_gap(behavior.brand_breadth(c.sessions)))

register("peak_quarter", MONTHLY + f"""
SELECT quarter AS peak_quarter, {r6('session_total_spending', 'peak_revenue')}
FROM quarterly ORDER BY session_total_spending DESC, quarter LIMIT 1""")(
    lambda c: explore.peak_quarter(temporal.quarterly(cells=c.start_cells)))

register("behavior_table", BREADTH + f"""
SELECT 'Multi-Brand' AS shopping_behavior, {r6('multi_brand_conversion * 100', 'conversion_rate')},
       {r6('multi_brand_aov', 'aov')} FROM breadth
UNION ALL SELECT 'Single-Brand', round(single_brand_conversion * 100, 6), round(single_brand_aov, 6) FROM breadth
UNION ALL SELECT 'Multi-Category', round(multi_category_conversion * 100, 6), 0.0 FROM breadth""")(
    lambda c: explore.behavior_table(behavior.brand_breadth(c.sessions), behavior.multi_category(c.sessions)))

register("avg_brands_per_session", BREADTH + f"""
SELECT {r6('avg_brands_per_session', 'avg_brands_per_session')} FROM breadth""")(
    lambda c: explore.avg_brands_per_session(c.sessions))

register("session_date_filter", f"""
SELECT user_session, user_id, category_code, brand, view_count, cart_count, purchase_count,
       n_unique_brands, n_unique_categories, session_started_at, session_ended_at,
       {r6('session_total_spending', 'session_total_spending')}, cart_unique, purchase_unique, view_unique,
       {r6('session_duration', 'session_duration')}, {r6('view_to_purchase_rate', 'view_to_purchase_rate')},
       is_weekend
FROM sessions WHERE CAST(session_started_at AS DATE) >= DATE '{SESSION_RANGE[0]}'
  AND CAST(session_started_at AS DATE) <= DATE '{SESSION_RANGE[1]}'
ORDER BY user_session LIMIT 100""")(
    lambda c: explore.session_date_filter(c.sessions, *SESSION_RANGE, preview=100))

USER_COLS = f"""user_id, user_total_sessions, total_view_count, total_cart_count, total_purchase_count,
       total_unique_purchase_count, total_unique_view_count,
       {r6('user_avg_session_duration', 'user_avg_session_duration')},
       {r6('user_total_spending', 'user_total_spending')},
       {r6('user_view_to_purchase_rate', 'user_view_to_purchase_rate')},
       {r6('user_purchase_per_session', 'user_purchase_per_session')}"""
register("top_users", f"""
SELECT {USER_COLS} FROM users ORDER BY user_total_spending DESC, user_id LIMIT 20""")(
    lambda c: explore.top_users(c.users, 20))

register("key_metrics", FUNNEL + REVENUE + """
SELECT * FROM (
  SELECT 1 AS position, 'Total Sessions' AS Metric, format('{:,}', total_sessions) AS Value FROM fr
  UNION ALL SELECT 2, 'Sessions with Views', format('{:,}', v) FROM fr
  UNION ALL SELECT 3, 'Sessions with Carts', format('{:,}', ca) FROM fr
  UNION ALL SELECT 4, 'Sessions with Purchases', format('{:,}', p) FROM fr
  UNION ALL SELECT 5, 'Total Revenue', '$' || format('{:,.2f}', CAST(total_revenue AS DOUBLE)) FROM rev
  UNION ALL SELECT 6, 'Revenue Generating Sessions', format('{:,}', revenue_generating_sessions) FROM rev)""")(
    lambda c: explore.key_metrics(funnel.funnel_counts(c.sessions), revenue.revenue_totals(c.sessions)))

register("event_types", "SELECT DISTINCT event_type FROM ev")(lambda c: explore.event_types(c.events))
register("event_types_events", "SELECT DISTINCT event_type FROM ev", source="events")(
    lambda c: explore.event_types(c.events))

SEARCH = FILTERED + f"""
, hits AS (SELECT * FROM fe WHERE (coalesce(regexp_matches(brand, '{SEARCH_PATTERN}', 'i'), false)
                               OR coalesce(regexp_matches(category_code, '{SEARCH_PATTERN}', 'i'), false)
                               OR coalesce(regexp_matches(CAST(product_id AS VARCHAR), '{SEARCH_PATTERN}', 'i'), false))
                              AND event_type = '{SEARCH_TYPE}')"""
register("text_search", SEARCH + """
SELECT count(*) AS records_found FROM hits""")(
    lambda c: explore.text_search(_filtered(c), SEARCH_PATTERN, SEARCH_TYPE, c.search_values).agg(
        F.count(F.lit(1)).alias("records_found")))

register("top_products", SEARCH + f"""
SELECT product_id, brand, split_part(category_code, '.', -1) AS category_display,
       {r6('coalesce(sum(purchase_spending), 0)', 'purchase_spending')}, count(event_type) AS event_count
FROM hits WHERE product_id IS NOT NULL AND brand IS NOT NULL AND category_code IS NOT NULL
GROUP BY product_id, brand, category_code
ORDER BY coalesce(sum(purchase_spending), 0) DESC, product_id, brand, category_code LIMIT 10""")(
    lambda c: explore.top_products(explore.text_search(_filtered(c), SEARCH_PATTERN, SEARCH_TYPE, c.search_values), 10))

register("search_sample", SEARCH + f"""
SELECT user_id, user_session, event_type, product_id, brand, category_code, {r6('price', 'price')}, event_time,
       hour, weekday, month, event_period, {r6('purchase_spending', 'purchase_spending')}
FROM hits ORDER BY event_time NULLS LAST, user_session, product_id NULLS FIRST, event_type NULLS FIRST,
         price NULLS FIRST, user_id NULLS FIRST, brand NULLS FIRST, category_code NULLS FIRST LIMIT 50""")(
    lambda c: explore.search_sample(explore.text_search(_filtered(c), SEARCH_PATTERN, SEARCH_TYPE, c.search_values), 50))

# -- R1-R7 ---------------------------------------------------------------------
LTV = """
, ltvq AS (SELECT quantile_cont(CAST(user_total_spending AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM users)
, ltv AS (SELECT u.*, CASE WHEN CAST(user_total_spending AS DOUBLE) <= q[2] THEN 'Bronze'
                          WHEN CAST(user_total_spending AS DOUBLE) <= q[3] THEN 'Silver'
                          WHEN CAST(user_total_spending AS DOUBLE) <= q[4] THEN 'Gold'
                          WHEN CAST(user_total_spending AS DOUBLE) <= q[5] THEN 'Platinum'
                          ELSE 'Diamond' END AS ltv_segment FROM users u, ltvq)"""
register("ltv_segments", LTV + f"""
SELECT user_id, {r6('user_total_spending', 'user_total_spending')}, ltv_segment FROM ltv""")(
    lambda c: retention.ltv_segments(c.users, c.spend_index).select("user_id", "user_total_spending", "ltv_segment"))

register("ltv_stats", LTV + f"""
SELECT ltv_segment, count(user_id) AS user_count, {r6('avg(user_total_spending)', 'avg_user_total_spending')},
       {r6('avg(user_total_sessions)', 'avg_user_total_sessions')} FROM ltv GROUP BY ltv_segment""")(
    lambda c: retention.ltv_stats(retention.ltv_segments(c.users, c.spend_index)))

register("high_value_users", f"""
, q AS (SELECT quantile_cont(CAST(user_total_spending AS DOUBLE), 0.8) AS t FROM users)
SELECT {r6('t', 'spend_threshold')}, count_if(CAST(user_total_spending AS DOUBLE) > t)::BIGINT AS high_value_users
FROM users, q GROUP BY t""")(lambda c: retention.high_value_users(c.users, index=c.spend_index))

register("session_frequency", """
SELECT user_total_sessions, count(*) AS user_count FROM users GROUP BY 1
ORDER BY user_count DESC, user_total_sessions LIMIT 10""")(lambda c: retention.session_frequency(c.users))

register("repeat_rate", f"""
SELECT CAST(count_if(user_total_sessions > 1) AS BIGINT) AS repeat_customers, count(*) AS total_customers,
       {r6('coalesce(CAST(count_if(user_total_sessions > 1) AS DOUBLE) / nullif(count(*), 0), 0.0) * 100', 'retention_rate')}
FROM users""")(lambda c: retention.repeat_rate(c.users))

register("pareto_curve", f"""
, r AS (SELECT user_id, user_total_spending,
               row_number() OVER (ORDER BY user_total_spending DESC, user_id) AS user_rank,
               sum(user_total_spending) OVER (ORDER BY user_total_spending DESC, user_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs,
               count(*) OVER () AS n, sum(user_total_spending) OVER () AS tot FROM users)
SELECT user_id, {r6('user_total_spending', 'user_total_spending')}, user_rank,
       {r6('CAST(user_rank AS DOUBLE) / n * 100', 'cumulative_users_pct')},
       {r6('CASE WHEN tot <> 0 THEN CAST(cs AS DOUBLE) / CAST(tot AS DOUBLE) * 100 END', 'cumulative_revenue_pct')}
FROM r""")(lambda c: retention.pareto_curve(c.users))

register("pareto_8020", f"""
, n AS (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS k FROM users)
, r AS (SELECT user_total_spending, row_number() OVER (ORDER BY user_total_spending DESC, user_id) AS rn FROM users)
, t AS (SELECT coalesce(sum(user_total_spending), 0) AS s FROM r, n WHERE rn <= k)
, a AS (SELECT sum(user_total_spending) AS s FROM users)
SELECT n.k AS top_20_pct_users, {r6('t.s', 'top_20_revenue')},
       {r6('CASE WHEN a.s > 0 THEN CAST(t.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE 0.0 END * 100', 'revenue_concentration_pct')}
FROM n, t, a""")(lambda c: retention.pareto_8020(c.users, c.spend_index))

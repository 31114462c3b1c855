"""Queries over the pipeline stages: cleaning, features, summary analyses.

Each registration pairs a Spark plan (built from the operators) with the
body of its DuckDB oracle, which is appended to the shared CTE chain of
``plans/oracle.py`` (views ``ev``, ``sessions``, ``users``, ``brands``,
``categories``).
"""

from __future__ import annotations


from shopflow.operators import behavior, clean, features, funnel, products, revenue, segments, temporal
from shopflow.plans.catalog import register
from shopflow.plans.sqlfrag import r6

# -- shared SQL fragments ----------------------------------------------------
NZQ4 = """
, nzq AS (SELECT quantile_cont(CAST(user_total_spending AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q
          FROM users WHERE user_total_spending > 0)
, useg AS (
  SELECT u.*, CASE WHEN u.user_total_spending > 0 THEN
           CASE WHEN CAST(u.user_total_spending AS DOUBLE) <= q[2] THEN 'Low Nonzero'
                WHEN CAST(u.user_total_spending AS DOUBLE) <= q[3] THEN 'Mid Nonzero'
                WHEN CAST(u.user_total_spending AS DOUBLE) <= q[4] THEN 'High Nonzero'
                ELSE 'Top Nonzero' END
         ELSE 'Zero Spender' END AS spending_segment
  FROM users u, nzq)"""

STARTS = """
, st AS (SELECT *, month(session_started_at) AS month, quarter(session_started_at) AS quarter,
                hour(session_started_at) AS hour,
                CASE WHEN hour(session_started_at) <= 6 THEN 'Night'
                     WHEN hour(session_started_at) <= 12 THEN 'Morning'
                     WHEN hour(session_started_at) <= 18 THEN 'Afternoon'
                     WHEN hour(session_started_at) <= 24 THEN 'Evening' END AS time_period
         FROM sessions)"""

MONTHLY = STARTS + """
, monthly AS (SELECT CAST(month AS INTEGER) AS month, count(user_session) AS user_session,
                     round_even(CAST(sum(session_total_spending) AS DOUBLE), 3) AS session_total_spending,
                     round_even(avg(view_to_purchase_rate), 3) AS view_to_purchase_rate
              FROM st WHERE month IS NOT NULL GROUP BY month)
, quarterly AS (SELECT CAST(quarter AS INTEGER) AS quarter, count(user_session) AS user_session,
                     round_even(CAST(sum(session_total_spending) AS DOUBLE), 3) AS session_total_spending,
                     round_even(avg(view_to_purchase_rate), 3) AS view_to_purchase_rate
              FROM st WHERE quarter IS NOT NULL GROUP BY quarter)
, hourly AS (SELECT CAST(hour AS INTEGER) AS hour, count(user_session) AS user_session,
                    round_even(avg(view_to_purchase_rate), 3) AS view_to_purchase_rate
             FROM st WHERE hour IS NOT NULL GROUP BY hour)
, periods AS (
  SELECT l.time_period, coalesce(a.user_session, 0) AS user_session, a.view_to_purchase_rate,
         a.session_total_spending, l.ord
  FROM (VALUES ('Night', 0), ('Morning', 1), ('Afternoon', 2), ('Evening', 3)) l(time_period, ord)
  LEFT JOIN (SELECT time_period, count(user_session) AS user_session,
                    round_even(avg(view_to_purchase_rate), 3) AS view_to_purchase_rate,
                    round_even(avg(session_total_spending), 3) AS session_total_spending
             FROM st WHERE time_period IS NOT NULL GROUP BY time_period) a USING (time_period))"""

FUNNEL = """
, fc AS (SELECT count(*) AS total_sessions, count_if(view_count > 0) AS v, count_if(cart_count > 0) AS ca,
                count_if(purchase_count > 0) AS p FROM sessions)
, fr AS (SELECT total_sessions, v, ca, p,
                coalesce(CAST(ca AS DOUBLE) / nullif(v, 0), 0.0) AS view_to_cart,
                coalesce(CAST(p AS DOUBLE) / nullif(ca, 0), 0.0) AS cart_to_purchase,
                coalesce(CAST(p AS DOUBLE) / nullif(v, 0), 0.0) AS view_to_purchase FROM fc)"""

LOYALTY = """
, loy AS (
  SELECT count_if(user_total_sessions >= 5) AS loyal_user_count,
         count_if(user_total_sessions < 5) AS casual_user_count,
         avg(CASE WHEN user_total_sessions >= 5 THEN user_total_spending END) AS loyal_user_avg_spend,
         avg(CASE WHEN user_total_sessions < 5 THEN user_total_spending END) AS casual_user_avg_spend,
         avg(CASE WHEN user_total_sessions >= 5 THEN user_view_to_purchase_rate END) AS loyal_conversion_rate,
         avg(CASE WHEN user_total_sessions < 5 THEN user_view_to_purchase_rate END) AS casual_conversion_rate
  FROM users HAVING count_if(user_total_sessions >= 5) > 0 AND count_if(user_total_sessions < 5) > 0)"""

REVENUE = """
, rev AS (SELECT coalesce(sum(session_total_spending), 0) AS total_revenue,
                 count_if(session_total_spending > 0) AS revenue_generating_sessions,
                 coalesce(avg(CASE WHEN session_total_spending > 0 THEN session_total_spending END), 0.0)
                   AS avg_order_value,
                 count_if(cart_count > 0 AND purchase_count = 0) AS cart_abandonment_sessions
          FROM sessions)"""

BREADTH = """
, breadth AS (
  SELECT coalesce(avg(CASE WHEN n_unique_brands > 1 THEN view_to_purchase_rate END), 0.0) AS multi_brand_conversion,
         coalesce(avg(CASE WHEN n_unique_brands = 1 THEN view_to_purchase_rate END), 0.0) AS single_brand_conversion,
         coalesce(avg(CASE WHEN n_unique_brands > 1 AND session_total_spending > 0
                           THEN session_total_spending END), 0.0) AS multi_brand_aov,
         coalesce(avg(CASE WHEN n_unique_brands = 1 AND session_total_spending > 0
                           THEN session_total_spending END), 0.0) AS single_brand_aov,
         coalesce(avg(CASE WHEN n_unique_categories > 1 THEN view_to_purchase_rate END), 0.0)
           AS multi_category_conversion,
         avg(n_unique_brands) AS avg_brands_per_session
  FROM sessions)"""

WEEKEND = """
, wk AS (SELECT coalesce(avg(CASE WHEN is_weekend THEN view_to_purchase_rate END), 0.0) AS weekend_conversion_rate,
                coalesce(avg(CASE WHEN NOT is_weekend THEN view_to_purchase_rate END), 0.0) AS weekday_conversion_rate
         FROM sessions)"""

# -- cleaning and features -----------------------------------------------------
register("dedupe_events", """
SELECT count(*) AS raw_rows, (SELECT count(*) FROM dd) AS distinct_rows,
       count(*) - (SELECT count(*) FROM dd) AS duplicate_rows FROM raw""")(lambda c: clean.duplicate_report(c.events_raw))

register("clean_events", f"""
SELECT user_id, user_session, event_type, product_id, brand, category_code, {r6('price', 'price')},
       event_time, hour, weekday, month, event_period, session_start,
       {r6('time_since_start', 'time_since_start')}, {r6('prev_event_gap', 'prev_event_gap')},
       {r6('purchase_spending', 'purchase_spending')}
FROM ev""")(lambda c: c.events_clean)

# The same table from a log whose times are text (C4); unparseable text is null.
register("clean_events_text", f"""
SELECT user_id, user_session, event_type, product_id, brand, category_code, {r6('price', 'price')},
       event_time, hour, weekday, month, event_period, session_start,
       {r6('time_since_start', 'time_since_start')}, {r6('prev_event_gap', 'prev_event_gap')},
       {r6('purchase_spending', 'purchase_spending')}
FROM ev""", source="orders-text")(lambda c: c.events_clean)

register("event_gaps", f"""
SELECT user_session, event_time, product_id, event_type, session_start,
       {r6('time_since_start', 'time_since_start')}, {r6('prev_event_gap', 'prev_event_gap')}
FROM ev""")(lambda c: clean.event_gaps(c.events_clean))

SESSION_SQL = f"""
SELECT user_session, user_id, category_code, brand, view_count, cart_count, purchase_count,
       n_unique_brands, n_unique_categories, session_started_at, session_ended_at,
       {r6('session_total_spending', 'session_total_spending')}, cart_unique, purchase_unique, view_unique,
       {r6('session_duration', 'session_duration')}, {r6('view_to_purchase_rate', 'view_to_purchase_rate')},
       is_weekend
FROM sessions"""
register("session_features", SESSION_SQL)(lambda c: c.sessions.select(*features.SESSION_COLUMNS))

register("session_unique_products", """
SELECT user_session, cart_unique, purchase_unique, view_unique FROM sessions""")(
    lambda c: features.session_unique_products(c.events))

register("user_features", f"""
SELECT user_id, user_total_sessions, total_view_count, total_cart_count, total_purchase_count,
       total_unique_purchase_count, total_unique_view_count,
       {r6('user_avg_session_duration', 'user_avg_session_duration')},
       {r6('user_total_spending', 'user_total_spending')},
       {r6('user_view_to_purchase_rate', 'user_view_to_purchase_rate')},
       {r6('user_purchase_per_session', 'user_purchase_per_session')}
FROM users""")(lambda c: c.users)

register("brand_features", f"""
SELECT brand, "cart", "purchase", "view", {r6('brand_view_to_purchase_rate', 'brand_view_to_purchase_rate')},
       {r6('purchase_spending', 'purchase_spending')} FROM brands""")(lambda c: c.brands)

register("category_features", f"""
SELECT category_code, "cart", "purchase", "view",
       {r6('category_view_to_purchase_rate', 'category_view_to_purchase_rate')},
       {r6('purchase_spending', 'purchase_spending')} FROM categories""")(lambda c: c.categories)

# -- funnel ------------------------------------------------------------------
register("funnel_counts", """
SELECT count(*) AS total_sessions,
       CAST(count_if(view_count > 0) AS BIGINT) AS sessions_with_views,
       CAST(count_if(cart_count > 0) AS BIGINT) AS sessions_with_carts,
       CAST(count_if(purchase_count > 0) AS BIGINT) AS sessions_with_purchases
FROM sessions""")(lambda c: funnel.funnel_counts(c.sessions))

register("funnel_rates", FUNNEL + f"""
SELECT {r6('view_to_cart', 'view_to_cart')}, {r6('cart_to_purchase', 'cart_to_purchase')},
       {r6('view_to_purchase', 'view_to_purchase')} FROM fr""")(lambda c: funnel.funnel_rates(c.sessions))

register("duration_conversion", f"""
, db AS (SELECT CASE WHEN m > -1 AND m <= 1 THEN '<1min' WHEN m > 1 AND m <= 5 THEN '1-5min'
                     WHEN m > 5 AND m <= 15 THEN '5-15min' WHEN m > 15 AND m <= 120 THEN '>15min' END AS duration_category,
                view_to_purchase_rate
         FROM (SELECT least(session_duration / 60.0, 120.0) AS m, view_to_purchase_rate FROM sessions))
SELECT l.duration_category, {r6('coalesce(a.r, 0.0)', 'view_to_purchase_rate')}
FROM (VALUES ('<1min'), ('1-5min'), ('5-15min'), ('>15min')) l(duration_category)
LEFT JOIN (SELECT duration_category, avg(view_to_purchase_rate) AS r FROM db
           WHERE duration_category IS NOT NULL GROUP BY duration_category) a USING (duration_category)""")(
    lambda c: funnel.duration_conversion(c.sessions))

# -- segmentation ------------------------------------------------------------
register("loyalty", LOYALTY + f"""
SELECT CAST(loyal_user_count AS BIGINT) AS loyal_user_count, CAST(casual_user_count AS BIGINT) AS casual_user_count,
       {r6('loyal_user_avg_spend', 'loyal_user_avg_spend')}, {r6('casual_user_avg_spend', 'casual_user_avg_spend')},
       {r6('loyal_conversion_rate', 'loyal_conversion_rate')}, {r6('casual_conversion_rate', 'casual_conversion_rate')}
FROM loy""")(lambda c: segments.loyalty(c.users))

register("loyalty_events", LOYALTY + f"""
SELECT CAST(loyal_user_count AS BIGINT) AS loyal_user_count, CAST(casual_user_count AS BIGINT) AS casual_user_count,
       {r6('loyal_user_avg_spend', 'loyal_user_avg_spend')}, {r6('casual_user_avg_spend', 'casual_user_avg_spend')},
       {r6('loyal_conversion_rate', 'loyal_conversion_rate')}, {r6('casual_conversion_rate', 'casual_conversion_rate')}
FROM loy""", source="events")(lambda c: segments.loyalty(c.users))

register("spending_segments", NZQ4 + f"""
SELECT user_id, {r6('user_total_spending', 'user_total_spending')}, spending_segment FROM useg""")(
    lambda c: segments.spending_segments(c.users, index=c.spend_index).select("user_id", "user_total_spending", "spending_segment"))

register("activity_levels", """
SELECT user_id, user_total_sessions,
       CASE WHEN user_total_sessions >= -1 AND user_total_sessions <= 1 THEN 'One-time'
            WHEN user_total_sessions > 1 AND user_total_sessions <= 5 THEN 'Casual'
            WHEN user_total_sessions > 5 AND user_total_sessions <= 10 THEN 'Regular'
            WHEN user_total_sessions > 10 THEN 'Power' END AS activity_level
FROM users""")(lambda c: segments.activity_levels(c.users).select("user_id", "user_total_sessions", "activity_level"))

register("segment_stats", NZQ4 + f"""
SELECT spending_segment, count(user_id) AS user_count,
       {r6('round_even(avg(user_total_spending), 2)', 'avg_total_spending_per_user')},
       {r6('round_even(avg(user_total_sessions), 2)', 'avg_total_sessions_per_user')},
       {r6('round_even(avg(user_view_to_purchase_rate), 2)', 'avg_conversion_rate')},
       {r6('round_even(avg(user_purchase_per_session), 2)', 'avg_purchases_per_session')}
FROM useg GROUP BY spending_segment""")(lambda c: segments.segment_stats(segments.spending_segments(c.users, index=c.spend_index)))

# -- temporal ------------------------------------------------------------------
register("weekend_conversion", WEEKEND + f"""
SELECT {r6('weekend_conversion_rate', 'weekend_conversion_rate')},
       {r6('weekday_conversion_rate', 'weekday_conversion_rate')} FROM wk""")(
    lambda c: temporal.weekend_conversion(c.sessions))

register("monthly", MONTHLY + f"""
SELECT month, user_session, {r6('session_total_spending', 'session_total_spending')},
       {r6('view_to_purchase_rate', 'view_to_purchase_rate')} FROM monthly""")(
    lambda c: temporal.monthly(cells=c.start_cells))

register("quarterly", MONTHLY + f"""
SELECT quarter, user_session, {r6('session_total_spending', 'session_total_spending')},
       {r6('view_to_purchase_rate', 'view_to_purchase_rate')} FROM quarterly""")(
    lambda c: temporal.quarterly(cells=c.start_cells))

register("time_periods", MONTHLY + f"""
SELECT time_period, user_session, {r6('view_to_purchase_rate', 'view_to_purchase_rate')},
       {r6('session_total_spending', 'session_total_spending')} FROM periods""")(
    lambda c: temporal.time_periods(cells=c.start_cells))

register("hourly", MONTHLY + f"""
SELECT hour, user_session, {r6('view_to_purchase_rate', 'view_to_purchase_rate')} FROM hourly""")(
    lambda c: temporal.hourly(cells=c.start_cells))

PEAKS = MONTHLY + """
, peaks AS (
  SELECT (SELECT hour FROM hourly ORDER BY user_session DESC, hour LIMIT 1) AS peak_activity_hour,
         (SELECT hour FROM hourly ORDER BY view_to_purchase_rate DESC, hour LIMIT 1) AS best_conversion_hour,
         (SELECT month FROM monthly ORDER BY session_total_spending DESC, month LIMIT 1) AS peak_revenue_month,
         (SELECT month FROM monthly ORDER BY view_to_purchase_rate DESC, month LIMIT 1) AS peak_conversion_month)"""
register("temporal_peaks", PEAKS + """
SELECT peak_activity_hour, best_conversion_hour, peak_revenue_month, peak_conversion_month FROM peaks""")(
    lambda c: temporal.temporal_peaks(cells=c.start_cells))

# -- products ------------------------------------------------------------------
register("top_brands", f"""
SELECT brand, {r6('purchase_spending', 'purchase_spending')},
       {r6('brand_view_to_purchase_rate', 'brand_view_to_purchase_rate')}
FROM brands ORDER BY purchase_spending DESC, brand LIMIT 10""")(lambda c: products.top_brands(c.brands))

register("product_averages", f"""
SELECT {r6('(SELECT avg(brand_view_to_purchase_rate) FROM brands)', 'avg_brand_conversion')},
       (SELECT count_if(brand_view_to_purchase_rate > 0.1) FROM brands)::BIGINT AS high_converting_brands_count,
       {r6('(SELECT avg(category_view_to_purchase_rate) FROM categories)', 'avg_category_conversion')}""")(
    lambda c: products.product_averages(c.brands, c.categories))

register("efficient_brands", f"""
SELECT brand, {r6('s', 'efficiency_score')} FROM (
  SELECT brand, brand_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS s FROM brands)
ORDER BY s DESC, brand LIMIT 5""")(lambda c: products.efficient_brands(c.brands))

register("top_categories", f"""
SELECT category_code, {r6('purchase_spending', 'purchase_spending')},
       {r6('category_view_to_purchase_rate', 'category_view_to_purchase_rate')}
FROM categories ORDER BY purchase_spending DESC, category_code LIMIT 5""")(
    lambda c: products.top_categories(c.categories))

register("efficient_categories", f"""
SELECT category_code, {r6('s', 'efficiency_score')} FROM (
  SELECT category_code, category_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS s FROM categories)
ORDER BY s DESC, category_code LIMIT 3""")(lambda c: products.efficient_categories(c.categories))

# -- revenue -------------------------------------------------------------------
register("revenue_totals", REVENUE + f"""
SELECT {r6('total_revenue', 'total_revenue')}, CAST(revenue_generating_sessions AS BIGINT) AS revenue_generating_sessions,
       {r6('avg_order_value', 'avg_order_value')} FROM rev""")(lambda c: revenue.revenue_totals(c.sessions))

register("order_value_distribution", """
SELECT l.order_value_category, coalesce(a.n, 0) AS count
FROM (VALUES ('Small'), ('Medium'), ('Large'), ('Premium')) l(order_value_category)
LEFT JOIN (SELECT CASE WHEN session_total_spending > 0 AND session_total_spending <= 25 THEN 'Small'
                       WHEN session_total_spending > 25 AND session_total_spending <= 100 THEN 'Medium'
                       WHEN session_total_spending > 100 AND session_total_spending <= 500 THEN 'Large'
                       WHEN session_total_spending > 500 THEN 'Premium' END AS order_value_category,
                  count(*) AS n
           FROM sessions WHERE session_total_spending > 0 GROUP BY 1) a USING (order_value_category)""")(
    lambda c: revenue.order_value_distribution(c.sessions))

register("top10_user_share", f"""
, t AS (SELECT sum(user_total_spending) AS s FROM
          (SELECT user_total_spending FROM users ORDER BY user_total_spending DESC, user_id LIMIT 10))
, a AS (SELECT sum(user_total_spending) AS s FROM users)
SELECT {r6('t.s', 'top_10_users_revenue')},
       {r6('CASE WHEN a.s > 0 THEN CAST(t.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE 0.0 END', 'top_10_pct')}
FROM t, a""")(lambda c: revenue.top10_user_share(c.users))

register("top20pct_share", f"""
, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM users)
, r AS (SELECT user_total_spending, row_number() OVER (ORDER BY user_total_spending DESC, user_id) AS rn FROM users)
, t AS (SELECT coalesce(sum(user_total_spending), 0) AS s FROM r, n WHERE rn <= k)
, a AS (SELECT sum(user_total_spending) AS s FROM users)
SELECT n.k AS n_top_20_percent, {r6('t.s', 'top_20_percent_users_revenue')},
       {r6('CASE WHEN a.s > 0 THEN CAST(t.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE 0.0 END', 'top_20_pct_of_user_revenue')}
FROM n, t, a""")(lambda c: revenue.top20pct_share(c.users, c.spend_index))

register("revenue_quintiles", f"""
, q AS (SELECT quantile_cont(CAST(user_total_spending AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q
        FROM users WHERE user_total_spending <> 0)
, lab AS (SELECT CASE WHEN CAST(user_total_spending AS DOUBLE) <= q[2] THEN 'Bottom 20%'
                      WHEN CAST(user_total_spending AS DOUBLE) <= q[3] THEN 'Low 20%'
                      WHEN CAST(user_total_spending AS DOUBLE) <= q[4] THEN 'Middle 20%'
                      WHEN CAST(user_total_spending AS DOUBLE) <= q[5] THEN 'High 20%'
                      ELSE 'Top 20%' END AS revenue_quintile, user_total_spending
          FROM users, q WHERE user_total_spending <> 0)
SELECT l.revenue_quintile, {r6('coalesce(a.s, 0)', 'user_total_spending')}
FROM (VALUES ('Bottom 20%'), ('Low 20%'), ('Middle 20%'), ('High 20%'), ('Top 20%')) l(revenue_quintile)
LEFT JOIN (SELECT revenue_quintile, sum(user_total_spending) AS s FROM lab GROUP BY 1) a USING (revenue_quintile)""")(
    lambda c: revenue.revenue_quintiles(c.users, c.spend_index))

register("cart_abandonment", REVENUE + f"""
SELECT CAST(cart_abandonment_sessions AS BIGINT) AS cart_abandonment_sessions,
       {r6('cart_abandonment_sessions * avg_order_value', 'potential_revenue_from_abandonment')} FROM rev""")(
    lambda c: revenue.cart_abandonment(c.sessions))

# -- behaviour -------------------------------------------------------------------
register("brand_breadth", BREADTH + f"""
SELECT {r6('multi_brand_conversion', 'multi_brand_conversion')},
       {r6('single_brand_conversion', 'single_brand_conversion')},
       {r6('multi_brand_aov', 'multi_brand_aov')}, {r6('single_brand_aov', 'single_brand_aov')} FROM breadth""")(
    lambda c: behavior.brand_breadth(c.sessions))

register("multi_category", BREADTH + f"""
SELECT {r6('multi_category_conversion', 'multi_category_conversion')} FROM breadth""")(
    lambda c: behavior.multi_category(c.sessions))

QUALITY = """
, med AS (SELECT median(session_duration) AS m FROM sessions)
, sq AS (SELECT s.*, CASE WHEN coalesce(s.session_duration > med.m, false) AND s.view_count >= 3
                           AND s.n_unique_brands >= 1 THEN 'High' ELSE 'Low' END AS session_quality
         FROM sessions s, med)"""
register("session_quality", QUALITY + f"""
SELECT session_quality, count(user_session) AS user_session,
       {r6('round_even(avg(view_to_purchase_rate), 3)', 'view_to_purchase_rate')},
       {r6('round_even(avg(session_total_spending), 3)', 'session_total_spending')}
FROM sq GROUP BY session_quality""")(lambda c: behavior.session_quality(c.sessions, c.duration_index))

# -- second fixture: the ``events`` table (extra event types error/signup) ------
register("session_features_events", """
SELECT * REPLACE (round(CAST(session_total_spending AS DOUBLE), 6) AS session_total_spending,
                  round(session_duration, 6) AS session_duration,
                  round(view_to_purchase_rate, 6) AS view_to_purchase_rate)
FROM sessions""", source="events")(lambda c: c.sessions)

register("brand_features_events", """
SELECT * REPLACE (round(brand_view_to_purchase_rate, 6) AS brand_view_to_purchase_rate,
                  round(CAST(purchase_spending AS DOUBLE), 6) AS purchase_spending)
FROM brands""", source="events")(lambda c: c.brands)

register("user_features_events", """
SELECT * REPLACE (round(user_avg_session_duration, 6) AS user_avg_session_duration,
                  round(CAST(user_total_spending AS DOUBLE), 6) AS user_total_spending,
                  round(user_view_to_purchase_rate, 6) AS user_view_to_purchase_rate,
                  round(user_purchase_per_session, 6) AS user_purchase_per_session)
FROM users""", source="events")(lambda c: c.users)

register("funnel_rates_events", FUNNEL + f"""
SELECT {r6('view_to_cart', 'view_to_cart')}, {r6('cart_to_purchase', 'cart_to_purchase')},
       {r6('view_to_purchase', 'view_to_purchase')} FROM fr""", source="events")(
    lambda c: funnel.funnel_rates(c.sessions))

register("brand_breadth_events", BREADTH + f"""
SELECT {r6('multi_brand_conversion', 'multi_brand_conversion')},
       {r6('single_brand_conversion', 'single_brand_conversion')},
       {r6('multi_brand_aov', 'multi_brand_aov')}, {r6('single_brand_aov', 'single_brand_aov')} FROM breadth""",
         source="events")(lambda c: behavior.brand_breadth(c.sessions))

register("segment_stats_events", NZQ4 + f"""
SELECT spending_segment, count(user_id) AS user_count,
       {r6('round_even(avg(user_total_spending), 2)', 'avg_total_spending_per_user')},
       {r6('round_even(avg(user_total_sessions), 2)', 'avg_total_sessions_per_user')},
       {r6('round_even(avg(user_view_to_purchase_rate), 2)', 'avg_conversion_rate')},
       {r6('round_even(avg(user_purchase_per_session), 2)', 'avg_purchases_per_session')}
FROM useg GROUP BY spending_segment""", source="events")(
    lambda c: segments.segment_stats(segments.spending_segments(c.users, index=c.spend_index)))

"""Queries for insights, report sheets, snapshot status and the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopflow.operators import funnel, insights, products, report, revenue, segments, temporal
from shopflow.operators.common import zip_one_row
from shopflow.plans import summary as S
from shopflow.plans.catalog import register
from shopflow.plans.context import ShopContext
from shopflow.plans.oracle import with_chain
from shopflow.plans.queries_core import FUNNEL, LOYALTY, NZQ4, PEAKS, QUALITY, REVENUE, WEEKEND
from shopflow.plans.queries_dash import LTV, USER_COLS
from shopflow.plans.sqlfrag import r6
from shopflow.session import shared_dir
from shopflow.sources.snapshot import snapshot_status
from shopflow.sources.summary import baseline_funnel, read_summary, write_summary

BASELINE_FACTORS = {"view_to_cart": 1.2, "cart_to_purchase": 1.0, "view_to_purchase": 0.8}


def _baseline(c):
    """A baseline summary derived from the current run: one rate 20 % above,
    one equal, one 20 % below (A34's three outcomes)."""
    r = funnel.funnel_rates(c.sessions)
    return r.select(*[(F.col(k) * F.lit(f)).alias(k) for k, f in BASELINE_FACTORS.items()])


ALERTS = FUNNEL + """
, al AS (
  SELECT 0 AS position, 'view_to_cart' AS metric, view_to_cart AS current, view_to_cart * 1.2 AS baseline FROM fr
  UNION ALL SELECT 1, 'cart_to_purchase', cart_to_purchase, cart_to_purchase * 1.0 FROM fr
  UNION ALL SELECT 2, 'view_to_purchase', view_to_purchase, view_to_purchase * 0.8 FROM fr)
, al2 AS (SELECT *, CASE WHEN coalesce(baseline, 0.0) <> 0 THEN (current - baseline) / baseline END AS change FROM al)
, al3 AS (SELECT *, CASE WHEN change <= -0.1 THEN 'dropped' WHEN change >= 0.1 THEN 'increased' END AS status FROM al2)
, alerts AS (SELECT *, CASE WHEN status = 'dropped'
                          THEN '⚠️ ' || metric || ' dropped by ' || format('{:.1f}', abs(change) * 100) || '% compared to baseline.'
                          WHEN status = 'increased'
                          THEN '✅ ' || metric || ' increased by ' || format('{:.1f}', change * 100) || '% compared to baseline.'
                     END AS message FROM al3)"""

register("baseline_alerts", ALERTS + f"""
SELECT position, metric, {r6('current', 'current')}, {r6('baseline', 'baseline')}, {r6('change', 'change')},
       status, message FROM alerts""")(
    lambda c: insights.baseline_alerts(funnel.funnel_rates(c.sessions), _baseline(c)))



def _stored_baseline(c):
    """The summary of the second fixture's log, stored as JSON and read back
    as an earlier run's baseline."""
    other = ShopContext.for_source(c.spark, c.sf_dir, "events")
    path = write_summary(S.build_summary(other, tag="baseline", generated_at="1970-01-01T00:00:00Z"),
                         f"{shared_dir(c.spark)}/shopflow/{c.tag}/baseline", "events")
    return baseline_funnel(read_summary(c.spark, path))


_EVENT_RATES = with_chain(FUNNEL + """
SELECT view_to_cart, cart_to_purchase, view_to_purchase FROM fr""", "events")
_STORED = FUNNEL + f"""
, bl AS ({_EVENT_RATES})
, al AS (
  SELECT 0 AS position, 'view_to_cart' AS metric, fr.view_to_cart AS current, bl.view_to_cart AS baseline FROM fr, bl
  UNION ALL SELECT 1, 'cart_to_purchase', fr.cart_to_purchase, bl.cart_to_purchase FROM fr, bl
  UNION ALL SELECT 2, 'view_to_purchase', fr.view_to_purchase, bl.view_to_purchase FROM fr, bl)""" + ALERTS[ALERTS.index("\n, al2 AS"):]

register("baseline_alerts_stored", _STORED + f"""
SELECT position, metric, {r6('current', 'current')}, {r6('baseline', 'baseline')}, {r6('change', 'change')},
       status, message FROM alerts""")(
    lambda c: insights.baseline_alerts(funnel.funnel_rates(c.sessions), _stored_baseline(c)))

FACTS = FUNNEL + REVENUE + WEEKEND + PEAKS + LOYALTY + NZQ4 + """
, t10 AS (SELECT CASE WHEN a.s > 0 THEN CAST(t.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE 0.0 END AS top_10_pct
          FROM (SELECT sum(user_total_spending) AS s FROM
                  (SELECT user_total_spending FROM users ORDER BY user_total_spending DESC, user_id LIMIT 10)) t,
               (SELECT sum(user_total_spending) AS s FROM users) a)
, t20 AS (SELECT CASE WHEN a.s > 0 THEN CAST(t.s AS DOUBLE) / CAST(a.s AS DOUBLE) ELSE 0.0 END
                   AS top_20_pct_of_user_revenue
          FROM (SELECT coalesce(sum(user_total_spending), 0) AS s FROM
                  (SELECT user_total_spending, row_number() OVER (ORDER BY user_total_spending DESC, user_id) AS rn
                   FROM users)
                WHERE rn <= (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) FROM users)) t,
               (SELECT sum(user_total_spending) AS s FROM users) a)
, segc AS (SELECT spending_segment, count(user_id) AS user_count FROM useg GROUP BY 1)
, zs AS (SELECT sum(CASE WHEN spending_segment = 'Zero Spender' THEN user_count END) / (sum(user_count) + 1e-9)
                  AS zero_spender_share FROM segc)
, lf AS (SELECT count(*) > 0 AS has_loyalty, max(loyal_user_avg_spend) AS loyal_user_avg_spend,
                max(casual_user_avg_spend) AS casual_user_avg_spend FROM loy)
, facts AS (SELECT * FROM fr, rev, wk, peaks, lf, t10, t20, zs)
, msgs AS (
  SELECT 1 AS o, CASE WHEN view_to_cart < 0.1 THEN '⚠️ View→Cart conversion is low (' || format('{:.1f}', view_to_cart * 100) || '%).' END AS m FROM facts
  UNION ALL SELECT 2, CASE WHEN cart_to_purchase < 0.1 THEN '⚠️ Cart→Purchase conversion is low (' || format('{:.1f}', cart_to_purchase * 100) || '%).' END FROM facts
  UNION ALL SELECT 3, CASE WHEN top_10_pct > 0.5 THEN '💡 Top 10 users contribute ' || format('{:.1f}', top_10_pct * 100) || '% of user revenue (high concentration).' END FROM facts
  UNION ALL SELECT 4, CASE WHEN top_20_pct_of_user_revenue > 0 THEN '💡 Top 20% of users account for ' || format('{:.1f}', top_20_pct_of_user_revenue * 100) || '% of user revenue.' END FROM facts
  UNION ALL SELECT 5, CASE WHEN cart_abandonment_sessions > 0 THEN '💰 ' || CAST(cart_abandonment_sessions AS VARCHAR) || ' cart abandonment sessions represent potential recovery of $' || format('{:,.2f}', cart_abandonment_sessions * avg_order_value) || '.' END FROM facts
  UNION ALL SELECT 6, CASE WHEN weekend_conversion_rate > weekday_conversion_rate * 1.1 THEN '📈 Weekend conversion notably higher than weekday; consider shifting spend.'
                           WHEN weekday_conversion_rate > weekend_conversion_rate * 1.1 THEN '📈 Weekday conversion notably higher than weekend; optimize campaigns accordingly.' END FROM facts
  UNION ALL SELECT 7, CASE WHEN best_conversion_hour IS NOT NULL THEN '⏰ Best conversion hour: ' || CAST(best_conversion_hour AS VARCHAR) || ':00.' END FROM facts
  UNION ALL SELECT 8, CASE WHEN peak_revenue_month IS NOT NULL THEN '📅 Peak revenue month: ' || CAST(peak_revenue_month AS VARCHAR) || '.' END FROM facts
  UNION ALL SELECT 9, CASE WHEN peak_conversion_month IS NOT NULL THEN '📅 Peak conversion month: ' || CAST(peak_conversion_month AS VARCHAR) || '.' END FROM facts
  UNION ALL SELECT 10, CASE WHEN has_loyalty AND casual_user_avg_spend > 0 THEN '⭐ Loyal users have ' || format('{:.1f}', (loyal_user_avg_spend / casual_user_avg_spend - 1) * 100) || '% higher average spend than casual users.' END FROM facts
  UNION ALL SELECT 11, CASE WHEN total_revenue = 0 THEN '⚠️ Total revenue is zero—check data ingestion or filtering.' END FROM facts
  UNION ALL SELECT 12, CASE WHEN zero_spender_share > 0.8 THEN '⚠️ Majority of users are zero spenders; consider focusing on activation strategies.' END FROM facts)"""

register("insights", FACTS + """
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS insight_number, m AS insight FROM msgs WHERE m IS NOT NULL""")(
    lambda c: S.insight_list(c))

# Logs in which the rules fire that stay silent on the whole orders log: low
# funnel, zero revenue, zero spenders (views only) and weekend lead.
for _source in ("browsing", "weekend"):
    register(f"insights_{_source}", FACTS + """
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS insight_number, m AS insight FROM msgs WHERE m IS NOT NULL""",
             source=f"orders-{_source}")(lambda c: S.insight_list(c))

register("numbered_insights", FACTS + ALERTS.replace(FUNNEL, "") + """
, allm AS (SELECT position AS o, message AS m FROM alerts UNION ALL SELECT 100 + o, m FROM msgs)
SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS Insight_Number, m AS Business_Insight
FROM allm WHERE m IS NOT NULL""")(
    lambda c: _numbered(c))


def _numbered(c):
    return report.numbered_insights(S.insight_list(c, _baseline(c)))

# -- report sheets ------------------------------------------------------------------
_EXEC_SQL = []
for i, (cat, metric, col, desc) in enumerate(report.EXECUTIVE_ROWS, 1):
    val = f"coalesce({col}, 0)" if col in report._ZERO_DEFAULT else col
    _EXEC_SQL.append(f"SELECT {i} AS position, '{cat}' AS Category, '{metric}' AS Metric, "
                     f"round(CAST({val} AS DOUBLE), 6) AS Value, '{desc}' AS Description FROM ex")
register("executive_summary", FUNNEL + REVENUE + WEEKEND + PEAKS + LOYALTY + """
, lf AS (SELECT max(loyal_user_count) AS loyal_user_count, max(casual_user_count) AS casual_user_count,
                max(loyal_user_avg_spend) AS loyal_user_avg_spend, max(casual_user_avg_spend) AS casual_user_avg_spend FROM loy)
, ex AS (SELECT *, v AS sessions_with_views, ca AS sessions_with_carts, p AS sessions_with_purchases,
                cart_abandonment_sessions * avg_order_value AS potential_revenue_from_abandonment
         FROM fr, rev, wk, peaks, lf)
""" + "\nUNION ALL ".join(_EXEC_SQL))(
    lambda c: report.executive_summary(_exec_wide(c)))


def _exec_wide(c):
    """Session and user scalars in one aggregate each, plus the peaks;
    loyalty values are null (read as 0) when a cohort is missing."""
    p = S.Parts(c)
    both = segments.has_both_cohorts()
    w = zip_one_row(p.session_scalars, p.user_scalars, p.peaks).select(
        "*", *funnel.funnel_rate_cols(),
        (F.col("cart_abandonment_sessions") * F.col("avg_order_value")).alias("potential_revenue_from_abandonment"))
    masked = {"loyal_user_count", "casual_user_count", "loyal_user_avg_spend", "casual_user_avg_spend"}
    return w.select(*[(F.when(both, F.col(x)) if x in masked else F.col(x)).alias(x) for x in _EXEC_COLS])


_EXEC_COLS = [col for _, _, col, _ in report.EXECUTIVE_ROWS]

register("report_users", LTV + f"""
SELECT {USER_COLS}, ltv_segment FROM ltv ORDER BY user_total_spending DESC, user_id LIMIT 1000""")(
    lambda c: report.report_users(c.users, 1000, c.spend_index))

register("report_sessions", f"""
SELECT user_session, user_id, category_code, brand, view_count, cart_count, purchase_count,
       n_unique_brands, n_unique_categories, session_started_at, session_ended_at,
       {r6('session_total_spending', 'session_total_spending')}, cart_unique, purchase_unique, view_unique,
       {r6('session_duration', 'session_duration')}, {r6('view_to_purchase_rate', 'view_to_purchase_rate')},
       is_weekend, {r6('session_duration / 60', 'session_duration_minutes')},
       CASE WHEN session_duration / 60 > 0 AND session_duration / 60 <= 1 THEN 'Quick'
            WHEN session_duration / 60 > 1 AND session_duration / 60 <= 5 THEN 'Short'
            WHEN session_duration / 60 > 5 AND session_duration / 60 <= 15 THEN 'Medium'
            WHEN session_duration / 60 > 15 THEN 'Long' END AS session_quality
FROM sessions ORDER BY session_total_spending DESC, user_session LIMIT 1000""")(
    lambda c: report.report_sessions(c.sessions, 1000))

register("report_brands", f"""
SELECT brand, "cart", "purchase", "view", {r6('brand_view_to_purchase_rate', 'brand_view_to_purchase_rate')},
       {r6('purchase_spending', 'purchase_spending')},
       {r6('brand_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE)', 'efficiency_score')} FROM brands""")(
    lambda c: report.report_brands(c.brands))

register("report_categories", f"""
SELECT category_code, "cart", "purchase", "view",
       {r6('category_view_to_purchase_rate', 'category_view_to_purchase_rate')},
       {r6('purchase_spending', 'purchase_spending')}, split_part(category_code, '.', -1) AS category_display,
       {r6('category_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE)', 'efficiency_score')}
FROM categories""")(lambda c: report.report_categories(c.categories))

register("report_top_brands", f"""
SELECT brand, {r6('purchase_spending', 'purchase_spending')},
       {r6('brand_view_to_purchase_rate', 'brand_view_to_purchase_rate')},
       {r6('brand_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE)', 'efficiency_score')}
FROM brands ORDER BY purchase_spending DESC, brand LIMIT 10""")(
    lambda c: products.with_efficiency(products.top_brands(c.brands), "brand_view_to_purchase_rate"))

register("report_top_categories", f"""
SELECT category_code, {r6('purchase_spending', 'purchase_spending')},
       {r6('category_view_to_purchase_rate', 'category_view_to_purchase_rate')},
       split_part(category_code, '.', -1) AS category_display,
       {r6('category_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE)', 'efficiency_score')}
FROM categories ORDER BY purchase_spending DESC, category_code LIMIT 5""")(
    lambda c: products.with_efficiency(products.with_leaf(products.top_categories(c.categories)),
                                       "category_view_to_purchase_rate"))

register("temporal_union", PEAKS + f"""
SELECT 'Time Period' AS Analysis_Type, time_period AS Period, user_session AS Sessions,
       {r6('view_to_purchase_rate', 'Conversion_Rate')}, {r6('session_total_spending', 'Total_Spending')} FROM periods
UNION ALL SELECT 'Hourly', 'Hour ' || CAST(hour AS VARCHAR), user_session, round(view_to_purchase_rate, 6), 0.0 FROM hourly
UNION ALL SELECT 'Quarterly', 'Q' || CAST(quarter AS VARCHAR), user_session, round(view_to_purchase_rate, 6),
                 round(CAST(session_total_spending AS DOUBLE), 6) FROM quarterly""")(
    lambda c: report.temporal_union(temporal.time_periods(cells=c.start_cells), temporal.hourly(cells=c.start_cells),
                                    temporal.quarterly(cells=c.start_cells)))

register("recovery_report", REVENUE + LOYALTY + """
SELECT 1 AS position, 'Cart Abandonment Recovery' AS Opportunity_Type,
       format('{:,}', cart_abandonment_sessions) || ' abandoned carts' AS Current_State,
       '$' || format('{:,.0f}', cart_abandonment_sessions * avg_order_value) || ' potential revenue' AS Potential_Impact,
       '$' || format('{:,.0f}', cart_abandonment_sessions * avg_order_value * 0.25) AS "Recovery_at_25%",
       '$' || format('{:,.0f}', cart_abandonment_sessions * avg_order_value * 0.5) AS "Recovery_at_50%",
       'High' AS Priority FROM rev
UNION ALL
SELECT 2, 'Casual to Loyal Upgrade', format('{:,}', casual_user_count) || ' casual users',
       '$' || format('{:,.0f}', casual_user_count * (loyal_user_avg_spend - casual_user_avg_spend)) || ' if upgraded to loyal spending',
       '$' || format('{:,.0f}', casual_user_count * (loyal_user_avg_spend - casual_user_avg_spend) * 0.25),
       '$' || format('{:,.0f}', casual_user_count * (loyal_user_avg_spend - casual_user_avg_spend) * 0.5),
       'Medium' FROM loy""")(
    lambda c: report.recovery_report(revenue.cart_abandonment(c.sessions), segments.loyalty(c.users)))

register("snapshot_status", """
SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT count(*) FROM users) AS total_users,
       substr(CAST((SELECT max(session_ended_at) FROM sessions) AS VARCHAR), 1, 10) AS created_at""")(
    lambda c: snapshot_status(c.sessions, c.users))

# The nested summary has no flat SQL equivalent: rows-only check.
register("summary", None)(lambda c: S.build_summary(c, tag="oracle", generated_at="1970-01-01T00:00:00Z"))

# Scalar fields read back out of the nested summary, checked against SQL:
# the assembly (A38) gets a value-level oracle, not only a row count.
register("summary_fields", FACTS + f"""
SELECT total_sessions, {r6('view_to_cart', 'view_to_cart')}, {r6('total_revenue', 'total_revenue')},
       {r6('top_10_pct', 'top_10_pct')}, {r6('top_20_pct_of_user_revenue', 'top_20_pct_of_user_revenue')},
       peak_activity_hour, {r6('multi_category_conversion', 'multi_category_conversion')},
       CAST((SELECT count(*) FROM msgs WHERE m IS NOT NULL) AS INTEGER) AS n_insights,
       CAST((SELECT count(*) FROM hourly) AS INTEGER) AS n_hours,
       CAST((SELECT loyal_user_count FROM loy) AS BIGINT) AS loyal_user_count
FROM facts, (SELECT coalesce(avg(CASE WHEN n_unique_categories > 1 THEN view_to_purchase_rate END), 0.0)
                    AS multi_category_conversion FROM sessions)""")(
    lambda c: S.build_summary(c, tag="check", generated_at="1970-01-01T00:00:00Z").select(
        F.col("summary.funnel.total_sessions").alias("total_sessions"),
        F.col("summary.funnel.view_to_cart").alias("view_to_cart"),
        F.col("summary.revenue.total_revenue").alias("total_revenue"),
        F.col("summary.revenue.top_10_pct").alias("top_10_pct"),
        F.col("summary.revenue.top_20_pct_of_user_revenue").alias("top_20_pct_of_user_revenue"),
        F.col("summary.temporal.peak_activity_hour").alias("peak_activity_hour"),
        F.col("summary.advanced.multi_category_conversion").alias("multi_category_conversion"),
        F.size("summary.insights").alias("n_insights"),
        F.size("summary.temporal.hourly").alias("n_hours"),
        F.col("summary.segmentation.loyalty.loyal_user_count").alias("loyal_user_count")))


def _sheet_index(c):
    from shopflow.plans.report import sheet_index
    return sheet_index(c)


def _sheet_index_sql() -> str:
    from shopflow.plans.catalog import REGISTRY
    from shopflow.plans.oracle import with_chain
    from shopflow.plans.report import SHEETS
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{sheet}' AS sheet, count(*) AS n_rows FROM ({with_chain(REGISTRY[name].sql)})"
        for i, (sheet, name, _) in enumerate(SHEETS, 1))


register("report_sheets", _sheet_index_sql())(_sheet_index)


# Lists of the nested summary (A38): section path, label and values of their
# structs, and the SQL of the same rows in order.
_LISTS = [
    ("segmentation.segment_stats", "spending_segment",
     ["user_count", "avg_total_spending_per_user", "avg_total_sessions_per_user", "avg_conversion_rate", "avg_purchases_per_session"],
     """SELECT spending_segment AS label, spending_segment AS o, 0 AS o2, count(user_id) AS v1, round_even(avg(user_total_spending), 2) AS v2,
        round_even(avg(user_total_sessions), 2) AS v3, round_even(avg(user_view_to_purchase_rate), 2) AS v4,
        round_even(avg(user_purchase_per_session), 2) AS v5 FROM useg GROUP BY spending_segment"""),
    ("temporal.monthly", "month", ["user_session", "session_total_spending", "view_to_purchase_rate"],
     "SELECT month AS label, month AS o, 0 AS o2, user_session AS v1, session_total_spending AS v2, view_to_purchase_rate AS v3, NULL AS v4, NULL AS v5 FROM monthly"),
    ("temporal.quarterly", "quarter", ["user_session", "session_total_spending", "view_to_purchase_rate"],
     "SELECT quarter AS label, quarter AS o, 0 AS o2, user_session AS v1, session_total_spending AS v2, view_to_purchase_rate AS v3, NULL AS v4, NULL AS v5 FROM quarterly"),
    ("temporal.time_period", "time_period", ["user_session", "view_to_purchase_rate", "session_total_spending"],
     "SELECT time_period AS label, ord AS o, 0 AS o2, user_session AS v1, view_to_purchase_rate AS v2, session_total_spending AS v3, NULL AS v4, NULL AS v5 FROM periods"),
    ("temporal.hourly", "hour", ["user_session", "view_to_purchase_rate"],
     "SELECT hour AS label, hour AS o, 0 AS o2, user_session AS v1, view_to_purchase_rate AS v2, NULL AS v3, NULL AS v4, NULL AS v5 FROM hourly"),
    ("product_performance.top_brands", "brand", ["purchase_spending", "brand_view_to_purchase_rate"],
     """SELECT * FROM (SELECT brand AS label, -purchase_spending AS o, brand AS o2, purchase_spending AS v1, brand_view_to_purchase_rate AS v2,
        NULL AS v3, NULL AS v4, NULL AS v5 FROM brands ORDER BY o, o2 LIMIT 10)"""),
    ("product_performance.top_efficient_brands", "brand", ["efficiency_score"],
     """SELECT * FROM (SELECT brand AS label, -brand_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS o, brand AS o2,
        brand_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS v1, NULL AS v2, NULL AS v3, NULL AS v4, NULL AS v5 FROM brands ORDER BY o, o2 LIMIT 5)"""),
    ("product_performance.top_categories", "category_code", ["purchase_spending", "category_view_to_purchase_rate"],
     """SELECT * FROM (SELECT category_code AS label, -purchase_spending AS o, category_code AS o2, purchase_spending AS v1,
        category_view_to_purchase_rate AS v2, NULL AS v3, NULL AS v4, NULL AS v5 FROM categories ORDER BY o, o2 LIMIT 5)"""),
    ("product_performance.top_efficient_categories", "category_code", ["efficiency_score"],
     """SELECT * FROM (SELECT category_code AS label, -category_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS o, category_code AS o2,
        category_view_to_purchase_rate * CAST(purchase_spending AS DOUBLE) AS v1, NULL AS v2, NULL AS v3, NULL AS v4, NULL AS v5 FROM categories ORDER BY o, o2 LIMIT 3)"""),
    ("advanced.quality_analysis", "session_quality", ["user_session", "view_to_purchase_rate", "session_total_spending"],
     """SELECT session_quality AS label, session_quality AS o, 0 AS o2, count(user_session) AS v1, round_even(avg(view_to_purchase_rate), 3) AS v2,
        round_even(avg(session_total_spending), 3) AS v3, NULL AS v4, NULL AS v5 FROM sq GROUP BY session_quality"""),
    ("insights", None, [],
     "SELECT m AS label, o, 0 AS o2, NULL AS v1, NULL AS v2, NULL AS v3, NULL AS v4, NULL AS v5 FROM msgs WHERE m IS NOT NULL"),
]


def summary_lists(summary):
    """(list, position, label, v1..v5): the entries of every list of a nested summary."""
    def rows(path, label, values):
        def entry(x, i):
            fields = [x[v].cast("double") for v in values] + [F.lit(None).cast("double")] * (5 - len(values))
            return F.struct(F.lit(path).alias("list"), (i + 1).alias("position"), (x[label] if label else x).cast("string").alias("label"),
                            *[f.alias(f"v{n}") for n, f in enumerate(fields, 1)])
        return F.transform(F.col(f"summary.{path}"), entry)
    return summary.select(F.explode(F.concat(*[rows(*x[:3]) for x in _LISTS])).alias("e")).select("e.*")


register("summary_lists", FACTS + QUALITY + "".join(f"\n, l{i} AS ({sql})" for i, (_, _, _, sql) in enumerate(_LISTS)) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{path}' AS list, CAST(row_number() OVER (ORDER BY o, o2) AS INTEGER) AS position, CAST(label AS VARCHAR) AS label, "
    + ", ".join(r6(f"v{n}", f"v{n}") for n in range(1, 6)) + f" FROM l{i}" for i, (path, _, _, _) in enumerate(_LISTS)))(
    lambda c: summary_lists(S.build_summary(c, tag="lists", generated_at="1970-01-01T00:00:00Z")))

# Columns of the report's sheets whose contents are totalled: numbers add up,
# texts count their characters.
_SHEET_COLUMNS = {
    "executive_summary": (["position", "Value"], ["Category", "Metric", "Description"]),
    "report_users": (["user_id", "user_total_sessions", "total_purchase_count", "user_total_spending", "user_view_to_purchase_rate"], ["ltv_segment"]),
    "report_sessions": (["user_id", "view_count", "session_total_spending", "session_duration_minutes"], ["user_session", "session_quality"]),
    "report_brands": (["view", "purchase", "brand_view_to_purchase_rate", "purchase_spending", "efficiency_score"], ["brand"]),
    "report_categories": (["view", "purchase", "category_view_to_purchase_rate", "purchase_spending", "efficiency_score"], ["category_code", "category_display"]),
    "report_top_brands": (["purchase_spending", "efficiency_score"], ["brand"]),
    "report_top_categories": (["purchase_spending", "efficiency_score"], ["category_code", "category_display"]),
    "temporal_union": (["Sessions", "Conversion_Rate", "Total_Spending"], ["Analysis_Type", "Period"]),
    "recovery_report": (["position"], ["Opportunity_Type", "Current_State", "Potential_Impact", "Recovery_at_25%", "Recovery_at_50%", "Priority"]),
    "numbered_insights": (["Insight_Number"], ["Business_Insight"]),
}


def _report_values(c):
    """(sheet, column_name, n, total) of the report as written and read back."""
    from shopflow.plans.report import SHEETS, write_full_report
    paths = write_full_report(c, f"{shared_dir(c.spark)}/shopflow/{c.tag}", "values")
    out = None
    for sheet, name, _ in SHEETS:
        numbers, texts = _SHEET_COLUMNS[name]
        totals = [F.struct(F.lit(x).alias("column_name"), F.count(F.col(f"`{x}`")).alias("n"),
                           F.sum((F.char_length(F.col(f"`{x}`")) if x in texts else F.col(f"`{x}`")).cast("decimal(28,6)")).cast("double").alias("total"))
                  for x in numbers + texts]
        rows = c.spark.read.parquet(paths[sheet]).agg(F.array(*totals).alias("t")).select(F.lit(name).alias("sheet"), F.explode("t").alias("t")).select("sheet", "t.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _report_values_sql() -> str:
    from shopflow.plans.catalog import REGISTRY
    parts = []
    for name, (numbers, texts) in _SHEET_COLUMNS.items():
        sheet = f"({with_chain(REGISTRY[name].sql)})"
        each = " UNION ALL ".join(
            f"""SELECT '{name}' AS sheet, '{x}' AS column_name, count("{x}") AS n, """
            f"""round(CAST(sum(CAST({'length("' + x + '")' if x in texts else '"' + x + '"'} AS DECIMAL(28,6))) AS DOUBLE), 6) AS total FROM s"""
            for x in numbers + texts)
        parts.append(f"SELECT * FROM (WITH s AS {sheet} {each})")
    return " UNION ALL ".join(parts)


register("report_values", _report_values_sql())(_report_values)

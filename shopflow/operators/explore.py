"""Dashboard filters, lists, search and derived KPI tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.functions.numeric import mean_exact, money_sum, safe_ratio
from shopflow.functions.text import contains_literal, leaf_name, matches_regex
from shopflow.operators.common import attach_total, top_k, zip_one_row
from shopflow.schema import DASH_PERIOD_LABELS, ZERO_SPENDER


def date_bounds(events: DataFrame) -> DataFrame:
    """First and last event date."""
    d = F.to_date("event_time")
    return events.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


def brand_list(events: DataFrame) -> DataFrame:
    """Sorted distinct non-null brands."""
    return events.where(F.col("brand").isNotNull()).select("brand").distinct().orderBy("brand")


def category_list(events: DataFrame) -> DataFrame:
    """Sorted distinct non-null category codes."""
    return (events.where(F.col("category_code").isNotNull()).select("category_code")
            .distinct().orderBy("category_code"))


def category_leaf_map(events: DataFrame) -> DataFrame:
    """Display (leaf) name -> full code; when leaves collide the code
    that sorts last wins."""
    return (category_list(events).groupBy(leaf_name(F.col("category_code")).alias("category_display"))
            .agg(F.max("category_code").alias("category_code")))


def _shown(matches: DataFrame, key: str, show: int) -> DataFrame:
    # At most ``show`` rows reach the one-partition window.
    first = matches.orderBy(key).limit(show)
    ranked = first.withColumn("match_rank", F.row_number().over(Window.orderBy(key)))
    total = matches.agg(F.count(F.lit(1)).alias("total_matches"))
    return attach_total(ranked, total, show)


def brand_search(events: DataFrame, term: str, show: int = 5) -> DataFrame:
    """D3: brands containing ``term`` (case-insensitive literal), the first
    ``show`` in sort order, with the true total."""
    matches = brand_list(events).where(contains_literal(F.col("brand"), term))
    return _shown(matches, "brand", show).select("match_rank", "brand", "total_matches")


def category_search(events: DataFrame, term: str, show: int = 10) -> DataFrame:
    """D3: category display names containing ``term``; first ``show`` and total."""
    matches = category_leaf_map(events).where(contains_literal(F.col("category_display"), term))
    return _shown(matches, "category_display", show).select(
        "match_rank", "category_display", "category_code", "total_matches")


def apply_filters(df: DataFrame, date_range: tuple | None = None, brands: Sequence[str] | None = None,
                  categories: Sequence[str] | None = None) -> DataFrame:
    """Inclusive date range (only if the frame has event_time), brand
    and category membership; an empty list means no filter.  Rows with no
    time fail the date test.  All three are pushed to the parquet scan; a
    table partitioned by ``event_date`` is pruned by folder as well."""
    out = df
    if date_range and len(date_range) == 2 and "event_time" in df.columns:
        start, end = (d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in date_range)
        day = F.to_date("event_time")
        out = out.where((day >= F.lit(start)) & (day <= F.lit(end)))
        if "event_date" in df.columns:
            out = out.where(F.col("event_date").between(F.lit(start), F.lit(end)))
    if brands and "brand" in df.columns:
        out = out.where(F.col("brand").isin(list(brands)))
    if categories and "category_code" in df.columns:
        out = out.where(F.col("category_code").isin(list(categories)))
    return out


def _session_flags(events: DataFrame, *keys: str) -> DataFrame:
    """Per (keys, session): which event types occur, plus purchase spend.

    First level of a two-level distinct count: partial aggregation keeps a
    hot session to one row per task before the shuffle."""
    t = F.col("event_type")
    return events.groupBy(*keys, "user_session").agg(
        F.max((t == "view").cast("int")).alias("has_view"),
        F.max((t == "cart").cast("int")).alias("has_cart"),
        F.max((t == "purchase").cast("int")).alias("has_purchase"),
        F.sum(F.when(t == "purchase", F.col("purchase_spending"))).alias("purchase_spend"),
        F.count(F.when(t == "purchase", F.col("purchase_spending"))).alias("purchase_priced"),
    )


def filtered_kpis(events: DataFrame) -> DataFrame:
    """KPI row of (filtered) events.  AOV here is the mean per purchase
    *event*, unlike A23's per-session mean."""
    s = _session_flags(events).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        *[F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias(name) for flag, name in (
            ("has_view", "sessions_with_views"), ("has_cart", "sessions_with_carts"),
            ("has_purchase", "sessions_with_purchases"))],
        money_sum(F.col("purchase_spend")).alias("total_revenue"),
        F.sum("purchase_priced").alias("_priced"),
    )
    v = F.col("sessions_with_views")
    return s.select(
        "total_sessions", "sessions_with_views", "sessions_with_carts", "sessions_with_purchases",
        "total_revenue",
        (safe_ratio(F.col("sessions_with_carts"), v) * 100).alias("view_to_cart_rate"),
        (safe_ratio(F.col("sessions_with_purchases"), v) * 100).alias("view_to_purchase_rate"),
        F.coalesce(F.try_divide(F.col("total_revenue").cast("decimal(28,2)"), F.col("_priced")).cast("double"), F.lit(0.0))
         .alias("avg_order_value"),
    )


def dash_period(hour_col) -> object:
    """D8 periods on event hours: < 6 Night, < 12 Morning, < 18 Afternoon, else Evening."""
    return (F.when(hour_col < 6, "Night").when(hour_col < 12, "Morning")
            .when(hour_col < 18, "Afternoon").when(hour_col.isNotNull(), "Evening"))


def filtered_periods(events: DataFrame) -> DataFrame:
    """Per period of the event hour, distinct sessions and the share of
    viewing sessions that purchased; absent periods are omitted."""
    e = events.withColumn("time_period", dash_period(F.hour("event_time"))).where(
        F.col("time_period").isNotNull())
    agg = _session_flags(e, "time_period").groupBy("time_period").agg(
        F.count(F.lit(1)).alias("user_session"),
        F.sum("has_view").alias("_views"), F.sum("has_purchase").alias("_purchases"))
    return agg.select("time_period",
                      safe_ratio(F.col("_purchases"), F.col("_views")).alias("view_to_purchase_rate"),
                      "user_session")


def best_period(periods: DataFrame) -> DataFrame:
    """Period with the highest rate; ties go to the earlier period of day."""
    order = F.array_position(F.array(*[F.lit(x) for x in DASH_PERIOD_LABELS]), F.col("time_period"))
    best = periods.where(F.col("view_to_purchase_rate").isNotNull()).agg(
        F.max_by(F.col("time_period"), F.struct(F.col("view_to_purchase_rate"), -order)).alias("time_period"),
        F.max("view_to_purchase_rate").alias("_r"))
    return best.where(F.col("time_period").isNotNull()).select(
        "time_period", (F.col("_r") * 100).alias("conversion_pct"))


def loyalty_premium(loyalty: DataFrame) -> DataFrame:
    """(loyal / casual avg spend - 1) x 100; 0 without cohorts."""
    premium = F.when(F.col("casual_user_avg_spend") > 0,
                     (F.col("loyal_user_avg_spend") / F.col("casual_user_avg_spend") - 1) * 100)
    return loyalty.agg(F.coalesce(F.max(premium), F.lit(0.0)).alias("loyalty_premium_pct"),
                       F.coalesce(F.max("loyal_user_count"), F.lit(0)).cast("bigint").alias("loyal_user_count"))


def weekend_gap(weekend: DataFrame) -> DataFrame:
    """Percentage-point gap and the leading side."""
    we, wd = F.col("weekend_conversion_rate") * 100, F.col("weekday_conversion_rate") * 100
    return weekend.select(
        we.alias("weekend_conversion_pct"), wd.alias("weekday_conversion_pct"),
        F.when(wd > we, "Weekdays").otherwise("Weekends").alias("leader"),
        F.when(wd > we, wd - we).otherwise(we - wd).alias("gap_pp"))


def premium_order_share(distribution: DataFrame) -> DataFrame:
    """Premium orders as % of all labelled spending sessions."""
    agg = distribution.agg(F.sum(F.when(F.col("order_value_category") == "Premium", F.col("count")))
                           .alias("premium_orders"), F.sum("count").alias("total_orders"))
    return agg.select(F.coalesce("premium_orders", F.lit(0)).cast("bigint").alias("premium_orders"),
                      F.col("total_orders").cast("bigint"),
                      F.when(F.col("total_orders") > 0,
                             F.col("premium_orders") / F.col("total_orders") * 100).alias("premium_pct"))


def nonzero_segments(stats: DataFrame) -> DataFrame:
    """D13."""
    return stats.where(F.col("spending_segment") != ZERO_SPENDER)


def recovery_scenarios(abandonment: DataFrame, rates: Sequence[float] = (0.25, 0.5)) -> DataFrame:
    """Recovered revenue at fixed recovery rates."""
    pairs = ", ".join(f"CAST({r} AS DOUBLE), potential_revenue_from_abandonment * {r}" for r in rates)
    return abandonment.select(F.expr(f"stack({len(rates)}, {pairs}) AS (recovery_rate, recovered_revenue)"))


def upgrade_potential(loyalty: DataFrame) -> DataFrame:
    """Casual users x (loyal - casual avg spend); multiplier when casual spend > 0."""
    l, c = F.col("loyal_user_avg_spend"), F.col("casual_user_avg_spend")
    return loyalty.select(
        "casual_user_count",
        (F.col("casual_user_count") * (l - c)).alias("upgrade_potential"),
        F.when(c > 0, l / c).alias("spend_multiplier"))


def brand_breadth_gap(breadth: DataFrame) -> DataFrame:
    """Multi - single brand conversion in points, shown only when positive."""
    m, s = F.col("multi_brand_conversion") * 100, F.col("single_brand_conversion") * 100
    return breadth.select(m.alias("multi_brand_conv_pct"), s.alias("single_brand_conv_pct"),
                          F.when(m > s, m - s).alias("gap_pp"))


def peak_quarter(quarterly: DataFrame) -> DataFrame:
    """Quarter with the highest (rounded) spend; ties -> earlier quarter."""
    q = quarterly.agg(F.max_by(F.col("quarter"), F.struct(F.col("session_total_spending"), -F.col("quarter")))
                      .alias("peak_quarter"), F.max("session_total_spending").alias("peak_revenue"))
    return q.where(F.col("peak_quarter").isNotNull())


def behavior_table(breadth: DataFrame, multi_cat: DataFrame) -> DataFrame:
    """Three behaviour rows (conversion %, AOV; no AOV for multi-category)."""
    w = zip_one_row(breadth, multi_cat)
    return w.select(F.expr(
        "stack(3, 'Multi-Brand', multi_brand_conversion * 100, multi_brand_aov, "
        "'Single-Brand', single_brand_conversion * 100, single_brand_aov, "
        "'Multi-Category', multi_category_conversion * 100, CAST(0 AS DOUBLE)) "
        "AS (shopping_behavior, conversion_rate, aov)"))


def avg_brands_per_session(sessions: DataFrame) -> DataFrame:
    """D20."""
    return sessions.agg(mean_exact(F.col("n_unique_brands")).alias("avg_brands_per_session"))


def session_date_filter(sessions: DataFrame, start, end, preview: int | None = 100) -> DataFrame:
    """Sessions started within [start, end] (dates, inclusive); the
    dashboard previews the first ``preview`` in session order."""
    day = F.to_date("session_started_at")
    out = sessions.where((day >= F.lit(start)) & (day <= F.lit(end)))
    return out.orderBy("user_session").limit(preview) if preview else out


def top_users(users: DataFrame, k: int = 20) -> DataFrame:
    """D22."""
    return top_k(users, "user_total_spending", k, "user_id")


def key_metrics(counts: DataFrame, revenue: DataFrame) -> DataFrame:
    """Six formatted metric rows."""
    w = zip_one_row(counts, revenue)
    n = lambda c: F.format_number(F.col(c), 0)
    rows = [("Total Sessions", n("total_sessions")), ("Sessions with Views", n("sessions_with_views")),
            ("Sessions with Carts", n("sessions_with_carts")),
            ("Sessions with Purchases", n("sessions_with_purchases")),
            ("Total Revenue", F.concat(F.lit("$"), F.format_number(F.col("total_revenue"), 2))),
            ("Revenue Generating Sessions", n("revenue_generating_sessions"))]
    return w.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("Metric"),
                                                 v.alias("Value")) for i, (m, v) in enumerate(rows, 1)]))
                    .alias("r")).select("r.*")


def event_types(events: DataFrame) -> DataFrame:
    """D24."""
    return events.select("event_type").distinct()


SEARCHED = ("brand", "category_code", "product_id")


def search_values(events: DataFrame) -> DataFrame:
    """The distinct (brand, category, product) of the events: what a search
    looks at, as many rows as the catalogue has."""
    return events.select(*SEARCHED).distinct()


def text_search(events: DataFrame, pattern: str | None, event_type: str | None = None,
                values: DataFrame | None = None) -> DataFrame:
    """Case-insensitive regex over brand, category and product id
    text (null never matches), then an optional event-type filter.

    The expression runs once per distinct value (``values``, by default taken
    from the events); the events are then semi-joined on the values found,
    by broadcast when adaptive execution measures them small.
    """
    out = events
    if pattern:
        found = (search_values(events) if values is None else values).where(
            matches_regex(F.col("brand"), pattern)
            | matches_regex(F.col("category_code"), pattern)
            | matches_regex(F.col("product_id").cast("string"), pattern))
        found = found.select(*[F.col(c).alias(f"_{c}") for c in SEARCHED])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SEARCHED]
        out = out.join(found, same[0] & same[1] & same[2], "left_semi")
    if event_type and event_type != "All":
        out = out.where(F.col("event_type") == event_type)
    return out


def search_sample(hits: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` hits in time order (then session and the other
    columns, so the sample is deterministic); a per-partition top-n."""
    from shopflow.operators.clean import event_order
    order = [event_order()[0], F.col("user_session").asc()] + event_order()[1:]
    return hits.orderBy(*order).limit(n)


def top_products(hits: DataFrame, k: int = 10) -> DataFrame:
    """Rows with a null key drop out; spend and event count per
    product, the top ``k`` by spend, with the category's leaf name."""
    keys = ["product_id", "brand", "category_code"]
    agg = hits.dropna(subset=keys).groupBy(*keys).agg(
        money_sum(F.col("purchase_spending")).alias("purchase_spending"),
        F.count("event_type").alias("event_count"))
    return top_k(agg, "purchase_spending", k, keys).select(
        "product_id", "brand", leaf_name(F.col("category_code")).alias("category_display"),
        "purchase_spending", "event_count")

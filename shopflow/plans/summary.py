"""The nested business summary, and the one-row fact frame behind
the insight rules.

All scalar metrics over the session table come from one aggregate and all
scalar metrics over the user table from another (Spark does not merge
separate aggregates over the same table), and every section, fact and
insight is a column of one wide row: each table is scanned once per
family of metrics, not once per metric.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.numeric import money_sum, nan_to_null, present
from shopflow.operators import behavior, funnel, insights, products, revenue, segments, temporal
from shopflow.operators.common import require_columns, zip_one_row
from shopflow.plans.context import ShopContext
from shopflow.schema import FEATURE_COLUMNS, TIME_PERIOD_LABELS

FUNNEL_COUNTS = ["total_sessions", "sessions_with_views", "sessions_with_carts", "sessions_with_purchases"]
RATES = ["view_to_cart", "cart_to_purchase", "view_to_purchase"]


def zero_spender_share() -> Column:
    """Share of users without spending; null when nobody is a zero spender."""
    zero = F.count(F.when(~F.coalesce(F.col("user_total_spending") > 0, F.lit(False)), F.col("user_id")))
    return (F.when(zero > 0, zero) / (F.count("user_id") + F.lit(1e-9))).alias("zero_spender_share")


class Parts:
    """Analysis pieces shared by the summary, the insights and the report
    sheets; each is built once per ``Parts``."""

    def __init__(self, ctx: ShopContext):
        self.ctx = ctx
        self._memo: dict[str, DataFrame] = {}

    def get(self, name: str, build) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    @property
    def session_scalars(self) -> DataFrame:
        return self.get("ss", lambda: self.ctx.sessions.agg(
            *funnel.funnel_count_aggs(), *temporal.weekend_aggs(), *revenue.revenue_total_aggs(),
            *revenue.abandonment_aggs(), *behavior.breadth_aggs(), *behavior.multi_category_aggs()))

    @property
    def user_scalars(self) -> DataFrame:
        return self.get("us", lambda: self.ctx.users.agg(
            *segments.loyalty_aggs(), money_sum(F.col("user_total_spending")).alias("_user_revenue"),
            zero_spender_share()))

    @property
    def segmented(self):
        return self.get("segmented", lambda: segments.spending_segments(self.ctx.users, index=self.ctx.spend_index))

    @property
    def segment_stats(self):
        return self.get("segment_stats", lambda: segments.segment_stats(self.segmented))

    @property
    def loyalty(self):
        return self.get("loyalty", lambda: segments.loyalty(self.ctx.users))

    @property
    def funnel_rates(self):
        return self.get("funnel_rates", lambda: funnel.funnel_rates(self.ctx.sessions))

    @property
    def peaks(self):
        return self.get("peaks", lambda: temporal.temporal_peaks(cells=self.ctx.start_cells))

    @property
    def top10_sum(self):
        return self.get("top10", lambda: revenue.top_k_revenue(self.ctx.users, 10))

    @property
    def top20(self):
        return self.get("top20", lambda: revenue.top20pct_share(self.ctx.users, self.ctx.spend_index))

    def wide(self, baseline: DataFrame | None = None) -> DataFrame:
        """One row with every scalar metric and fact (and the baseline
        rates as ``b_<rate>`` when given)."""
        frames = [self.session_scalars, self.user_scalars, self.top10_sum,
                  self.top20.select("top_20_pct_of_user_revenue"), self.peaks]
        if baseline is not None:
            frames.append(baseline.select(*[F.col(k).cast("double").alias(f"b_{k}") for k in RATES]))
        w = zip_one_row(*frames)
        return w.select(
            "*", *funnel.funnel_rate_cols(),
            (F.col("cart_abandonment_sessions") * F.col("avg_order_value")).alias("potential_revenue_from_abandonment"),
            F.when(F.col("_user_revenue") > 0,
                   F.col("top_10_users_revenue").cast("double") / F.col("_user_revenue").cast("double"))
             .otherwise(F.lit(0.0)).alias("top_10_pct"),
            segments.has_both_cohorts().alias("has_loyalty"))


def insight_list(ctx: ShopContext, baseline: DataFrame | None = None, parts: Parts | None = None) -> DataFrame:
    p = parts or Parts(ctx)
    return p.wide(baseline).select(
        F.posexplode(insights.insight_array(baseline is not None)).alias("position", "insight")).select(
        (F.col("position") + 1).alias("insight_number"), "insight")


def _rows(df: DataFrame, order: str, alias: str) -> DataFrame:
    """A small table (<= 24 rows) as one sorted array-of-structs column.

    Helper columns (leading underscore) order the rows and stay outside the
    structs; NaN and infinities become null (A37).
    """
    shown = present(df.select(*[c for c in df.columns if not c.startswith("_")], F.col(order).alias("_k")))
    names = [c for c in shown.columns if c != "_k"]
    return shown.agg(F.sort_array(F.collect_list(F.struct("_k", *names))).alias("_a")).select(
        F.transform("_a", lambda x: x.dropFields("_k")).alias(alias))


def _label_map(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), nan_to_null(F.col(value).cast("double"))))).alias(alias))


def _struct(*cols: str):
    return F.struct(*[F.col(c) for c in cols])


def build_summary(ctx: ShopContext, tag: str = "run", baseline: DataFrame | None = None,
                  generated_at: str | None = None) -> DataFrame:
    """One row ``{generated_at, tag, summary}``; ``summary`` holds the six
    sections and the ordered insights."""
    s, u, b, c = ctx.sessions, ctx.users, ctx.brands, ctx.categories
    for name, frame in (("session_features", s), ("user_features", u), ("brand_features", b), ("category_features", c)):
        require_columns(frame, FEATURE_COLUMNS[name], name)
    cells = ctx.start_cells
    p = Parts(ctx)
    rank = lambda df, v: df.withColumn("_r", -F.col(v).cast("double"))
    periods = temporal.time_periods(cells=cells).withColumn(
        "_o", F.array_position(F.array(*[F.lit(x) for x in TIME_PERIOD_LABELS]), F.col("time_period")))
    lists = [
        _label_map(funnel.duration_conversion(s), "duration_category", "view_to_purchase_rate",
                   "duration_bucket_conversion"),
        _rows(p.segment_stats, "spending_segment", "segment_stats"),
        _rows(temporal.monthly(cells=cells), "month", "monthly"),
        _rows(temporal.quarterly(cells=cells), "quarter", "quarterly"),
        _rows(periods, "_o", "time_period"),
        _rows(temporal.hourly(cells=cells), "hour", "hourly"),
        _rows(rank(products.top_brands(b), "purchase_spending"), "_r", "top_brands"),
        products.product_averages(b, c),
        _rows(rank(products.efficient_brands(b), "efficiency_score"), "_r", "top_efficient_brands"),
        _rows(rank(products.top_categories(c), "purchase_spending"), "_r", "top_categories"),
        _rows(rank(products.efficient_categories(c), "efficiency_score"), "_r", "top_efficient_categories"),
        _label_map(revenue.order_value_distribution(s), "order_value_category", "count", "order_value_distribution"),
        _label_map(revenue.revenue_quintiles(u, ctx.spend_index), "revenue_quintile", "user_total_spending", "segment_revenue"),
        _rows(behavior.session_quality(s, ctx.duration_index), "session_quality", "quality_analysis"),
    ]
    w = present(zip_one_row(p.wide(baseline), *lists))
    loyalty = F.when(F.col("has_loyalty"), _struct(*segments.LOYALTY_COLUMNS))
    sections = {
        "funnel": F.struct(*[F.col(x) for x in FUNNEL_COUNTS + RATES], F.col("duration_bucket_conversion")),
        "segmentation": F.struct(F.col("segment_stats"), loyalty.alias("loyalty")),
        "temporal": _struct("weekend_conversion_rate", "weekday_conversion_rate", "monthly", "quarterly",
                            "time_period", "hourly", "peak_activity_hour", "best_conversion_hour",
                            "peak_revenue_month", "peak_conversion_month"),
        "product_performance": _struct("top_brands", "avg_brand_conversion", "high_converting_brands_count",
                                       "top_efficient_brands", "top_categories", "avg_category_conversion",
                                       "top_efficient_categories"),
        "revenue": _struct("total_revenue", "revenue_generating_sessions", "avg_order_value",
                           "order_value_distribution", "top_10_users_revenue", "top_10_pct",
                           "top_20_pct_of_user_revenue", "segment_revenue", "cart_abandonment_sessions",
                           "potential_revenue_from_abandonment"),
        "advanced": F.struct(*[F.col(x) for x in ["multi_brand_conversion", "single_brand_conversion",
                                                  "multi_brand_aov", "single_brand_aov",
                                                  "multi_category_conversion", "quality_analysis"]],
                             loyalty.alias("loyalty")),
    }
    stamp = generated_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat() + "Z"
    summary = F.struct(*[col.alias(name) for name, col in sections.items()],
                       insights.insight_array(baseline is not None).alias("insights"))
    return w.select(F.lit(stamp).alias("generated_at"), F.lit(tag).alias("tag"), summary.alias("summary"))

"""Loyalty cohorts, spending segments, activity levels, segment stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut
from shopflow.functions.numeric import bround, mean_exact
from shopflow.operators.binning import OrderStatistics, index_of, qcut_column, steps
from shopflow.operators.common import requires
from shopflow.schema import (
    ACTIVITY_LEVEL_BINS, ACTIVITY_LEVEL_LABELS, LOYALTY_SESSION_CUTOFF,
    SPENDING_SEGMENT_LABELS, ZERO_SPENDER,
)


LOYALTY_COLUMNS = ["loyal_user_count", "casual_user_count", "loyal_user_avg_spend", "casual_user_avg_spend",
                   "loyal_conversion_rate", "casual_conversion_rate"]


def loyalty_aggs(cutoff: int = LOYALTY_SESSION_CUTOFF) -> list:
    loyal = F.col("user_total_sessions") >= cutoff
    casual = F.col("user_total_sessions") < cutoff
    spend, rate = F.col("user_total_spending"), F.col("user_view_to_purchase_rate")
    return [F.count_if(loyal).alias("loyal_user_count"),
            F.count_if(casual).alias("casual_user_count"),
            mean_exact(F.when(loyal, spend)).alias("loyal_user_avg_spend"),
            mean_exact(F.when(casual, spend)).alias("casual_user_avg_spend"),
            mean_exact(F.when(loyal, rate)).alias("loyal_conversion_rate"),
            mean_exact(F.when(casual, rate)).alias("casual_conversion_rate")]


def has_both_cohorts():
    return (F.col("loyal_user_count") > 0) & (F.col("casual_user_count") > 0)


@requires(users=["user_total_sessions", "user_total_spending", "user_view_to_purchase_rate"])
def loyalty(users: DataFrame, cutoff: int = LOYALTY_SESSION_CUTOFF) -> DataFrame:
    """A4: loyal (>= cutoff sessions) vs casual users; no row unless both
    cohorts are non-empty."""
    return users.agg(*loyalty_aggs(cutoff)).where(has_both_cohorts())


@requires(users=["user_id", "user_total_spending"])
def spending_segments(users: DataFrame, on_duplicates: str = "collapse",
                      index: OrderStatistics | None = None) -> DataFrame:
    """A5: 'Zero Spender' for zero spend; spending quartiles of the rest."""
    spend = F.col("user_total_spending")
    edges = index_of(users, "user_total_spending", index).quantiles(steps(4), above=0)
    if edges is None:
        seg = F.lit(ZERO_SPENDER)
    else:
        seg = F.when(spend > 0, qcut_column(spend, edges, SPENDING_SEGMENT_LABELS, on_duplicates)) \
               .otherwise(F.lit(ZERO_SPENDER))
    return users.withColumn("spending_segment", seg)


@requires(users=["user_total_sessions"])
def activity_levels(users: DataFrame) -> DataFrame:
    """One-time / Casual / Regular / Power by session count."""
    return users.withColumn("activity_level",
                            cut(F.col("user_total_sessions"), ACTIVITY_LEVEL_BINS, ACTIVITY_LEVEL_LABELS,
                                right=True, include_lowest=True))


@requires(segmented=["spending_segment", "user_id", "user_total_spending", "user_total_sessions",
                     "user_view_to_purchase_rate", "user_purchase_per_session"])
def segment_stats(segmented: DataFrame) -> DataFrame:
    """Per spending segment, rounded to 2 (half-even)."""
    return segmented.groupBy("spending_segment").agg(
        F.count("user_id").alias("user_count"),
        bround(mean_exact(F.col("user_total_spending")), 2).alias("avg_total_spending_per_user"),
        bround(mean_exact(F.col("user_total_sessions")), 2).alias("avg_total_sessions_per_user"),
        bround(mean_exact(F.col("user_view_to_purchase_rate")), 2).alias("avg_conversion_rate"),
        bround(mean_exact(F.col("user_purchase_per_session")), 2).alias("avg_purchases_per_session"),
    )

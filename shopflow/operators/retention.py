"""Lifetime-value tiers, frequency, repeat rate, revenue concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut
from shopflow.functions.numeric import mean_exact, safe_ratio
from shopflow.operators.binning import OrderStatistics, index_of, qcut_column, steps
from shopflow.operators.ordered import global_order
from shopflow.operators.revenue import top_share
from shopflow.operators.common import requires
from shopflow.schema import LTV_SMALL_LABELS, LTV_TIER_LABELS

SPEND = "user_total_spending"


def _tier_plan(index: OrderStatistics) -> tuple[int, list[str], list[float] | None]:
    if index.distinct < 5:
        n = min(index.distinct, 3)
        labels = LTV_SMALL_LABELS[:n]
    else:
        n, labels = 5, LTV_TIER_LABELS
    edges = index.quantiles(steps(n)) if n > 0 else None
    return n, list(labels), edges


def _fits(edges: list[float] | None) -> bool:
    # pandas.qcut with labels fails when edges repeat (or there are none).
    return bool(edges) and len(edges) > 1 and len(set(edges)) == len(edges)


def ltv_tier_column(users: DataFrame, index: OrderStatistics | None = None) -> Column:
    """Spend quintiles (Bronze..Diamond), or Low/Medium/High for fewer
    than 5 distinct spends; when those edges repeat, fixed fallbacks on the
    33rd/67th percentiles.  Only a handful of edges reach the driver."""
    index = index_of(users, SPEND, index)
    n, labels, edges = _tier_plan(index)
    spend = F.col(SPEND)
    if _fits(edges):
        return qcut_column(spend, edges, labels)
    if index.most is None:
        return F.lit(None).cast("string")
    mx = float(index.most)
    if mx == 0:
        return F.lit("No Spending")
    q33, q67 = index.quantiles([0.33, 0.67])
    v = spend.cast("double")
    inf = float("inf")
    if q33 == 0 and q67 == 0:
        if mx * 0.5 > 0.01:
            return cut(v, [0, 0.01, mx * 0.5, inf], ["Zero", "Low", "High"], right=True, include_lowest=True)
        # The reference would reject these non-increasing edges; merge them.
        return cut(v, [0, 0.01, inf], ["Zero", "Low"], right=True, include_lowest=True)
    if q33 == q67:
        return cut(v, [-inf, q33, inf], ["Low", "High"], right=True, include_lowest=True)
    return cut(v, [-inf, q33, q67, inf], ["Low", "Medium", "High"], right=True, include_lowest=True)


@requires(users=["user_id", SPEND])
def ltv_segments(users: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    return users.withColumn("ltv_segment", ltv_tier_column(users, index))


@requires(segmented=["ltv_segment", "user_id", SPEND, "user_total_sessions"])
def ltv_stats(segmented: DataFrame) -> DataFrame:
    """R2: observed segments only."""
    return segmented.where(F.col("ltv_segment").isNotNull()).groupBy("ltv_segment").agg(
        F.count("user_id").alias("user_count"),
        mean_exact(F.col(SPEND)).alias("avg_user_total_spending"),
        mean_exact(F.col("user_total_sessions")).alias("avg_user_total_sessions"))


@requires(users=[SPEND])
def high_value_users(users: DataFrame, p: float = 0.8, index: OrderStatistics | None = None) -> DataFrame:
    """Users strictly above the 80th spend percentile."""
    q = index_of(users, SPEND, index).quantiles([p])
    thr = None if q is None else q[0]
    cond = F.lit(False) if thr is None else (F.col(SPEND).cast("double") > F.lit(thr))
    return users.agg(F.lit(thr).cast("double").alias("spend_threshold"),
                     F.count_if(cond).alias("high_value_users"))


@requires(users=["user_total_sessions"])
def session_frequency(users: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most common session counts (ties -> smaller count),
    listed by session count."""
    counts = users.groupBy("user_total_sessions").agg(F.count(F.lit(1)).alias("user_count"))
    return counts.orderBy(F.col("user_count").desc(), F.col("user_total_sessions").asc()).limit(k).orderBy("user_total_sessions")


@requires(users=["user_total_sessions"])
def repeat_rate(users: DataFrame) -> DataFrame:
    """Share of users with more than one session, in %."""
    return users.agg(F.count_if(F.col("user_total_sessions") > 1).alias("repeat_customers"),
                     F.count(F.lit(1)).alias("total_customers")).select(
        "repeat_customers", "total_customers",
        (safe_ratio(F.col("repeat_customers"), F.col("total_customers")) * 100).alias("retention_rate"))


@requires(users=["user_id", SPEND])
def pareto_curve(users: DataFrame, limit: int | None = None) -> DataFrame:
    """Users by spend (desc, then id) with cumulative user and revenue %.

    The prefix sum is a distributed global order (one range shuffle, sums
    carried in the sorted scan, an offset per range).
    """
    base = users.select("user_id", SPEND)
    ranked = global_order(base, [F.col(SPEND).desc(), F.col("user_id").asc()], sums=[SPEND])
    total = F.col(f"total_{SPEND}")
    out = ranked.select(
        "user_id", SPEND, F.col("_rank").alias("user_rank"),
        (F.col("_rank") / F.col("_n_total") * 100).alias("cumulative_users_pct"),
        F.when(total != 0, F.col(f"cum_{SPEND}").cast("double") / total.cast("double") * 100)
         .alias("cumulative_revenue_pct"))
    return out.where(F.col("user_rank") <= limit) if limit else out


def pareto_8020(users: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    """Revenue share of the first floor(0.2 n) users, in % (no minimum)."""
    s = top_share(users, 0.2, min_one=False, index=index)
    return s.select(F.col("top_users").alias("top_20_pct_users"), F.col("top_revenue").alias("top_20_revenue"),
                    (F.col("top_share") * 100).alias("revenue_concentration_pct"))


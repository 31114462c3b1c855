"""Revenue totals, order values, concentration, abandonment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut, keep_all_labels
from shopflow.functions.numeric import mean_exact, money_sum, safe_ratio
from shopflow.operators.binning import OrderStatistics, index_of, qcut_column, steps
from shopflow.operators.common import requires, top_k, zip_one_row
from shopflow.schema import ORDER_VALUE_BINS, ORDER_VALUE_LABELS, REVENUE_QUINTILE_LABELS


def revenue_total_aggs() -> list:
    s = F.col("session_total_spending")
    return [money_sum(s).alias("total_revenue"),
            F.count_if(s > 0).alias("revenue_generating_sessions"),
            F.coalesce(mean_exact(F.when(s > 0, s)), F.lit(0.0)).alias("avg_order_value")]


def abandonment_aggs() -> list:
    return [F.count_if((F.col("cart_count") > 0) & (F.col("purchase_count") == 0))
            .alias("cart_abandonment_sessions")]


def abandonment_cols() -> list:
    """A28 from ``cart_abandonment_sessions`` and ``avg_order_value``."""
    return [F.col("cart_abandonment_sessions"),
            (F.col("cart_abandonment_sessions") * F.col("avg_order_value")).alias("potential_revenue_from_abandonment")]


@requires(sessions=["session_total_spending"])
def revenue_totals(sessions: DataFrame) -> DataFrame:
    """AOV is the mean spend of spending *sessions*."""
    return sessions.agg(*revenue_total_aggs())


@requires(sessions=["session_total_spending"])
def order_value_distribution(sessions: DataFrame) -> DataFrame:
    """Spending sessions per order-value label; empty labels -> 0."""
    s = F.col("session_total_spending")
    agg = (sessions.where(s > 0)
           .withColumn("order_value_category", cut(s, ORDER_VALUE_BINS, ORDER_VALUE_LABELS, right=True))
           .where(F.col("order_value_category").isNotNull())
           .groupBy("order_value_category").agg(F.count(F.lit(1)).alias("count")))
    return keep_all_labels(agg, ORDER_VALUE_LABELS, "order_value_category", {"count": 0})


def top_k_revenue(users: DataFrame, k: int = 10) -> DataFrame:
    """Revenue of the ``k`` biggest spenders (one row)."""
    return top_k(users, "user_total_spending", k, "user_id").agg(
        money_sum(F.col("user_total_spending")).alias("top_10_users_revenue"))


@requires(users=["user_id", "user_total_spending"])
def top10_user_share(users: DataFrame, k: int = 10) -> DataFrame:
    """Revenue of the top users and its share of all user revenue."""
    top = top_k(users, "user_total_spending", k, "user_id").agg(
        money_sum(F.col("user_total_spending")).alias("top_10_users_revenue"))
    total = users.agg(money_sum(F.col("user_total_spending")).alias("_total"))
    return zip_one_row(top, total).select(
        "top_10_users_revenue",
        F.when(F.col("_total") > 0, safe_ratio(F.col("top_10_users_revenue"), F.col("_total")))
         .otherwise(F.lit(0.0)).alias("top_10_pct"))


@requires(users=["user_total_spending"])
def top_share(users: DataFrame, fraction: float = 0.2, min_one: bool = True,
              index: OrderStatistics | None = None) -> DataFrame:
    """Revenue of the first floor(fraction * n) users by spend.

    ``min_one`` keeps at least one user (A26); R7 has no minimum.  Counts and
    the sum of the k largest spends are read from the index of spends.
    """
    spend = F.col("user_total_spending")
    found = index_of(users, "user_total_spending", index)
    n = found.n_rows
    k = int(n * fraction)
    if min_one:
        k = max(1, k)
    k = min(k, n)
    total = users.agg(money_sum(spend).alias("total_revenue"))
    return total.withColumn("top_revenue", F.lit(found.top_sum(k)).cast("decimal(28,2)")).select(
        F.lit(k).cast("bigint").alias("top_users"),
        "top_revenue",
        F.when(F.col("total_revenue") > 0, safe_ratio(F.col("top_revenue"), F.col("total_revenue")))
         .otherwise(F.lit(0.0)).alias("top_share"))


def top20pct_share(users: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    """A26."""
    return top_share(users, 0.2, True, index).select(
        F.col("top_users").alias("n_top_20_percent"),
        F.col("top_revenue").alias("top_20_percent_users_revenue"),
        F.col("top_share").alias("top_20_pct_of_user_revenue"))


@requires(users=["user_total_spending"])
def revenue_quintiles(users: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    """Zero spenders excluded; spend per quintile label, all labels kept."""
    spend = F.col("user_total_spending")
    nonzero = users.where(spend != 0)
    edges = index_of(users, "user_total_spending", index).quantiles(steps(5), without=0)
    if edges is None:
        agg = nonzero.select(F.lit(None).cast("string").alias("revenue_quintile"), spend).where(F.lit(False))
    else:
        agg = nonzero.withColumn("revenue_quintile", qcut_column(spend, edges, REVENUE_QUINTILE_LABELS))
    agg = agg.where(F.col("revenue_quintile").isNotNull()).groupBy("revenue_quintile").agg(
        money_sum(spend).alias("user_total_spending"))
    return keep_all_labels(agg, REVENUE_QUINTILE_LABELS, "revenue_quintile", None).select(
        "revenue_quintile",
        F.coalesce(F.col("user_total_spending"), F.lit(0).cast("decimal(28,2)")).alias("user_total_spending"))


@requires(sessions=["session_total_spending", "cart_count", "purchase_count"])
def cart_abandonment(sessions: DataFrame) -> DataFrame:
    """Carts without purchase; potential = count x AOV."""
    return sessions.agg(*abandonment_aggs(), *revenue_total_aggs()).select(*abandonment_cols())


"""Multi-brand / multi-category behaviour and session quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.numeric import bround, mean_exact
from shopflow.operators.binning import OrderStatistics, index_of
from shopflow.operators.common import requires
from shopflow.schema import MIN_BRANDS_FOR_HIGH_QUALITY, MIN_VIEWS_FOR_HIGH_QUALITY


def _mean0(cond, col):
    return F.coalesce(mean_exact(F.when(cond, F.col(col))), F.lit(0.0))


def breadth_aggs() -> list:
    nb, s = F.col("n_unique_brands"), F.col("session_total_spending")
    return [_mean0(nb > 1, "view_to_purchase_rate").alias("multi_brand_conversion"),
            _mean0(nb == 1, "view_to_purchase_rate").alias("single_brand_conversion"),
            _mean0((nb > 1) & (s > 0), "session_total_spending").alias("multi_brand_aov"),
            _mean0((nb == 1) & (s > 0), "session_total_spending").alias("single_brand_aov")]


def multi_category_aggs() -> list:
    return [_mean0(F.col("n_unique_categories") > 1, "view_to_purchase_rate").alias("multi_category_conversion")]


@requires(sessions=["n_unique_brands", "view_to_purchase_rate", "session_total_spending"])
def brand_breadth(sessions: DataFrame) -> DataFrame:
    """Conversion and AOV of multi-brand vs single-brand sessions."""
    return sessions.agg(*breadth_aggs())


@requires(sessions=["n_unique_categories", "view_to_purchase_rate"])
def multi_category(sessions: DataFrame) -> DataFrame:
    """A31."""
    return sessions.agg(*multi_category_aggs())


@requires(sessions=["session_duration", "view_count", "n_unique_brands"])
def session_quality_flag(sessions: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    """High when longer than the median session, >= 3 views and >= 1 brand."""
    med = index_of(sessions, "session_duration", index).quantiles([0.5])
    longer = F.lit(False) if med is None else (F.col("session_duration") > F.lit(med[0]))
    high = (F.coalesce(longer, F.lit(False))
            & (F.col("view_count") >= MIN_VIEWS_FOR_HIGH_QUALITY)
            & (F.col("n_unique_brands") >= MIN_BRANDS_FOR_HIGH_QUALITY))
    return sessions.withColumn("session_quality", F.when(high, "High").otherwise("Low"))


@requires(sessions=["user_session", "view_to_purchase_rate", "session_total_spending"])
def session_quality(sessions: DataFrame, index: OrderStatistics | None = None) -> DataFrame:
    """Sessions, mean rate, mean spend per quality (rounded to 3)."""
    return session_quality_flag(sessions, index).groupBy("session_quality").agg(
        F.count("user_session").alias("user_session"),
        bround(mean_exact(F.col("view_to_purchase_rate")), 3).alias("view_to_purchase_rate"),
        bround(mean_exact(F.col("session_total_spending")), 3).alias("session_total_spending"),
    )

"""weekend/weekday, monthly, quarterly, period and hourly views.

The tables take the sessions, or ``cells`` (``start_cells`` of them, written
once by the context).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut, keep_all_labels
from shopflow.functions.numeric import bround, mean_exact, money_sum
from shopflow.operators.common import requires, zip_one_row
from shopflow.schema import TIME_PERIOD_BINS, TIME_PERIOD_LABELS


def weekend_aggs() -> list:
    w, r = F.col("is_weekend"), F.col("view_to_purchase_rate")
    return [F.coalesce(mean_exact(F.when(w, r)), F.lit(0.0)).alias("weekend_conversion_rate"),
            F.coalesce(mean_exact(F.when(~w, r)), F.lit(0.0)).alias("weekday_conversion_rate")]


@requires(sessions=["is_weekend", "view_to_purchase_rate"])
def weekend_conversion(sessions: DataFrame) -> DataFrame:
    """Mean session rate on weekends and weekdays (empty -> 0)."""
    return sessions.agg(*weekend_aggs())


@requires(sessions=["session_started_at", "view_to_purchase_rate", "user_session", "session_total_spending"])
def start_cells(sessions: DataFrame) -> DataFrame:
    """Sessions by (month, hour) of their start: counts and exact sums.

    At most 289 rows (those without a start have null keys) from one scan;
    every temporal table rolls up from them, so month of year, quarter, hour
    and period never read the sessions again.
    """
    start, rate, spend = F.col("session_started_at"), F.col("view_to_purchase_rate"), F.col("session_total_spending")
    exact = "decimal(28,12)"
    return sessions.groupBy(F.month(start).alias("month"), F.hour(start).alias("hour")).agg(
        F.count("user_session").alias("n"),
        F.count(rate).alias("n_rate"), F.sum(rate.cast(exact)).alias("rate"),
        F.count(spend).alias("n_spend"), F.sum(spend.cast("decimal(28,2)")).alias("spend"))


def _cells(sessions: DataFrame | None, cells: DataFrame | None) -> DataFrame:
    found = start_cells(sessions) if cells is None else cells
    return (found.withColumn("quarter", F.ceil(F.col("month") / 3).cast("int"))
                 .withColumn("time_period", cut(F.col("hour"), TIME_PERIOD_BINS, TIME_PERIOD_LABELS, right=True, include_lowest=True)))


def _mean(total: str, n: str, exact: str) -> Column:
    # Rates are summed to 12 digits, so their mean is right to 11: a mean that
    # is a tie of the later half-even rounding (0.8725) stays one.
    return F.round(F.try_divide(F.sum(total).cast(exact), F.sum(n).cast("decimal(13,0)")), 11).cast("double")


def _by(sessions: DataFrame | None, cells: DataFrame | None, key: str, spend: str | None = "sum") -> DataFrame:
    rows = _cells(sessions, cells).where(F.col(key).isNotNull())
    aggs = [F.sum("n").alias("user_session")]
    if spend == "sum":
        aggs.append(bround(money_sum(F.col("spend")), 3).alias("session_total_spending"))
    aggs.append(bround(_mean("rate", "n_rate", "decimal(28,12)"), 3).alias("view_to_purchase_rate"))
    if spend == "mean":
        aggs.append(bround(_mean("spend", "n_spend", "decimal(24,2)"), 3).alias("session_total_spending"))
    return rows.groupBy(key).agg(*aggs)


def monthly(sessions: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """A10: month of year (years merged): sessions, spend, mean rate."""
    return _by(sessions, cells, "month")


def quarterly(sessions: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """A11."""
    return _by(sessions, cells, "quarter")


def time_periods(sessions: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """All four periods kept (count 0, means null)."""
    agg = _by(sessions, cells, "time_period", spend="mean")
    return keep_all_labels(agg, TIME_PERIOD_LABELS, "time_period", {"user_session": 0})


def hourly(sessions: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """A14."""
    return _by(sessions, cells, "hour", spend=None)


def _argmax(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    # Ties go to the smallest key; an empty input gives null.
    return df.agg(F.max_by(F.col(key), F.struct(F.col(value), -F.col(key))).cast("int").alias(alias))


def temporal_peaks(sessions: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Argmax over the rounded hourly and monthly tables."""
    h, m = hourly(sessions, cells), monthly(sessions, cells)
    return zip_one_row(
        _argmax(h, "hour", "user_session", "peak_activity_hour"),
        _argmax(h, "hour", "view_to_purchase_rate", "best_conversion_hour"),
        _argmax(m, "month", "session_total_spending", "peak_revenue_month"),
        _argmax(m, "month", "view_to_purchase_rate", "peak_conversion_month"),
    )

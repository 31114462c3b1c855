"""K5 safe ratio, K6 half-even rounding, exact means and presentation casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double; a null or zero denominator gives 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def bround(col: Column, digits: int) -> Column:
    """K6: numpy's rounding, half to even on the binary value
    (``rint(x * 10**d) / 10**d``), e.g. 2.675 -> 2.68, 1.125 -> 1.12."""
    m = float(10 ** digits)
    return F.rint(col.cast("double") * F.lit(m)) / F.lit(m)


def mean_exact(col: Column, scale: int = 12, precision: int = 28) -> Column:
    """Mean that does not depend on partitioning or row order.

    Values are accumulated as decimals (exact addition, 16 integer digits,
    12 fractional: exact for money, microsecond durations, and ratios to
    1e-12); the quotient is returned as a double.
    """
    return F.avg(col.cast(T.DecimalType(precision, scale))).cast("double")


def money_sum(col: Column) -> Column:
    """Exact money total; an all-null or empty input gives 0."""
    return F.coalesce(F.sum(col), F.lit(0).cast(T.DecimalType(18, 2)))


def seconds_between(start: Column, end: Column) -> Column:
    """end - start in seconds (microsecond precision) as double."""
    return (F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000)).cast("double")


def nan_to_null(col: Column) -> Column:
    """NaN and +-infinity become null."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def present(df: DataFrame) -> DataFrame:
    """Output casts: decimals to double, zoned timestamps to wall-clock UTC."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast(T.TimestampNTZType())
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)

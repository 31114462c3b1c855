"""Event cleaning.

Order matters: exact duplicates are removed on the raw values, before the
brand fill and the type coercions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.buckets import cut
from shopflow.functions.numeric import seconds_between
from shopflow.operators.ordered import keyed_clock
from shopflow.schema import EVENT_PERIOD_BINS, EVENT_PERIOD_LABELS



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())


_TIEBREAK = ["product_id", "event_type", "price", "user_id", "brand", "category_code"]


def event_order() -> list[Column]:
    """Row order inside a session.

    The reference uses file order; we use event time (nulls last), then the
    remaining columns (nulls first).  After de-duplication this is a total
    order, and it equals file order on time-sorted logs up to equal
    timestamps.
    """
    return [F.col("event_time").asc_nulls_last()] + [F.col(c).asc_nulls_first() for c in _TIEBREAK]


def event_order_key() -> Column:
    """``event_order`` as one comparable struct.  Struct comparison puts
    null fields first, so only event_time needs a null flag."""
    return F.struct(F.col("event_time").isNull().alias("t_null"), F.col("event_time"),
                    *[F.col(c) for c in _TIEBREAK])


def dedupe_events(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (all columns, nulls equal).

    A hash aggregate on all columns: map-side partial aggregation collapses
    a hot group of copies before the shuffle.
    """
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """q dedupe_events: raw rows, distinct rows and duplicates in one pass
    (group counts of the same aggregate the dedupe uses)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").alias("raw_rows"), F.count(F.lit(1)).alias("distinct_rows")).select(
        "raw_rows", "distinct_rows", (F.col("raw_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def drop_null_sessions(df: DataFrame) -> DataFrame:
    """C2."""
    return df.where(F.col("user_session").isNotNull())


def fill_brand(df: DataFrame, value: str = "unknown") -> DataFrame:
    """Null brand -> 'unknown'."""
    return df.withColumn("brand", F.coalesce(F.col("brand"), F.lit(value)))


def coerce_event_time(df: DataFrame) -> DataFrame:
    """C4: event_time as wall-clock UTC timestamp; unparseable text -> null.

    Text such as ``2020-09-24 11:57:06 UTC`` is read with its zone and
    converted to UTC wall-clock, independent of the session time zone.
    """
    dt = df.schema["event_time"].dataType
    c = F.col("event_time")
    if isinstance(dt, T.StringType):
        parsed = F.coalesce(
            F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS] VV")),
            F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS] z")),
            F.try_to_timestamp(c))
        ntz = F.timestamp_add("MICROSECOND", F.unix_micros(parsed), _epoch())
    elif isinstance(dt, T.TimestampType):
        ntz = F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch())
    elif isinstance(dt, (T.TimestampNTZType, T.DateType)):
        ntz = c.cast(T.TimestampNTZType())
    elif isinstance(dt, (T.LongType, T.IntegerType)):
        ntz = F.timestamp_add("SECOND", c, _epoch())  # seconds since 1970
    else:
        raise TypeError(f"event_time has type {dt.simpleString()}; text, timestamps, dates and epoch seconds are read")
    return df.withColumn("event_time", ntz)


def add_time_parts(df: DataFrame) -> DataFrame:
    """Hour, weekday (Monday = 0), month."""
    t = F.col("event_time")
    return (df.withColumn("hour", F.hour(t))
              .withColumn("weekday", F.weekday(t))
              .withColumn("month", F.month(t)))


def add_event_period(df: DataFrame) -> DataFrame:
    """Left-closed hour buckets night/morning/afternoon/evening."""
    return df.withColumn("event_period",
                         cut(F.col("hour"), EVENT_PERIOD_BINS, EVENT_PERIOD_LABELS, right=False))


def add_session_clock(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """session_start, time_since_start, prev_event_gap (seconds).

    prev_event_gap is the gap to the previous event of the session in
    ``event_order``; the first event gets 0, as does any gap with a missing
    time.  Computed with the skew-safe ``keyed_clock``, which may cut any
    session at any row.
    """
    derived = [c for c in ("hour", "weekday", "month", "event_period") if c in df.columns]
    c = keyed_clock(df.drop(*derived), "user_session", "event_time", event_order(), num_partitions)
    if derived:  # follow from the time: made again rather than shuffled and written
        c = add_event_period(add_time_parts(c)).drop(*{"hour", "weekday", "month", "event_period"} - {*derived})
    return (c.withColumn("session_start", F.col("_key_first"))
             .withColumn("time_since_start", seconds_between(F.col("session_start"), F.col("event_time")))
             .withColumn("prev_event_gap",
                         F.coalesce(seconds_between(F.col("_prev_time"), F.col("event_time")), F.lit(0.0)))
             .drop("_key_first", "_prev_time"))


def add_purchase_spending(df: DataFrame) -> DataFrame:
    """Price on purchase rows, else 0 (a purchase without price stays null)."""
    return df.withColumn(
        "purchase_spending",
        F.when(F.col("event_type") == "purchase", F.col("price")).otherwise(F.lit(0).cast("decimal(18,2)")))


CLEAN_COLUMNS = ["user_id", "user_session", "event_type", "product_id", "brand", "category_code",
                 "price", "event_time", "hour", "weekday", "month", "event_period", "session_start",
                 "time_since_start", "prev_event_gap", "purchase_spending"]


def clean_base(df: DataFrame, dedupe: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Everything but the per-session ordering (C7-C9),
    which no feature table needs.  ``dedupe=False``: the rows were already
    deduplicated on all their raw columns.  ``keep``: further columns that stay."""
    out = dedupe_events(df) if dedupe else df
    out = drop_null_sessions(out)
    out = fill_brand(out)
    out = coerce_event_time(out)
    out = add_time_parts(out)
    out = add_event_period(out)
    out = add_purchase_spending(out)
    return out.select(*[c for c in CLEAN_COLUMNS if c in out.columns], *keep)


def clean_events(df: DataFrame, with_clock: bool = True, dedupe: bool = True) -> DataFrame:
    """C1-C10 in the reference order."""
    base = clean_base(df, dedupe)
    if not with_clock:
        return base
    return add_session_clock(base).select(*CLEAN_COLUMNS)


def event_gaps(clean: DataFrame) -> DataFrame:
    """q event_gaps: per-event session clock columns."""
    return clean.select("user_session", "event_time", "product_id", "event_type",
                        "session_start", "time_since_start", "prev_event_gap")

"""IO1 event scans and IO5 cleaned sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.schema import EVENTS_RAW_CSV


def read_events(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Raw event log: every column of the file, values as written.

    C1 removes rows that are equal in *all* columns, so nothing is dropped or
    rounded here; ``typed_events`` projects and casts after the dedupe.  CSV
    fields are text.
    """
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def typed_events(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The eight analysis columns in their fixed types, matched by name, and
    the columns of ``keep`` as they are.

    A malformed number becomes null, not an error; ``event_time`` keeps its
    type for the cleaning step to parse.
    """
    return df.select(*[(F.col(f.name) if f.name == "event_time" else F.col(f.name).try_cast(f.dataType)).alias(f.name)
                       for f in EVENTS_RAW_CSV.fields], *keep)


def read_distinct_events(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """IO1 then C1: whole rows deduplicated as written, then typed.

    The rows that come out may be equal in the typed columns (they differed
    elsewhere) and must all stay: use ``clean_base(..., dedupe=False)``.
    """
    return typed_events(read_events(spark, path, fmt).dropDuplicates())


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """IO2: cleaned events as written by ``write_clean``."""
    return spark.read.parquet(path)


def write_clean(df: DataFrame, path: str, partition_by: str | None = "event_date",
                options: dict[str, str] | None = None) -> None:
    """IO5: overwrite the cleaned table, a folder per event date, so date
    filters (D6) prune whole folders.

    Rows are dealt by date with a rebalancing shuffle: adaptive execution
    splits a date (or the rows without time, which have none) by its measured
    bytes and puts small dates together, towards
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` a file.  Inside a file
    rows are clustered by brand, category and time, and both columns have
    Bloom filters, so brand and category filters skip row groups.  ``options``
    go to the parquet writer.
    """
    clustered = [c for c in ("brand", "category_code", "event_time") if c in df.columns]
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in clustered if c != "event_time"} | (options or {})
    if not partition_by:
        df.write.mode("overwrite").options(**blooms).parquet(path)
        return
    if partition_by not in df.columns and partition_by == "event_date":
        df = df.withColumn("event_date", F.to_date("event_time"))
    rows = df.hint("rebalance", partition_by).sortWithinPartitions(partition_by, *clustered)
    rows.write.mode("overwrite").options(**blooms).partitionBy(partition_by).parquet(path)

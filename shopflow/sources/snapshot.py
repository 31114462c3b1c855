"""IO9/IO10: versioned snapshot directories.

The reference downloads a pickled package over HTTP; here a snapshot is a
directory of parquet tables that any executor can read.  Every version has a
folder of its own, and its manifest, one row per table with the row count, is
written last: a version without one was not finished and is never read.
Timestamps stored as text are restored on load, unparseable text becoming
null.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_TABLES = ("sessions", "users", "brands", "categories", "cleaned", "summary")
_TIME_COLUMNS = {"sessions": ("session_started_at", "session_ended_at"), "cleaned": ("event_time",)}
_MANIFEST = "version string, table string, n_rows bigint"


def _restore(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.try_to_timestamp(F.col(c)).cast(T.TimestampNTZType()))
    return df


def _folder(path: str, version: str, table: str) -> str:
    return f"{path.rstrip('/')}/versions/{version}/{table}"


def write_snapshot(tables: dict[str, DataFrame], path: str, version: str | None = None) -> str:
    """Write a version (tables first, manifest last) and return its name.

    ``version`` names sort by age; by default it is the UTC time.
    """
    unknown = sorted(set(tables) - set(SNAPSHOT_TABLES))
    if unknown:
        raise ValueError(f"Not tables of a snapshot: {unknown}")
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(_folder(path, version, name))
        rows.append((version, name, spark.read.parquet(_folder(path, version, name)).count()))
    (spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite")
          .json(f"{path.rstrip('/')}/manifests/{version}"))
    return version


def snapshot_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, table, n_rows) of all finished versions."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path.rstrip('/')}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def load_snapshot(spark: SparkSession, path: str, version: str | None = None,
                  require: Iterable[str] = ()) -> dict[str, DataFrame]:
    """Tables of the newest finished version (or of ``version``).

    Raises when there is no finished version, and names the tables of
    ``require`` that it lacks.
    """
    manifest = snapshot_manifest(spark, path)
    newest = version or manifest.agg(F.max("version")).first()[0]
    names = [r["table"] for r in manifest.where(F.col("version") == newest).select("table").collect()] if newest else []
    if not names:
        raise ValueError(f"No finished snapshot {version or ''} under {path}")
    lacking = [t for t in require if t not in names]
    if lacking:
        raise ValueError(f"Snapshot {newest} lacks tables: {lacking}")
    return {name: _restore(spark.read.parquet(_folder(path, newest, name)), _TIME_COLUMNS.get(name, ()))
            for name in SNAPSHOT_TABLES if name in names}


def snapshot_status(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """IO10: totals and the snapshot date (first 10 characters of the
    latest session end)."""
    s = sessions.agg(F.count(F.lit(1)).alias("total_sessions"),
                     F.substring(F.max("session_ended_at").cast("string"), 1, 10).alias("created_at"))
    u = users.agg(F.count(F.lit(1)).alias("total_users"))
    from shopflow.operators.common import zip_one_row
    return zip_one_row(s, u).select("total_sessions", "total_users", "created_at")

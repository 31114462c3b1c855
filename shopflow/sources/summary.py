"""IO4/IO7 summary JSON and IO8 report sheets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions.numeric import present


FUNNEL_COUNTS = ("total_sessions", "sessions_with_views", "sessions_with_carts", "sessions_with_purchases")
FUNNEL_RATES = ("view_to_cart", "cart_to_purchase", "view_to_purchase")


def write_summary(summary: DataFrame, output_dir: str, tag: str) -> str:
    """IO7: the one-row ``{generated_at, tag, summary}`` frame as JSON at
    ``output_dir/summary_<tag>``.  One row, so one file."""
    path = f"{output_dir.rstrip('/')}/summary_{tag}"
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """IO4: the baseline part of a stored summary, by a fixed schema.

    A document without ``summary``, ``funnel`` or one of the rates reads as
    null there instead of failing.
    """
    funnel = ", ".join([f"{k}: bigint" for k in FUNNEL_COUNTS] + [f"{k}: double" for k in FUNNEL_RATES])
    return spark.read.option("multiLine", True).schema(
        f"generated_at string, tag string, summary struct<funnel: struct<{funnel}>, insights: array<string>>").json(path)


def baseline_funnel(summary: DataFrame) -> DataFrame:
    """The three funnel rates of a stored summary as one row; no row when it
    has no funnel (then there are no alerts), 0 for a rate it lacks."""
    return (summary.where(F.col("summary.funnel").isNotNull())
                   .select(*[F.coalesce(F.col(f"summary.funnel.{k}"), F.lit(0.0)).alias(k) for k in FUNNEL_RATES]).limit(1))


def _sheet_dir(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_-]+", "_", name).strip("_") or "sheet"


def write_report(sheets: dict[str, DataFrame], output_dir: str, tag: str, fmt: str = "parquet") -> dict[str, str]:
    """IO8: one table per named sheet under ``output_dir/report/<tag>/``
    (time zones dropped, money as double).  CSV gets a header."""
    paths = {}
    for name, df in sheets.items():
        path = f"{output_dir.rstrip('/')}/report/{tag}/{_sheet_dir(name)}"
        w = present(df).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.format(fmt).save(path)
        paths[name] = path
    return paths

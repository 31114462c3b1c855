"""A1-A3: conversion funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut, keep_all_labels
from shopflow.functions.numeric import mean_exact, safe_ratio
from shopflow.operators.common import requires
from shopflow.schema import DURATION_BINS, DURATION_LABELS, MAX_SESSION_DURATION_MINUTES


def funnel_count_aggs() -> list:
    """A1 aggregate expressions over session features."""
    return [
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("view_count") > 0).alias("sessions_with_views"),
        F.count_if(F.col("cart_count") > 0).alias("sessions_with_carts"),
        F.count_if(F.col("purchase_count") > 0).alias("sessions_with_purchases"),
    ]


def funnel_rate_cols() -> list:
    """A2 from the A1 columns: a zero denominator gives 0 (rates may exceed 1)."""
    v, ca, p = F.col("sessions_with_views"), F.col("sessions_with_carts"), F.col("sessions_with_purchases")
    return [safe_ratio(ca, v).alias("view_to_cart"), safe_ratio(p, ca).alias("cart_to_purchase"),
            safe_ratio(p, v).alias("view_to_purchase")]


@requires(sessions=["view_count", "cart_count", "purchase_count"])
def funnel_counts(sessions: DataFrame) -> DataFrame:
    """A1: one row of session counts."""
    return sessions.agg(*funnel_count_aggs())


def funnel_rates(sessions: DataFrame) -> DataFrame:
    """A2: step rates."""
    return funnel_counts(sessions).select(*funnel_rate_cols())


def duration_bucket(duration_seconds) -> object:
    minutes = F.least(duration_seconds / F.lit(60.0), F.lit(float(MAX_SESSION_DURATION_MINUTES)))
    return cut(minutes, DURATION_BINS, DURATION_LABELS, right=True)


@requires(sessions=["session_duration", "view_to_purchase_rate"])
def duration_conversion(sessions: DataFrame) -> DataFrame:
    """A3: mean session rate per clipped-duration bucket; empty bucket -> 0."""
    agg = (sessions.withColumn("duration_category", duration_bucket(F.col("session_duration")))
           .where(F.col("duration_category").isNotNull())
           .groupBy("duration_category")
           .agg(mean_exact(F.col("view_to_purchase_rate")).alias("view_to_purchase_rate")))
    return keep_all_labels(agg, DURATION_LABELS, "duration_category", {"view_to_purchase_rate": 0.0})

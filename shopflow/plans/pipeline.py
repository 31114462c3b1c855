"""IO11: the staged batch job (clean -> features -> summary).

Each stage writes its tables; a skipped stage reads what an earlier run
wrote.  Every stage is a lazy plan executed by its write, so a lost
executor only re-runs the tasks of the stage being written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shopflow.operators.clean import clean_events
from shopflow.operators.features import (
    brand_features, category_features, session_features, user_features,
)
from shopflow.plans.context import ShopContext
from shopflow.plans.summary import build_summary
from shopflow.schema import EVENT_TYPES
from shopflow.sources.events import read_clean, read_distinct_events, write_clean
from shopflow.sources.features import read_features, write_features
from shopflow.sources.summary import baseline_funnel, read_summary, write_summary


@dataclass
class PipelineConfig:
    base_path: str                 # holds data/raw, data/cleaned, data/features
    output: str                    # summary folder
    tag: str
    raw_path: str | None = None    # defaults to base_path/data/raw/events.csv
    raw_format: str = "csv"
    baseline: str | None = None    # an earlier summary folder
    skip_clean: bool = False
    skip_features: bool = False
    partition_by: str | None = "event_date"
    event_types: tuple = EVENT_TYPES


def _cleaned_path(cfg: PipelineConfig) -> str:
    return f"{cfg.base_path.rstrip('/')}/data/cleaned/events"


def run_cleaning(spark: SparkSession, cfg: PipelineConfig) -> None:
    raw_path = cfg.raw_path or f"{cfg.base_path.rstrip('/')}/data/raw/events.csv"
    raw = read_distinct_events(spark, raw_path, cfg.raw_format)
    write_clean(clean_events(raw, dedupe=False), _cleaned_path(cfg), cfg.partition_by)


def run_features(spark: SparkSession, cfg: PipelineConfig) -> None:
    events = read_clean(spark, _cleaned_path(cfg))
    sessions = session_features(events, cfg.event_types)
    tables = {"session_features": sessions}
    write_features(tables, cfg.base_path)
    sessions = read_features_one(spark, cfg, "session_features")
    write_features({"user_features": user_features(sessions),
                    "brand_features": brand_features(events, cfg.event_types),
                    "category_features": category_features(events, cfg.event_types)}, cfg.base_path)


def read_features_one(spark: SparkSession, cfg: PipelineConfig, name: str) -> DataFrame:
    return spark.read.parquet(f"{cfg.base_path.rstrip('/')}/data/features/{name}")


class FeatureContext(ShopContext):
    """A context whose stage tables are the feature tables on disk."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], events: DataFrame | None):
        super().__init__(spark, lambda: events, materialize=False)
        self._tables.update({"session_features": tables["session_features"],
                             "user_features": tables["user_features"],
                             "brand_features": tables["brand_features"],
                             "category_features": tables["category_features"]})
        if events is not None:
            self._tables["events_base"] = events


def run_pipeline(spark: SparkSession, cfg: PipelineConfig) -> str:
    """Run the enabled stages, then write ``summary_<tag>``; returns its path."""
    if not cfg.skip_clean:
        run_cleaning(spark, cfg)
    if not cfg.skip_features:
        run_features(spark, cfg)
    tables = read_features(spark, cfg.base_path)
    ctx = FeatureContext(spark, tables, None)
    baseline = baseline_funnel(read_summary(spark, cfg.baseline)) if cfg.baseline else None
    summary = build_summary(ctx, tag=cfg.tag, baseline=baseline)
    return write_summary(summary, cfg.output, cfg.tag)

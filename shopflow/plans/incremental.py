"""IO11, incremental: new raw files are merged into the cleaned and feature tables.

A run takes the raw files that no finished run has read.  Their rows change
only the sessions they belong to, so the run

1. cleans the new rows, drops those that an earlier file already had (by the
   digest of the whole raw row, kept in the cleaned table), and computes the
   session clock again for the touched sessions alone;
2. rewrites the date folders in which touched sessions have rows, by dynamic
   partition overwrite, and leaves all other folders as they are;
3. computes features again for the touched sessions, their users, and the
   brands and categories of the new rows.

Every run has a folder of its own under ``data/runs``.  What replaces table
contents is written there first and then a mark; putting it in place can be
repeated, so a run that broke off after its mark is carried through by the
next call, and one that broke off before it left the tables untouched.  The
last mark lists the files read.

Defined results: no new file changes nothing; rows without session are dropped
as in a full run; a processed file that was changed or removed raises, for then
only a full run is right; rows without time are in one folder of their own.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.clean import CLEAN_COLUMNS, add_session_clock, clean_base
from shopflow.operators.features import (
    brand_features, category_features, session_features, user_features,
)
from shopflow.plans.pipeline import PipelineConfig, _cleaned_path, run_pipeline
from shopflow.sources.events import read_events, typed_events, write_clean
from shopflow.sources.features import write_features

_FILES = "path string, length bigint, modified timestamp"
_DIGEST = "row_digest"
_KEYS = {"user_features": "user_id", "brand_features": "brand", "category_features": "category_code"}


# -- files and marks -----------------------------------------------------------
def _read(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _runs(cfg: PipelineConfig) -> str:
    return f"{cfg.base_path.rstrip('/')}/data/runs"


def _raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the raw files; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _mark(files: DataFrame, cfg: PipelineConfig, kind: str, run: str) -> None:
    """A mark of a run: its file list, written when all it vouches for is."""
    files.withColumn("run", F.lit(run)).coalesce(1).write.mode("overwrite").parquet(f"{_runs(cfg)}/{kind}/{run}")


def _marked(spark: SparkSession, cfg: PipelineConfig, kind: str) -> DataFrame | None:
    return _read(spark, f"{_runs(cfg)}/{kind}/*", f"{_FILES}, run string")


def _run_names(marks: DataFrame | None) -> set[str]:
    return {r.run for r in marks.select("run").distinct().collect()} if marks is not None else set()


def new_files(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """Raw files that no finished run has read."""
    files = _raw_files(spark, cfg.raw_path or f"{cfg.base_path.rstrip('/')}/data/raw/events.csv")
    done = _marked(spark, cfg, "finished")
    if done is None:
        return files
    done = done.drop("run")
    changed = [r.path for r in done.join(files, ["path", "length", "modified"], "left_anti").limit(5).collect()]
    if changed:
        raise ValueError(f"Files read by an earlier run were changed or removed, a full run is needed: {changed}")
    return files.join(done, ["path"], "left_anti")


# -- rows ------------------------------------------------------------------------
def row_digest(columns: list[str]) -> Column:
    """128-bit digest of a raw row: its set columns with their names, in the names' order."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])))


def _with_keys(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` with (left_semi) or without (left_anti) the rows of ``keys``; nulls are equal."""
    keys = keys.select(F.col(key).alias("_key"))
    return df.join(keys, F.col(key).eqNullSafe(F.col("_key")), how)


def _stage_events(spark: SparkSession, cfg: PipelineConfig, run: str, paths: list[str]) -> None:
    """Write the run's ``added`` rows, ``touched`` sessions and the new contents of their date folders."""
    here = f"{_runs(cfg)}/staged/{run}"
    raw = read_events(spark, paths, cfg.raw_format).dropDuplicates()
    raw = raw.withColumn(_DIGEST, row_digest(raw.columns)).where(F.col("user_session").isNotNull())
    raw.write.mode("overwrite").parquet(f"{here}/raw")
    raw = spark.read.parquet(f"{here}/raw")
    rows = clean_base(typed_events(raw, keep=[_DIGEST]), dedupe=False, keep=[_DIGEST])
    raw.select("user_session").distinct().write.mode("overwrite").parquet(f"{here}/touched")
    touched = spark.read.parquet(f"{here}/touched")
    old = _read(spark, _cleaned_path(cfg))
    base = rows.columns
    if old is not None:
        before = _with_keys(old, touched, "user_session", "left_semi").select(*base)
        rows = rows.join(before.select("user_session", _DIGEST), ["user_session", _DIGEST], "left_anti").select(*base)
    rows.write.mode("overwrite").parquet(f"{here}/added")
    rows = spark.read.parquet(f"{here}/added")
    # Copies of rows already there touch nothing.
    touched = rows.select("user_session").distinct()
    if old is not None:
        before = _with_keys(old, touched, "user_session", "left_semi").select(*base)
        rows = rows.unionByName(before)
    clocked = add_session_clock(rows).select(*CLEAN_COLUMNS, _DIGEST).withColumn("event_date", F.to_date("event_time"))
    clocked.write.mode("overwrite").parquet(f"{here}/sessions")
    clocked = spark.read.parquet(f"{here}/sessions")
    out = clocked
    if old is not None:
        # As many values as the touched sessions have days: they choose the folders to read.
        days = [r.event_date for r in clocked.select("event_date").distinct().collect()]
        inside = F.col("event_date").isin([d for d in days if d is not None]) | (F.col("event_date").isNull() & F.lit(None in days))
        rest = _with_keys(old.where(inside), touched, "user_session", "left_anti")
        out = out.unionByName(rest.select(*out.columns))
    out.write.mode("overwrite").parquet(f"{here}/events")


def _stage_features(spark: SparkSession, cfg: PipelineConfig, run: str) -> None:
    """Write the new feature tables of the run; only what its rows touch is computed."""
    here, base = f"{_runs(cfg)}/staged/{run}", f"{cfg.base_path.rstrip('/')}/data/features"
    touched_rows, added = spark.read.parquet(f"{here}/sessions"), spark.read.parquet(f"{here}/added")
    events = spark.read.parquet(_cleaned_path(cfg))
    old = {name: _read(spark, f"{base}/{name}") for name in ("session_features", *_KEYS)}

    def put(name: str, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        out = fresh if old[name] is None else fresh.unionByName(_with_keys(old[name], keys, key, "left_anti"))
        write_features({name: out}, here)
        return spark.read.parquet(f"{here}/data/features/{name}")

    fresh = session_features(touched_rows, cfg.event_types)
    touched = touched_rows.select("user_session").distinct()
    sessions = put("session_features", fresh, touched, "user_session")
    users = _with_keys(sessions, touched, "user_session", "left_semi").select("user_id")
    if old["session_features"] is not None:    # a session's first user may have changed
        users = users.unionByName(_with_keys(old["session_features"], touched, "user_session", "left_semi").select("user_id"))
    users = users.distinct()
    # A former user of a session may have none left.
    put("user_features", user_features(_with_keys(sessions, users, "user_id", "left_semi")), users, "user_id")
    for name, build in (("brand_features", brand_features), ("category_features", category_features)):
        keys = added.select(_KEYS[name]).distinct()
        put(name, build(_with_keys(events, keys, _KEYS[name], "left_semi"), cfg.event_types), keys, _KEYS[name])


# -- the run -----------------------------------------------------------------------
def _carry_through(spark: SparkSession, cfg: PipelineConfig, run: str) -> None:
    """Put a run's staged contents in place; may be repeated."""
    here = f"{_runs(cfg)}/staged/{run}"
    files = spark.read.schema(_FILES).parquet(f"{_runs(cfg)}/events_ready/{run}")
    if run not in _run_names(_marked(spark, cfg, "features_ready")):
        write_clean(spark.read.parquet(f"{here}/events"), _cleaned_path(cfg), options={"partitionOverwriteMode": "dynamic"})
        _stage_features(spark, cfg, run)
        _mark(files, cfg, "features_ready", run)
    write_features({name: spark.read.parquet(f"{here}/data/features/{name}") for name in ("session_features", *_KEYS)}, cfg.base_path)
    _mark(files, cfg, "finished", run)


def update_tables(spark: SparkSession, cfg: PipelineConfig) -> int:
    """Bring the cleaned and feature tables up to date; returns how many new files were read."""
    if cfg.partition_by != "event_date":
        raise ValueError("Incremental runs need the cleaned table by event_date")
    for run in sorted(_run_names(_marked(spark, cfg, "events_ready")) - _run_names(_marked(spark, cfg, "finished"))):
        _carry_through(spark, cfg, run)
    # The list of new files is the driver's, as for every scan.
    files = [tuple(r) for r in new_files(spark, cfg).select("path", "length", "modified").collect()]
    if not files:
        return 0
    run = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    _stage_events(spark, cfg, run, [f[0] for f in files])
    _mark(spark.createDataFrame(files, _FILES), cfg, "events_ready", run)
    _carry_through(spark, cfg, run)
    return len(files)


def run_incremental(spark: SparkSession, cfg: PipelineConfig) -> str:
    """``update_tables``, then the summary over the feature tables; returns its path."""
    update_tables(spark, cfg)
    return run_pipeline(spark, replace(cfg, skip_clean=True, skip_features=True))

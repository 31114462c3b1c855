"""Structured Streaming ingest of raw event files into the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shopflow.operators.clean import clean_base
from shopflow.schema import EVENTS_RAW_CSV
from shopflow.sources.events import typed_events


def start_ingest(spark: SparkSession, source_dir: str, cleaned_dir: str, checkpoint_dir: str,
                 fmt: str = "csv", trigger_once: bool = False) -> StreamingQuery:
    """Watch ``source_dir`` for new event files; each micro-batch is cleaned
    (C1-C6, C10: duplicates inside the batch removed, null sessions dropped,
    brand filled, times parsed) and written to its own folder
    ``batch_id=<n>`` of ``cleaned_dir``.  Copies of a row in different
    batches are left to the batch stage's C1.

    The per-session clock (C7-C9) needs whole sessions and stays in the
    batch stage.  Progress lives in ``checkpoint_dir`` (a shared folder),
    so a restarted query resumes at the first unprocessed file.
    """
    if fmt == "csv":
        # A CSV stream assigns its schema by position, so the columns (all as
        # text) are taken from the header of the files that are there.
        columns = spark.read.option("header", True).csv(source_dir).columns
        reader = spark.readStream.option("header", True).schema(", ".join(f"`{c}` string" for c in columns))
    else:
        reader = spark.readStream.schema(EVENTS_RAW_CSV)
    stream = reader.format(fmt).load(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch replaces its own folder, so it adds no row twice.
        rows = clean_base(typed_events(batch.dropDuplicates()), dedupe=False)
        rows.write.mode("overwrite").parquet(f"{cleaned_dir.rstrip('/')}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()

"""Spark session helpers.

``get_spark`` builds a session for scripts and tests.  Library code never
builds sessions; it only reads two things from the one it is given: the
shared folder for stage tables (``spark.checkpoint.dir``) and the shuffle
partition count.
"""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


def get_spark(master: str | None = None, app_name: str = "shopflow",
              shuffle_partitions: int | None = None,
              extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    AQE stays on so small shuffles coalesce and skewed join partitions get
    split at run time; the UI is off (no server).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or os.environ.get("SHOPFLOW_MASTER") or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus) * 2),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.driver.memory": os.environ.get("SHOPFLOW_DRIVER_MEMORY", "16g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for stage tables that every executor can read.

    This is the folder named by ``spark.checkpoint.dir``.  A session on a
    cluster must have one: executors cannot see each other's disks.  Only a
    session whose executors are threads of this process (``local[...]``)
    gets a private folder when it has none.
    """
    with _LOCK:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            path = spark.conf.get("spark.checkpoint.dir", None)
            if not path:
                if not sc.master.split("[")[0] == "local":
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                path = tempfile.mkdtemp(prefix="shopflow-ckpt-")
            sc.setCheckpointDir(path)
            path = sc.getCheckpointDir() or path
        return path.rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Tasks of a stage table's plan stay small whatever the table's size: shuffles
#: begin with many partitions, which adaptive execution joins up to the advisory
#: size, so what a task sorts or aggregates fits its memory and is not spilled.
SMALL_TASKS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20),
    "spark.sql.files.maxPartitionBytes": str(16 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_stage(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a stage table in small tasks."""
    with settings(df.sparkSession, SMALL_TASKS):
        df.select("*").write.mode(mode).parquet(path)  # a plan of its own, planned under these settings

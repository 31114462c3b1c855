"""Helpers shared by the operators of this package.

Text work that Spark's built-in functions cannot express runs in Arrow
batches inside tasks.  The helpers here turn a batch's text column into one
flat byte array and find words and their hashes with array operations, so a
task never loops over characters and never holds more than ``CHUNK_BYTES``
of text (or one document, if that is longer) in working arrays.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.session import settings, shared_dir

CHUNK_BYTES = 1 << 20

#: Broadcast sides are counted first; beyond this many rows the join shuffles.
BROADCAST_ROWS = 500_000


# -- tables and stage files ------------------------------------------------
def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folder of the tables that are written now, in the application's own.
_SCOPE = ["tables"]


def _scope_dir(spark: SparkSession, scope: str = "") -> str:
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{scope}".rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's shared folder."""
    return f"{_scope_dir(spark, _SCOPE[0])}/{uuid.uuid4().hex[:12]}/{name}"


def begin_scope(spark: SparkSession, scope: str, ended: Sequence[str] = ()) -> None:
    """Write the following tables under ``scope`` and delete those of the
    ``ended`` ones, whose results are written and need them no more."""
    _SCOPE[0] = scope
    for name in ended:
        if name != scope:
            _delete(spark, _scope_dir(spark, name))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files of a written query may go when it ends: the written table is
#: what later work reads.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Batches that carry whole rows through Python stay small: Spark and the Python
#: worker each hold one, and the working arrays take ``CHUNK_BYTES`` at a time.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the file instead of repeating
    the work, and values that depend on partitioning stay as written.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    with settings(spark, {_DROP_SHUFFLES: "true"}):
        df.select("*").write.parquet(path)  # a plan of its own, planned under this setting
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's stage tables (call when results are written)."""
    _delete(spark, _scope_dir(spark))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (narrow) table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow table whose row count was checked; otherwise
    the join is left to a shuffle that adaptive execution may split."""
    return F.broadcast(df) if small_enough(df, rows) else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused_name(df_columns: Sequence[str], base: str) -> str:
    """A column name that clashes with none of ``df_columns`` (any letter case)."""
    taken = {c.lower() for c in df_columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def prefix_sums(df: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """(key, value, out): ``out`` sums ``value`` over all smaller keys.

    ``key`` is a dense non-negative integer with one row each.  Two levels of
    windows: one per block of keys, one over the block totals, so the single
    ordered window sees a thousandth of the rows.
    """
    from pyspark.sql import Window
    rows = df.select(key, value, F.floor(F.col(key) / block).alias("_block"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (df.groupBy(F.floor(F.col(key) / block).alias("_block")).agg(F.sum(value).alias("_t"))
                .select("_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before")))
    return rows.join(blocks, "_block").select(key, value, (F.col("_in") + F.col("_before")).cast("bigint").alias(out))


# -- flat text ---------------------------------------------------------------
def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    arr = column
    if arr.null_count:
        arr = arr.fill_null("")
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        off_type = np.int64
    else:
        off_type = np.int32
    bufs = arr.buffers()
    if len(arr) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(bufs[1], off_type)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = (np.frombuffer(bufs[2], np.uint8)[offs[0]:offs[-1]] if bufs[2] is not None and offs[-1] > offs[0]
            else np.zeros(0, np.uint8))
    return data, offs - offs[0]


def row_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    _, offs = flat_utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_chunks(batch, text)


def give_back() -> None:
    """Return this worker's free memory to the system at the end of a task:
    workers are kept for other tasks, and what their allocators hold on to
    counts against the executor meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
    if trim:
        trim(0)


def field_index(columns: Sequence[str], name: str) -> int:
    """Place of a column, matched as Spark does (any letter case)."""
    return [c.lower() for c in columns].index(name.lower())


def texts_of_rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches with a first column ``text``, the field ``at`` of their struct
    ``row``: a text that goes along with its whole row crosses to Python once."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row").field(at), *batch.columns], names=["text", *batch.schema.names])


# -- words and hashes ----------------------------------------------------------
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, made where they are used."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()

    def up_to(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) <= n:
            for i, b in enumerate((_BASE, _BASE_INV)):
                p = np.full(max(n + 1, CHUNK_BYTES + 1), b, np.uint64)
                p[0] = 1
                self.tables[i] = np.cumprod(p)
        return self.tables


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (constants of the public splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (per-position 64-bit codes).

    A polynomial over prefix sums: the value of a span does not depend on
    where it stands.
    """
    power, inverse = _POWERS.up_to(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a flat text: maximal runs of bytes outside ``space``.

    ``start``/``end``: byte spans; ``first``: index of each document's first
    word (one more entry than documents); ``doc``: document of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        n = len(data)
        inside = ~space[data] if n else np.zeros(0, bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        finishes = inside.copy()
        if n:
            finishes[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, data: np.ndarray, lower: bool = False) -> np.ndarray:
        return span_hashes((_BYTE_LOWER if lower else _BYTE)[data], self.start, self.end)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte position (0..len)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out

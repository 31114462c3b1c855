"""Skew-safe ordered scans (K4 and the session clock of C7/C9).

A window with ``partitionBy(key)`` puts every row of a key into one task,
and a window with no partition key puts the whole table into one task.
Both break when one key holds a third of all rows.  The kernels below
range-partition on the full sort order instead: Spark samples the order
columns, so a hot key, even one whose rows share a timestamp or have none,
is split across several balanced ranges.  The ranged rows are written once,
in order, to the shared folder; what crosses a range boundary is carried by
a table with one row per range.  One method serves every key and size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.session import shared_dir, write_stage

PID = "_pid"
_ORDINAL_BITS = 33  # of monotonically_increasing_id: the place within a partition


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/shopflow/ordered/{uuid.uuid4().hex}"
    write_stage(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_range(df: DataFrame, order: Sequence[Column], num_partitions: int | None) -> DataFrame:
    """Rows in sorted ranges: as many as wanted, else as their size asks for."""
    n = [num_partitions] if num_partitions else []
    return df.repartitionByRange(*n, *order).sortWithinPartitions(*order)


def ranged(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with the range number
    ``_pid`` (ascending in ``order``) and the 0-based place ``_at`` in it;
    written once, so every later reader sees the same ranges."""
    rows = _by_range(df, order, num_partitions).withColumn("_id", F.monotonically_increasing_id())
    return _written(rows.withColumn(PID, F.shiftright("_id", _ORDINAL_BITS).cast("int"))
                        .withColumn("_at", F.col("_id").bitwiseAND((1 << _ORDINAL_BITS) - 1)).drop("_id"))


_LIMB = np.int64(32)
_LOW = np.int64(0xFFFFFFFF)


class _Running:
    """Running sums of one column over the batches of a sorted range.

    Decimals and whole numbers add up exactly: a 128-bit value is four 32-bit
    limbs, whose prefix sums are array operations, with carries passed on at
    the end of a batch.  Nulls count as 0.
    """

    def __init__(self, kind: pa.DataType):
        self.kind = kind
        self.exact = not pa.types.is_floating(kind)
        self.carry = np.zeros(4, np.int64) if self.exact else 0.0

    def add(self, column: pa.Array) -> pa.Array:
        if not self.exact:
            total = np.cumsum(np.concatenate(([self.carry], column.fill_null(0).to_numpy(zero_copy_only=False))))[1:]
            self.carry = float(total[-1]) if len(total) else self.carry
            return pa.array(total, self.kind)
        n, wide = len(column), pa.decimal128(38, self.kind.scale if pa.types.is_decimal(self.kind) else 0)
        if not n:
            return column.cast(wide)
        value = column.cast(wide).fill_null(0) if column.null_count else column.cast(wide)
        limbs = np.frombuffer(value.buffers()[1], np.uint32)[4 * value.offset:4 * (value.offset + n)].reshape(n, 4).astype(np.int64)
        limbs[:, 3] = limbs[:, 3].astype(np.uint32).view(np.int32)  # the sign
        total = np.cumsum(limbs, axis=0) + self.carry
        for i in range(3):
            total[:, i + 1] += total[:, i] >> _LIMB
            total[:, i] &= _LOW
        self.carry = total[-1].copy()
        return pa.Array.from_buffers(wide, n, [None, pa.py_buffer((total & _LOW).astype(np.uint32).tobytes())])


def _running_rows(sums: Sequence[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted range with its number, each row's place and the sums up to it."""
        own, at, running = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            names, n = batch.schema.names, batch.num_rows
            if running is None:
                running = [_Running(batch.schema.field(s).type) for s in sums]
            extra = [r.add(batch.column(names.index(s))) for s, r in zip(sums, running)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(at, at + n)), *extra],
                names=[*names, PID, "_at", *[f"_run_{s}" for s in sums]])
            at += n
    return rows


def _sum_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return kind
    return T.DecimalType(38, kind.scale if isinstance(kind, T.DecimalType) else 0)


def global_order(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (),
                 rank_col: str = "_rank", num_partitions: int | None = None) -> DataFrame:
    """Attach a 1-based global rank and running sums in ``order``, plus the
    row count ``_n_total`` and grand totals ``total_<col>``.

    ``order`` must be a total order (end it with a unique key) so ties are
    deterministic and the range partitioner can split runs of equal values.
    Running sums are inclusive of the current row; nulls add nothing.  The
    rows are shuffled once: places and sums are carried along in the one scan
    of the sorted range, and a row per range holds what lies before it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField("_at", T.LongType()),
                           *[T.StructField(f"_run_{s}", _sum_type(df.schema[s].dataType)) for s in sums]])
    r = _written(_by_range(df, order, num_partitions).mapInArrow(_running_rows(sums), schema))
    totals = r.groupBy(PID).agg(
        F.count(F.lit(1)).alias("_cnt"), *[F.max_by(f"_run_{s}", "_at").alias(f"_tot_{s}") for s in sums])
    # One row per range: bounded by the partition count, so a single-task
    # window and a broadcast are both safe here.
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        PID,
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        F.sum("_cnt").over(everything).alias("_n_total"),
        *[F.sum(f"_tot_{s}").over(everything).alias(f"total_{s}") for s in sums])
    out = r.join(F.broadcast(offsets), on=PID, how="inner")
    out = out.withColumn(rank_col, F.col("_off") + F.col("_at") + 1)
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_off_{s}") + F.col(f"_run_{s}"))
    drop = [PID, "_at", "_off"] + [f"_run_{s}" for s in sums] + [f"_off_{s}" for s in sums]
    return out.drop(*drop)


def _clock_rows(key: str, time_col: str, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Previous row's time and the key's first time, as far as this range knows."""
        own, at = TaskContext.get().partitionId(), 0
        last_key = last_time = first_time = None
        head = True  # still inside the range's first key
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, times = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(time_col))
            before = pa.concat_arrays([pa.array([last_key], keys.type), keys.slice(0, n - 1)])
            same = pc.fill_null(pc.equal(keys, before), False)
            if not at:
                same = pc.if_else(pa.array(np.arange(n) == 0), False, same)
            prev = pa.concat_arrays([pa.array([last_time], times.type), times.slice(0, n - 1)])
            # Forward-fill the time at which the key's run began.
            began = pc.if_else(same, pa.scalar(None, pa.int64()), pa.array(np.arange(n)))
            filled = pc.fill_null_forward(began)
            carried = pc.is_null(filled)
            first = pc.if_else(carried, pa.scalar(first_time, times.type), times.take(pc.fill_null(filled, 0)))
            new_runs = pc.cumulative_sum(pc.cast(pc.invert(same), pa.int64()))
            in_head = pc.less_equal(new_runs, 1 if not at else 0) if head else pa.array(np.zeros(n, bool))
            place = pa.array(np.arange(at, at + n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, own, np.int32)), place, pc.if_else(same, prev, pa.scalar(None, times.type)),
                 first, in_head], names=names)
            head = head and bool(in_head[n - 1].as_py())
            last_key, last_time, first_time = keys[n - 1].as_py(), times[n - 1].as_py(), first[n - 1].as_py()
            at += n
    return rows


def keyed_clock(df: DataFrame, key: str, time_col: str, order: Sequence[Column],
                num_partitions: int | None = None) -> DataFrame:
    """Per key: ``_key_first`` = min(time) and ``_prev_time`` = time of the
    previous row in ``order`` (null for the first row of a key).

    ``order`` starts with the time column (nulls last) and ends with enough
    columns to make it total within a key.  Rows are range-partitioned on
    (key, order), so any run of rows may be cut, and each range is scanned
    once in order.  Only the first key of a range can have begun before it:
    a table with one row per range carries the last time before the range
    and the first time of that key.
    """
    time_type = df.schema[time_col].dataType
    names = [*df.columns, PID, "_at", "_prev_local", "_first_local", "_head"]
    schema = T.StructType([*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField("_at", T.LongType()),
                           T.StructField("_prev_local", time_type), T.StructField("_first_local", time_type),
                           T.StructField("_head", T.BooleanType())])
    by = [F.col(key).asc(), *order]
    rows = _written(_by_range(df, by, num_partitions).mapInArrow(_clock_rows(key, time_col, names), schema))
    edge = F.struct(F.col(key).alias("key"), F.col(time_col).alias("time"), F.col("_first_local").alias("first"), "_head")
    ends = rows.groupBy(PID).agg(F.min_by(F.col(key), "_at").alias("first_key"), F.max_by(edge, "_at").alias("last"))
    # One row per range (bounded by the partition count).
    ranges = Window.orderBy(PID)
    joined = F.lag("last.key").over(ranges).eqNullSafe(F.col("first_key"))
    ends = ends.select(PID, "last", joined.alias("joined"), F.lag("last.time").over(ranges).alias("_carry"))
    # A range that is one key's middle knows no first time; take the nearest that does.
    knows = F.when(~(F.col("joined") & F.col("last._head")), F.struct(F.col("last.first").alias("t")))
    ends = ends.withColumn("known", F.last(knows, ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.select(PID, "joined", "_carry", F.lag("known").over(ranges).getField("t").alias("_began"))
    out = rows.join(F.broadcast(ends), PID)
    inside = F.col("_head") & F.col("joined")
    return (out.withColumn("_key_first", F.when(inside, F.col("_began")).otherwise(F.col("_first_local")))
               .withColumn("_prev_time", F.when(inside & (F.col("_at") == 0), F.col("_carry")).otherwise(F.col("_prev_local")))
               .drop(PID, "_at", "_prev_local", "_first_local", "_head", "joined", "_carry", "_began"))

"""K1 interval labels and K3 label tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lit(edge: float) -> Column:
    # Integral edges stay integral so a decimal column is compared exactly.
    if float(edge).is_integer():
        return F.lit(int(edge))
    return F.lit(float(edge))


def _interval_tests(col: Column, edges: Sequence[float], right: bool,
                    include_lowest: bool) -> list[Column]:
    tests = []
    last = len(edges) - 2
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        parts = []
        if not math.isinf(lo):
            if right:
                parts.append(col >= _lit(lo) if (include_lowest and i == 0) else col > _lit(lo))
            else:
                parts.append(col >= _lit(lo))
        if not math.isinf(hi):
            if right:
                parts.append(col <= _lit(hi))
            else:
                parts.append(col <= _lit(hi) if (include_lowest and i == last) else col < _lit(hi))
        test = parts[0] if parts else F.lit(True)
        for p in parts[1:]:
            test = test & p
        tests.append(test & col.isNotNull())
    return tests


def cut_ordinal(col: Column, edges: Sequence[float], right: bool = True,
                include_lowest: bool = False) -> Column:
    """0-based interval index of ``col`` in ``edges``; null outside or null."""
    expr = None
    for i, test in enumerate(_interval_tests(col, edges, right, include_lowest)):
        expr = F.when(test, F.lit(i)) if expr is None else expr.when(test, F.lit(i))
    return expr.otherwise(F.lit(None).cast(T.IntegerType()))


def cut(col: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True,
        include_lowest: bool = False) -> Column:
    """Interval label of ``col`` (pandas ``cut`` semantics); null outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("Bin labels must be one fewer than the number of bin edges")
    expr = None
    for label, test in zip(labels, _interval_tests(col, edges, right, include_lowest)):
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr.otherwise(F.lit(None).cast(T.StringType()))


def label_frame(spark: SparkSession, labels: Sequence[str], name: str,
                ordinal: str | None = None) -> DataFrame:
    """Tiny fixed table of labels (and their order) used to keep empty buckets."""
    rows = [(lab, i) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, T.StructType([
        T.StructField(name, T.StringType(), False),
        T.StructField(ordinal or f"{name}_order", T.IntegerType(), False),
    ]))
    return df if ordinal else df.select(name)


def keep_all_labels(agg: DataFrame, labels: Sequence[str], name: str,
                    fill: dict[str, object] | None = None) -> DataFrame:
    """Right side of a label-table left join: every label appears once.

    ``agg`` has at most one row per label, so both sides are bounded by the
    label count and the join is broadcast.
    """
    spark = agg.sparkSession
    out = label_frame(spark, labels, name).join(F.broadcast(agg), on=name, how="left")
    if fill:
        out = out.fillna(fill)
    return out

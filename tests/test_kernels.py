"""K1/K2/K5/K6 kernels and text helpers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopflow.functions.buckets import cut, keep_all_labels
from shopflow.functions.numeric import bround, safe_ratio, nan_to_null
from shopflow.functions.text import contains_literal, leaf_name, matches_regex
from shopflow.operators.binning import exact_quantiles, qcut_column
from shopflow.schema import (
    DURATION_BINS, DURATION_LABELS, EVENT_PERIOD_BINS, EVENT_PERIOD_LABELS, ORDER_VALUE_BINS,
    ORDER_VALUE_LABELS, TIME_PERIOD_BINS, TIME_PERIOD_LABELS, ACTIVITY_LEVEL_BINS, ACTIVITY_LEVEL_LABELS,
)


def _cut_vs_pandas(spark, values, edges, labels, right, include_lowest):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")
    got = [r[0] for r in df.select(cut(F.col("v"), edges, labels, right, include_lowest)).collect()]
    exp = pd.cut(pd.Series(values, dtype="float64"), bins=edges, labels=labels, right=right,
                 include_lowest=include_lowest)
    exp = [None if pd.isna(x) else str(x) for x in exp]
    assert got == exp


@pytest.mark.parametrize("edges,labels,right,low,values", [
    (EVENT_PERIOD_BINS, EVENT_PERIOD_LABELS, False, False, [0, 5, 6, 7, 11, 12, 13, 17, 18, 19, 23, None]),
    (TIME_PERIOD_BINS, TIME_PERIOD_LABELS, True, True, [0, 5, 6, 7, 12, 13, 18, 19, 23, None]),
    (DURATION_BINS, DURATION_LABELS, True, False, [0, 0.5, 1, 1.01, 5, 15, 15.1, 120, None]),
    (ORDER_VALUE_BINS, ORDER_VALUE_LABELS, True, False, [0, 0.01, 25, 25.01, 100, 500, 501, 1e9]),
    (ACTIVITY_LEVEL_BINS, ACTIVITY_LEVEL_LABELS, True, True, [-1, 0, 1, 2, 5, 6, 10, 11, 1000]),
])
def test_cut_matches_pandas(spark, edges, labels, right, low, values):
    _cut_vs_pandas(spark, values, edges, labels, right, low)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.exponential(100, 997), 2)
    vals[:200] = 5.0  # a long run of ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    probs = [0, 0.2, 0.25, 0.33, 0.5, 0.67, 0.75, 0.8, 1]
    exp = np.quantile(vals, probs)
    got = exact_quantiles(df, "v", probs, tiebreak=["id"])
    assert got == pytest.approx(list(exp), rel=0, abs=1e-12)


def test_qcut_matches_pandas(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.gamma(2, 50, 500), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    labels = ["a", "b", "c", "d", "e"]
    edges = exact_quantiles(df, "v", [i / 5 for i in range(6)], tiebreak=["id"])
    got = [r[0] for r in df.orderBy("id").select(qcut_column(F.col("v"), edges, labels)).collect()]
    exp = [str(x) for x in pd.qcut(pd.Series(vals), 5, labels=labels)]
    assert got == exp


def test_qcut_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 5]], "v double")
    edges = [1.0, 1.0, 1.0, 1.0, 5.0]
    with pytest.raises(ValueError):
        qcut_column(F.col("v"), edges, ["a", "b", "c", "d"], on_duplicates="raise")
    # collapsed to the single bin [1, 5]
    got = [r[0] for r in df.select(qcut_column(F.col("v"), edges, ["a", "b", "c", "d"])).collect()]
    assert got == ["a", "a", "a", "a", "a"]
    got = [r[0] for r in df.select(qcut_column(F.col("v"), [1.0, 1.0, 3.0, 5.0], ["a", "b", "c"])).collect()]
    assert got == ["a", "a", "a", "a", "b"]


def test_empty_quantiles(spark):
    df = spark.createDataFrame([], "id long, v double")
    assert exact_quantiles(df, "v", [0.5], tiebreak=["id"]) is None


def test_safe_ratio_and_rounding(spark):
    df = spark.createDataFrame([(1, 0), (3, 2), (None, 2), (2, None), (5, 4)], "a int, b int")
    got = [r[0] for r in df.select(safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.5, 0.0, 0.0, 1.25]
    vals = [2.675, 1.005, 0.125, 0.0015, 1.135, 12.345, -2.5, 3.5]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    for digits in (2, 3):
        got = [r[0] for r in d.select(bround(F.col("v"), digits)).collect()]
        assert got == [float(np.round(v, digits)) for v in vals]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(nan_to_null(F.col("v"))).collect()] == [None, None, None, 1.5]


def test_leaf_and_search(spark):
    df = spark.createDataFrame([("a.x",), ("b.x",), ("x",), ("",), (None,), ("A.b.Gear",)], "c string")
    assert [r[0] for r in df.select(leaf_name(F.col("c"))).collect()] == ["x", "x", "x", "", None, "Gear"]
    lit = [r[0] for r in df.select(contains_literal(F.col("c"), ".X")).collect()]
    assert lit == [True, True, False, False, False, False]
    rx = [r[0] for r in df.select(matches_regex(F.col("c"), "^[ab]\\.")).collect()]
    assert rx == [True, True, False, False, False, True]


def test_keep_all_labels(spark):
    agg = spark.createDataFrame([("Large", 3)], "order_value_category string, count long")
    out = {r[0]: r[1] for r in keep_all_labels(agg, ORDER_VALUE_LABELS, "order_value_category", {"count": 0}).collect()}
    assert out == {"Small": 0, "Medium": 0, "Large": 3, "Premium": 0}
    assert not math.isnan(1.0)


def test_order_statistics_on_decimals(spark):
    from decimal import Decimal
    from shopflow.operators import binning
    vals = [Decimal(str(round(x * 0.37, 2))) for x in range(400)] + [Decimal("12.95")] * 300
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v decimal(18,2)")
    ranks = [0, 5, 350, 420, 699]
    exp = [sorted(vals)[r] for r in ranks]
    assert binning.order_statistics(df, "v", ranks, len(vals), ["id"]) == exp


def test_index_counts_sums_and_quantiles(spark):
    """One index answers what several scans did: counts, top sums and quantiles of parts."""
    from decimal import Decimal

    from shopflow.operators.binning import OrderStatistics
    rng = np.random.default_rng(12)
    vals = [None] * 9 + [Decimal(0)] * 150 + [Decimal(int(x)).scaleb(-2) for x in rng.integers(-500, 4000, 400)]
    df = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(vals)], "id long, t string").selectExpr("cast(t as decimal(28,2)) as v")
    index = OrderStatistics(df, F.col("v"))
    some = sorted(v for v in vals if v is not None)
    assert (index.n_rows, index.n, index.distinct, index.most) == (len(vals), len(some), len(set(some)), some[-1])
    assert index.counts(0) == (sum(v < 0 for v in some), sum(v == 0 for v in some))
    for k in (0, 1, 2, 57, 300, len(some), len(some) + 5):
        assert index.top_sum(k) == sum(some[max(0, len(some) - k):] if k else [])
    probs = [0.0, 0.2, 0.25, 0.5, 0.8, 1.0]
    for kwargs, part in (({}, some), ({"above": 0}, [v for v in some if v > 0]), ({"without": 0}, [v for v in some if v != 0])):
        assert index.quantiles(probs, **kwargs) == list(np.quantile([float(v) for v in part], probs))
    assert index.quantiles([0.5], above=10**6) is None and OrderStatistics(df.where("false"), F.col("v")).quantiles([0.5]) is None

"""K4 global order and the session clock against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shopflow.operators.ordered import global_order, keyed_clock


def test_global_order_matches_sort(spark):
    rng = np.random.default_rng(11)
    n = 3000
    spend = np.round(rng.exponential(50, n), 2)
    spend[: n // 3] = 0.0  # a third of all rows share one value
    pdf = pd.DataFrame({"user_id": np.arange(n), "s": spend})
    df = spark.createDataFrame(pdf)
    for parts in (1, 8):
        got = global_order(df, [F.col("s").desc(), F.col("user_id").asc()], sums=["s"],
                           num_partitions=parts).toPandas().sort_values("_rank")
        exp = pdf.sort_values(["s", "user_id"], ascending=[False, True]).reset_index(drop=True)
        assert list(got["_rank"]) == list(range(1, n + 1))
        assert list(got["user_id"]) == list(exp["user_id"])
        assert np.allclose(got["cum_s"].to_numpy(), exp["s"].cumsum().to_numpy())


def test_keyed_clock_matches_pandas(spark):
    rng = np.random.default_rng(5)
    rows = []
    base = dt.datetime(2024, 3, 1)
    for i in range(2000):
        # session "hot" holds half of all rows
        sess = "hot" if i % 2 == 0 else f"s{i % 37}"
        t = None if i % 97 == 0 else base + dt.timedelta(seconds=int(rng.integers(0, 5000)))
        rows.append((sess, t, i))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    order = [F.col("t").asc_nulls_last(), F.col("id").asc()]
    # 40 ranges cut the hot key (1000 rows) about twenty times
    for parts in (40, None, 1):
        got = keyed_clock(df, "k", "t", order, num_partitions=parts).toPandas().set_index("id").sort_index()
        pdf = pd.DataFrame(rows, columns=["k", "t", "id"])
        pdf = pdf.sort_values(["k", "t", "id"], na_position="last")
        pdf["prev"] = pdf.groupby("k")["t"].shift(1)
        pdf["first"] = pdf.groupby("k")["t"].transform("min")
        pdf = pdf.set_index("id").sort_index()
        assert got["_prev_time"].isna().tolist() == pdf["prev"].isna().tolist()
        both = ~pdf["prev"].isna()
        assert (got["_prev_time"][both] == pdf["prev"][both]).all()
        assert (got["_key_first"] == pdf["first"]).all()


def test_equal_and_missing_times_are_split(spark):
    """A session at one timestamp and one without times: ranges stay balanced, values right."""
    from shopflow.operators.ordered import ranged
    t0 = dt.datetime(2024, 3, 1)
    rows = [("one", t0, i) for i in range(1000)] + [("none", None, 1000 + i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long")
    order = [F.col("t").asc_nulls_last(), F.col("id").asc()]
    sizes = [r["count"] for r in ranged(df, [F.col("k").asc(), *order], 20).groupBy("_pid").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 4 * 2000 / 20
    got = keyed_clock(df, "k", "t", order, num_partitions=20).toPandas()
    one = got[got.k == "one"].sort_values("id")
    assert one["_prev_time"].isna().sum() == 1 and (one["_prev_time"].dropna() == t0).all() and (one["_key_first"] == t0).all()
    none = got[got.k == "none"]
    assert none["_prev_time"].isna().all() and none["_key_first"].isna().all()


def test_running_sums_are_exact_beyond_64_bits():
    """128-bit running sums over batches with nulls and signs equal Python's integers."""
    import decimal
    from decimal import Decimal

    import pyarrow as pa

    from shopflow.operators.ordered import _Running
    decimal.setcontext(decimal.Context(prec=50))
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.1 else int(rng.integers(-10**18, 10**18)) * int(rng.integers(1, 10**9)) for _ in range(3000)]
    run, total, want, got = _Running(pa.decimal128(38, 2)), 0, [], []
    for i in range(0, 3000, 700):
        batch = pa.array([None if v is None else Decimal(v).scaleb(-2) for v in values], pa.decimal128(38, 2)).slice(i, 700)
        got += run.add(batch).to_pylist()
    for v in values:
        total += v or 0
        want.append(Decimal(total).scaleb(-2))
    assert got == want


def test_global_order_of_decimals_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else f"{(i * 37) % 101}.25") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string").selectExpr("id", "cast(t as decimal(28,2)) as v")
    got = global_order(df, [F.col("v").desc(), F.col("id").asc()], sums=["v"], num_partitions=9).orderBy("_rank").collect()
    total = 0
    for i, r in enumerate(got, 1):
        total += r.v or 0
        assert r._rank == i and r.cum_v == total and r._n_total == 500
    assert {r.total_v for r in got} == {total}

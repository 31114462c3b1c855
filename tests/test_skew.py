"""A session holding a third of all rows: features equal a pandas brute force."""

import datetime as dt

import numpy as np
import pandas as pd

from shopflow.operators.clean import clean_events
from shopflow.operators.features import session_features
from tests.frames import events


def test_hot_session_features_match_brute_force(spark):
    rng = np.random.default_rng(21)
    rows = []
    base = dt.datetime(2024, 5, 4)
    for i in range(3000):
        sess = "hot" if i % 3 == 0 else f"s{i % 97}"
        et = ["view", "cart", "purchase"][int(rng.integers(0, 3))]
        cat = None if i % 11 == 0 else f"c.{int(rng.integers(0, 7))}"
        brand = None if i % 13 == 0 else f"B{int(rng.integers(0, 5))}"
        t = base + dt.timedelta(seconds=int(rng.integers(0, 86400 * 3)))
        rows.append((int(rng.integers(1, 40)), sess, et, int(rng.integers(0, 200)), brand, cat,
                     round(float(rng.uniform(1, 50)), 2), t))
    out = session_features(clean_events(events(spark, rows))).toPandas().set_index("user_session")

    pdf = pd.DataFrame(rows, columns=["user_id", "user_session", "event_type", "product_id", "brand",
                                      "category_code", "price", "event_time"]).drop_duplicates()
    pdf["brand"] = pdf["brand"].fillna("unknown")
    pdf["spend"] = np.where(pdf["event_type"] == "purchase", pdf["price"], 0.0)
    pdf = pdf.sort_values(["user_session", "event_time", "product_id", "event_type", "price", "user_id",
                           "brand", "category_code"], na_position="first")
    g = pdf.groupby("user_session")
    exp = pd.DataFrame({
        "view_count": g["event_type"].apply(lambda s: (s == "view").sum()),
        "n_unique_brands": g["brand"].nunique(),
        "n_unique_categories": g["category_code"].nunique(),
        "session_total_spending": g["spend"].sum().round(2),
        "category_code": g["category_code"].first(),
        "user_id": g["user_id"].first(),
        "brand": g["brand"].first(),
    })
    for t in ["view", "cart", "purchase"]:
        exp[f"{t}_unique"] = pdf[pdf.event_type == t].groupby("user_session")["product_id"].nunique()
    exp = exp.fillna({"view_unique": 0, "cart_unique": 0, "purchase_unique": 0})
    assert len(out) == len(exp)
    for col in ["view_count", "n_unique_brands", "n_unique_categories", "view_unique", "cart_unique",
                "purchase_unique", "user_id"]:
        assert (out[col].astype(int) == exp.loc[out.index, col].astype(int)).all(), col
    assert (out["category_code"] == exp.loc[out.index, "category_code"]).all()
    assert (out["brand"] == exp.loc[out.index, "brand"]).all()
    assert np.allclose(out["session_total_spending"].astype(float), exp.loc[out.index, "session_total_spending"])


def test_hot_session_clock_matches_brute_force(spark):
    from shopflow.operators.clean import add_session_clock, clean_base
    rng = np.random.default_rng(8)
    base = dt.datetime(2024, 5, 4)
    rows = []
    for i in range(1200):
        sess = "hot" if i % 3 else f"s{i % 13}"
        t = None if i % 101 == 0 else base + dt.timedelta(seconds=int(rng.integers(0, 3000)))
        rows.append((1, sess, "view", int(rng.integers(0, 50)), "B", None, 1.0 + i, t))
    b = clean_base(events(spark, rows))
    got = add_session_clock(b, num_partitions=23).toPandas()
    pdf = got[["user_session", "event_time", "product_id", "price"]].copy()
    pdf = pdf.sort_values(["user_session", "event_time", "product_id", "price"], na_position="last")
    prev = pdf.groupby("user_session")["event_time"].shift(1)
    gap = (pdf["event_time"] - prev).dt.total_seconds().fillna(0.0)
    exp = dict(zip(zip(pdf["user_session"], pdf["price"].astype(float)), gap))
    for r in got.itertuples():
        assert r.prev_event_gap == exp[(r.user_session, float(r.price))]

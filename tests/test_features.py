"""Cleaning and feature-table edge cases on hand-written frames."""

from decimal import Decimal

from pyspark.sql import functions as F

from shopflow.operators.clean import clean_events, coerce_event_time
from shopflow.operators.features import brand_features, category_features, session_features, user_features
from tests.frames import events, ts


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_cleaning_chain(spark):
    raw = events(spark, [
        (1, "s1", "view", 10, None, "a.b", 5.0, ts(5, 59)),      # night, brand filled
        (1, "s1", "view", 10, None, "a.b", 5.0, ts(5, 59)),      # exact duplicate
        (1, "s1", "purchase", 11, "X", None, None, ts(6, 0)),   # purchase without price
        (1, None, "view", 12, "X", None, 1.0, ts(7, 0)),         # null session dropped
        (2, "s2", "cart", 13, "Y", "c", 2.0, ts(23, 59, 59)),
        (2, "s2", "purchase", 13, "Y", "c", 3.0, None),          # no time
    ])
    out = clean_events(raw)
    rows = sorted(out.collect(), key=lambda r: (r.user_session, r.product_id))
    assert len(rows) == 4
    a, b, c, d = rows
    assert a.brand == "unknown" and a.event_period == "night" and a.hour == 5 and a.weekday == 0
    assert b.event_period == "morning" and b.purchase_spending is None and b.prev_event_gap == 60.0
    assert a.prev_event_gap == 0.0 and b.time_since_start == 60.0
    assert c.event_period == "evening" and c.purchase_spending == Decimal("0.00")
    assert d.event_time is None and d.prev_event_gap == 0.0 and d.time_since_start is None
    assert d.purchase_spending == Decimal("3.00")


def test_unsorted_session_gaps(spark):
    raw = events(spark, [
        (1, "s", "view", 3, "b", None, 1.0, ts(10, 5)),
        (1, "s", "view", 1, "b", None, 1.0, ts(10, 0)),
        (1, "s", "view", 2, "b", None, 1.0, ts(10, 0)),  # tie at 10:00, product 1 first
        (1, "s", "cart", 4, "b", None, 1.0, ts(10, 30)),
    ])
    got = {r.product_id: r.prev_event_gap for r in clean_events(raw).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 300.0, 4: 1500.0}


def test_text_times_are_parsed(spark):
    df = spark.createDataFrame([("2020-09-24 11:57:06 UTC",), ("garbage",), (None,), ("2020-09-24 11:57:06",)],
                               "event_time string")
    got = [r[0] for r in coerce_event_time(df).collect()]
    assert str(got[0]) == "2020-09-24 11:57:06" and got[1] is None and got[2] is None
    assert str(got[3]) == "2020-09-24 11:57:06"


def test_session_features_edges(spark):
    raw = events(spark, [
        # two users in one session; the earliest row has no category
        (7, "s1", "view", 1, "B1", None, 10.0, ts(9, 0)),
        (8, "s1", "view", 2, "B2", "cat.x", 10.0, ts(9, 1)),
        (8, "s1", "purchase", 1, "B1", "cat.x", 10.0, ts(9, 2)),
        (8, "s1", "purchase", 3, "B1", "cat.y", None, ts(9, 3)),
        # purchases without views, no cart; weekend start (Sat 2024-01-06)
        (9, "s2", "purchase", 5, "B3", "cat.z", 4.0, ts(12, 0, day=6)),
        (9, "s2", "purchase", 5, "B3", "cat.z", 4.0, ts(12, 5, day=6)),
        # only a missing time: duration null, weekday
        (9, "s3", "view", 6, "B3", None, 1.0, None),
    ])
    s = _rows(session_features(clean_events(raw)), "user_session")
    s1, s2, s3 = s["s1"], s["s2"], s["s3"]
    assert s1["user_id"] == 7 and s1["category_code"] == "cat.x" and s1["brand"] == "B1"
    assert (s1["view_count"], s1["cart_count"], s1["purchase_count"]) == (2, 0, 2)
    assert s1["view_unique"] == 2 and s1["purchase_unique"] == 2 and s1["cart_unique"] == 0
    assert s1["view_to_purchase_rate"] == 1.0 and s1["n_unique_brands"] == 2 and s1["n_unique_categories"] == 2
    assert s1["session_total_spending"] == Decimal("10.00") and s1["session_duration"] == 180.0
    assert s2["view_to_purchase_rate"] == 0.0 and s2["is_weekend"] is True and s2["purchase_unique"] == 1
    assert s2["session_total_spending"] == Decimal("8.00")
    assert s3["session_duration"] is None and s3["is_weekend"] is False
    assert s3["session_total_spending"] == Decimal("0.00") and s3["category_code"] is None

    u = _rows(user_features(session_features(clean_events(raw))), "user_id")
    assert u[7]["user_total_sessions"] == 1  # s1 belongs to its first user
    assert u[9]["user_total_sessions"] == 2 and u[9]["user_view_to_purchase_rate"] == 1.0
    assert u[9]["user_avg_session_duration"] == 300.0
    assert u[9]["user_purchase_per_session"] == 1.0


def test_entity_features(spark):
    raw = events(spark, [
        (1, "s1", "view", 1, "B1", "c1", 1.0, ts(1)),
        (1, "s1", "purchase", 1, "B1", "c1", 2.5, ts(2)),
        (1, "s1", "purchase", 2, "B1", None, 4.0, ts(3)),
        (2, "s2", "purchase", 3, "B2", "c2", None, ts(4)),
        (2, "s2", "cart", 3, None, "c2", 1.0, ts(5)),
    ])
    ev = clean_events(raw)
    b = _rows(brand_features(ev), "brand")
    assert b["B1"]["purchase"] == 2 and b["B1"]["view"] == 1 and b["B1"]["brand_view_to_purchase_rate"] == 2.0
    assert b["B1"]["purchase_spending"] == Decimal("6.50")
    assert b["B2"]["brand_view_to_purchase_rate"] == 0.0 and b["B2"]["purchase_spending"] == Decimal("0.00")
    assert "unknown" in b and b["unknown"]["cart"] == 1
    c = _rows(category_features(ev), "category_code")
    assert set(c) == {"c1", "c2"}  # null category drops out
    assert c["c2"]["cart"] == 1 and c["c2"]["purchase"] == 1

"""Hand-written event frames for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("user_session", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category_code", T.StringType()),
    T.StructField("price", T.DecimalType(18, 2)),
    T.StructField("event_time", T.TimestampNTZType()),
])


def ts(h, m=0, s=0, day=1):
    return dt.datetime(2024, 1, day, h, m, s)


def events(spark, rows):
    fixed = [(u, s, e, p, b, c, None if pr is None else Decimal(str(pr)), t) for (u, s, e, p, b, c, pr, t) in rows]
    return spark.createDataFrame(fixed, RAW)

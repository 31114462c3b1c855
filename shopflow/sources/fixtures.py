"""Shop events derived from the TPC-H-style test tables.

The test tables carry no shop sessions, so order lines are read as events:
an order is a session, its customer the user, the return flag the event
type, the part the product.  The same mapping exists as SQL text for the
DuckDB oracle (``plans/oracle.py``).  Every rule below touches every line;
the key-based rules only inject the null cases and exact duplicate rows
that the cleaning steps must handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one test table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shop_events_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw shop events (with exact duplicates) from lineitem x orders x part."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    # Join sizes are left to AQE: part and orders are broadcast only when
    # their measured size is below the threshold.
    j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(
        pt, F.col("l_partkey") == F.col("p_partkey"))
    k, pk = F.col("l_orderkey"), F.col("l_partkey")
    cents = (F.col("l_quantity").cast("bigint") * (F.lit(1) + pk % 20) * 100 + k % 100)
    offset_s = ((k * 7) % 1440) * 60 + (F.col("l_linenumber") - 1) * ((k % 13) * 37)
    base = j.select(
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("user_session"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_returnflag") == "N", "view").when(F.col("l_returnflag") == "A", "cart")
         .otherwise("purchase").alias("event_type"),
        pk.alias("product_id"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(
            F.concat(F.lower("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit(".")))
        ).alias("category_code"),
        F.when(k % 101 == 0, F.lit(None)).otherwise(
            (cents.cast("decimal(20,2)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")
        ).alias("price"),
        F.when(pk % 211 == 0, F.lit(None)).otherwise(
            F.timestamp_add("SECOND", offset_s, F.col("o_orderdate").cast("timestamp_ntz"))
        ).alias("event_time"),
        k.alias("_k"),
    )
    cols = ["user_session", "user_id", "event_type", "product_id", "brand",
            "category_code", "price", "event_time"]
    # Lines of every 50th order appear twice: exact duplicates for C1.
    copies = F.when(F.col("_k") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select(*cols, F.explode(copies)).select(*cols)


def shop_events_from_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw shop events from the ``events`` table (second fixture).

    click -> cart; view and purchase keep their names; other types (signup,
    error) stay as extra types.  A session is a user-day; the product comes
    from the JSON props; brand and category come from ``part``.
    """
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value", "props")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    e = ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("user_session"),
        F.col("user_id"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
        F.col("value").cast("decimal(18,2)").alias("price"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
    )
    j = e.join(pt, F.col("product_id") == F.col("p_partkey"), "left")
    return j.select(
        "user_session", "user_id", "event_type", "product_id",
        F.col("p_brand").alias("brand"),
        F.concat(F.lower("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("category_code"),
        "price", "event_time")


def browsing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders fixture of a shop that records views only: no carts, no
    purchases (the log in which the low-funnel and zero-revenue rules fire)."""
    return shop_events_from_orders(spark, sf_dir).where(F.col("event_type") == "view")


def weekend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders fixture of a shop that sells at weekends only: purchases of
    other days (or without time) are missing, so weekend conversion leads."""
    return shop_events_from_orders(spark, sf_dir).where(
        (F.col("event_type") != "purchase") | F.coalesce(F.weekday("event_time") >= 5, F.lit(False)))


def text_time_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders fixture as a text log: times end in their zone, missing
    times are unparseable text."""
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return shop_events_from_orders(spark, sf_dir).withColumn("event_time", F.coalesce(text, F.lit("not a time")))


SOURCES = {
    "orders": shop_events_from_orders,
    "events": shop_events_from_event_log,
    "orders-browsing": browsing_events,
    "orders-weekend": weekend_events,
    "orders-text": text_time_events,
}

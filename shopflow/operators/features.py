"""Session, user, brand and category feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.functions.numeric import money_sum, safe_ratio, seconds_between
from shopflow.schema import EVENT_TYPES


def session_unique_products(events: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """distinct products per session and event type, 0 when absent."""
    return distinct_by_type(events, "user_session", types, suffix="_unique")


def distinct_by_type(events: DataFrame, key: str, types: Sequence[str], *extra, suffix: str = "") -> DataFrame:
    """Distinct products per ``key`` and event type by grouping twice.

    The first group-by, on (key, type, product), combines before its shuffle
    and spreads a hot key by product; the second counts its groups.  No row
    is multiplied, unlike several distinct counts in one aggregate.
    ``extra``: (name, sum column) pairs carried along.
    """
    once = events.groupBy(key, "event_type", "product_id").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(name) for name, c in extra])
    named = F.col("product_id").isNotNull()
    return once.groupBy(key).agg(
        *[F.count_if((F.col("event_type") == t) & named).alias(f"{t}{suffix}") for t in sorted(types)],
        *[money_sum(F.col(name)).alias(name) for name, _ in extra])


def session_cells(events: DataFrame) -> DataFrame:
    """Events collapsed by (session, type, product, brand, category): count,
    extreme times, spend, and the smallest (time, price, user) of any row and
    of the rows with a user.  A hot session spreads by product."""
    row = F.struct(F.col("event_time").isNull().alias("t_null"), F.col("event_time"), F.col("price"), F.col("user_id"))
    return events.groupBy("user_session", "event_type", "product_id", "brand", "category_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("t0"), F.max("event_time").alias("t1"),
        F.sum("purchase_spending").alias("spend"), F.min(row).alias("any_row"),
        F.min(F.when(F.col("user_id").isNotNull(), row)).alias("user_row"))


def session_facts(cells: DataFrame) -> DataFrame:
    """(session, kind, type, product, value, ...): a row for each product of a
    type (kind 0, with the cell's measures), brand (1) and category (2) of a
    cell; equal ones of a session are folded, which counts distinct values."""
    def order_key(row: str) -> Column:
        # event_order over the cell's rows: its columns are constant in the cell.
        r = F.col(row)
        return F.struct(r["t_null"].alias("t_null"), r["event_time"].alias("event_time"), F.col("product_id"), F.col("event_type"),
                        r["price"].alias("price"), r["user_id"].alias("user_id"), F.col("brand"), F.col("category_code"))

    measures = {"n": F.col("n"), "t0": F.col("t0"), "t1": F.col("t1"), "spend": F.col("spend"),
                "first_user": F.when(F.col("user_row").isNotNull(), order_key("user_row")),
                "first_brand": F.when(F.col("brand").isNotNull(), order_key("any_row")),
                "first_category": F.when(F.col("category_code").isNotNull(), order_key("any_row"))}
    none = F.lit(None)
    base = cells.select("user_session", "event_type", "product_id", "brand", "category_code", *[c.alias(k) for k, c in measures.items()])
    types = {f.name: f.dataType for f in base.schema.fields}

    def fact(kind: int, value: Column) -> Column:
        own = kind == 0
        return F.struct(F.lit(kind).alias("kind"), *[(F.col(c) if own else none.cast(types[c])).alias(c) for c in ("event_type", "product_id")],
                        value.cast("string").alias("value"), *[(F.col(k) if own else none.cast(types[k])).alias(k) for k in measures])

    facts = F.array(fact(0, none), F.when(F.col("brand").isNotNull(), fact(1, F.col("brand"))),
                    F.when(F.col("category_code").isNotNull(), fact(2, F.col("category_code"))))
    each = base.select("user_session", F.explode(F.filter(facts, lambda x: x.isNotNull())).alias("f")).select("user_session", "f.*")
    return each.groupBy("user_session", "kind", "event_type", "product_id", "value").agg(
        F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("spend").alias("spend"),
        *[F.min(c).alias(c) for c in ("first_user", "first_brand", "first_category")])


#: Sessions of more events than this are folded step by step, not as one group.
LONG_SESSION = 10_000


def _long_session_measures(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """The measures of ``session_features`` by three combining aggregates: cells
    of (session, type, product, brand, category), then distinct facts of a
    session, then the session.  A session that holds a third of all rows spreads
    over tasks in the first two; the last one gets a partial row per task and session.
    """
    t, product = F.col("event_type"), F.col("kind") == 0
    named = product & F.col("product_id").isNotNull()
    counted = lambda x: F.coalesce(F.sum(F.when(product & (t == x), F.col("n"))), F.lit(0))
    return session_facts(session_cells(events)).groupBy("user_session").agg(
        F.min("first_user")["user_id"].alias("user_id"), F.min("first_category")["category_code"].alias("category_code"),
        F.min("first_brand")["brand"].alias("brand"),
        *[counted(x).alias(f"{x}_count") for x in EVENT_TYPES],
        F.count_if(F.col("kind") == 1).alias("n_unique_brands"), F.count_if(F.col("kind") == 2).alias("n_unique_categories"),
        F.min("t0").alias("session_started_at"), F.max("t1").alias("session_ended_at"),
        money_sum(F.col("spend")).cast("decimal(28,2)").alias("session_total_spending"),
        *[F.count_if(named & (t == x)).alias(f"{x}_unique") for x in sorted(types)])


def _short_session_measures(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """The same measures from one shuffle of the events; a group holds the
    distinct values of one session, of ``LONG_SESSION`` events at most."""
    t, key = F.col("event_type"), _event_key()
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), key))[c].alias(c)
    distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    return events.repartition("user_session").groupBy("user_session").agg(
        first("user_id"), first("category_code"), first("brand"),
        *[F.count_if(t == x).alias(f"{x}_count") for x in EVENT_TYPES],
        distinct(F.col("brand")).alias("n_unique_brands"), distinct(F.col("category_code")).alias("n_unique_categories"),
        F.min("event_time").alias("session_started_at"), F.max("event_time").alias("session_ended_at"),
        money_sum(F.col("purchase_spending")).cast("decimal(28,2)").alias("session_total_spending"),
        *[distinct(F.when(t == x, F.col("product_id"))).alias(f"{x}_unique") for x in sorted(types)])


def _event_key() -> Column:
    # event_order as a struct: null fields sort first, so only the time needs a flag.
    return F.struct(F.col("event_time").isNull().alias("t_null"), *[
        F.col(c) for c in ("event_time", "product_id", "event_type", "price", "user_id", "brand", "category_code")])


def session_features(events: DataFrame, types: Sequence[str] = EVENT_TYPES, long: int = LONG_SESSION) -> DataFrame:
    """F1-F6 over cleaned events.

    Events go to their session in one shuffle and are folded there, except
    those of sessions with more than ``long`` events: these, one in ``long``
    events at most, are found by a count and folded in combining steps, so
    no task or group gets a session that holds a large part of all rows.
    First values (F2a) are the smallest order key among rows where the column
    is set.
    """
    needed = ["user_session", "event_time", "product_id", "event_type", "price", "user_id", "brand", "category_code", "purchase_spending"]
    events = events.select(*needed)
    counts = events.groupBy("user_session").agg(F.count(F.lit(1)).alias("_n"))
    found = F.broadcast(counts.where(F.col("_n") > long).select(F.col("user_session").alias("_long")))
    same = F.col("user_session").eqNullSafe(F.col("_long"))
    out = _short_session_measures(events.join(found, same, "left_anti"), types).unionByName(
        _long_session_measures(events.join(found, same, "left_semi"), types))
    return (out
            .withColumn("session_duration", seconds_between(F.col("session_started_at"), F.col("session_ended_at")))
            .withColumn("view_to_purchase_rate", safe_ratio(F.col("purchase_unique"), F.col("view_unique")))
            .withColumn("is_weekend", F.coalesce(F.weekday("session_started_at") >= 5, F.lit(False))))


def user_features(sessions: DataFrame) -> DataFrame:
    """F7-F9 from session features (a session counts for its first user)."""
    agg = sessions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_total_sessions"),
        F.sum("view_count").alias("total_view_count"),
        F.sum("cart_count").alias("total_cart_count"),
        F.sum("purchase_count").alias("total_purchase_count"),
        F.sum("purchase_unique").alias("total_unique_purchase_count"),
        F.sum("view_unique").alias("total_unique_view_count"),
        # durations have microsecond resolution: the mean is rounded half-even
        # to the microsecond (exact decimal arithmetic)
        F.bround(F.avg(F.col("session_duration").cast("decimal(28,6)")).cast("decimal(38,16)"), 6)
         .cast("double").alias("user_avg_session_duration"),
        money_sum(F.col("session_total_spending")).alias("user_total_spending"),
    )
    return (agg
            .withColumn("user_view_to_purchase_rate",
                        F.least(safe_ratio(F.col("total_unique_purchase_count"), F.col("total_unique_view_count")),
                                F.lit(1.0)))
            .withColumn("user_purchase_per_session",
                        safe_ratio(F.col("total_purchase_count"), F.col("user_total_sessions"))))


def entity_features(events: DataFrame, key: str, rate_name: str,
                    types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    """Distinct products per type, purchase/view rate and purchase
    spending for one entity column; rows with a null key drop out."""
    spend = F.when(F.col("event_type") == "purchase", F.col("purchase_spending"))
    agg = distinct_by_type(events.where(F.col(key).isNotNull()), key, types, ("purchase_spending", spend))
    cols = [key, *sorted(types), rate_name, "purchase_spending"]
    return agg.withColumn(rate_name, safe_ratio(F.col("purchase"), F.col("view"))).select(*cols)


def brand_features(events: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    return entity_features(events, "brand", "brand_view_to_purchase_rate", types)


def category_features(events: DataFrame, types: Sequence[str] = EVENT_TYPES) -> DataFrame:
    return entity_features(events, "category_code", "category_view_to_purchase_rate", types)


SESSION_COLUMNS = ["user_session", "user_id", "category_code", "brand", "view_count", "cart_count",
                   "purchase_count", "n_unique_brands", "n_unique_categories", "session_started_at",
                   "session_ended_at", "session_total_spending", "cart_unique", "purchase_unique",
                   "view_unique", "session_duration", "view_to_purchase_rate", "is_weekend"]

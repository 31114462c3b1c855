"""Named queries: Spark plan + independent SQL oracle for each.

Every query reads the test tables through the fixture mapping (or the
second ``events`` mapping), so its work grows with the tables.  Outputs are
presented uniformly: money as double, timestamps as UTC wall-clock, NaN and
infinities as null, and doubles rounded to 6 decimals (values the reference
rounds keep their own coarser half-even rounding).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.numeric import present
from shopflow.plans.context import ShopContext
from shopflow.plans.oracle import with_chain


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[ShopContext], DataFrame]
    sql: str | None
    source: str = "orders"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, source: str = "orders"):
    def deco(fn: Callable[[ShopContext], DataFrame]):
        REGISTRY[name] = Query(name, fn, sql, source)
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    df = present(df)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return finish(q.build(ShopContext.for_source(spark, sf_dir, q.source)))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in REGISTRY}


def oracle_queries() -> dict[str, str]:
    _load()
    return {q.name: with_chain(q.sql, q.source) for q in REGISTRY.values() if q.sql is not None}


def _load() -> None:
    # Importing the query modules fills REGISTRY.
    from shopflow.plans import queries_core, queries_dash, queries_report  # noqa: F401

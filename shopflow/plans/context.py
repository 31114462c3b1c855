"""Stage tables shared by the analyses.

Cleaned events and the four feature tables feed dozens of analyses, so
they are computed once and written as parquet under the session's shared
folder (``spark.checkpoint.dir``).  Reading them back cuts the lineage (a
lost executor re-reads files instead of recomputing the cleaning) and gives
later queries parquet column pruning and filter pushdown.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators.binning import OrderStatistics
from shopflow.operators.clean import CLEAN_COLUMNS, add_session_clock, clean_base
from shopflow.operators.explore import search_values
from shopflow.operators.features import (
    brand_features, category_features, session_features, user_features,
)
from shopflow.operators.temporal import start_cells
from shopflow.schema import EVENT_TYPES
from shopflow.session import shared_dir, write_stage
from shopflow.sources import fixtures

_CACHE: dict[tuple[str, str, str], "ShopContext"] = {}
_LOCK = threading.Lock()


class ShopContext:
    """Lazily built, optionally materialised stage tables for one event log."""

    def __init__(self, spark: SparkSession, raw: Callable[[], DataFrame], *,
                 materialize: bool = True, types=EVENT_TYPES, tag: str | None = None):
        self.spark = spark
        self._raw = raw
        self.materialize = materialize
        self.types = tuple(types)
        self.tag = tag or uuid.uuid4().hex[:12]
        self.sf_dir: str | None = None  # set for contexts over the test tables
        self._tables: dict[str, DataFrame] = {}
        self._indexes: dict[str, OrderStatistics] = {}
        self._lock = threading.RLock()

    # -- construction -----------------------------------------------------
    @classmethod
    def for_source(cls, spark: SparkSession, sf_dir: str, source: str = "orders",
                   materialize: bool = True) -> "ShopContext":
        """One context per (application, data folder, source), reused across queries."""
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), source)
        with _LOCK:
            ctx = _CACHE.get(key)
            if ctx is None or ctx.spark is not spark:
                digest = hashlib.sha1("|".join(key).encode()).hexdigest()[:12]
                if source not in fixtures.SOURCES:
                    raise ValueError(f"unknown source {source!r}")
                raw = lambda: fixtures.SOURCES[source](spark, sf_dir)
                types = EVENT_TYPES + (("error", "signup") if source == "events" else ())
                ctx = cls(spark, raw, materialize=materialize, types=types, tag=f"{source}-{digest}")
                ctx.sf_dir = sf_dir
                _CACHE[key] = ctx
            return ctx

    # -- stage tables -----------------------------------------------------
    def _stage(self, name: str, build: Callable[[], DataFrame], write: bool | None = None) -> DataFrame:
        with self._lock:
            if name not in self._tables:
                df = build()
                if self.materialize if write is None else write:
                    path = f"{shared_dir(self.spark)}/shopflow/{self.tag}/{name}"
                    write_stage(df, path, "overwrite")
                    df = self.spark.read.parquet(path)
                self._tables[name] = df
            return self._tables[name]

    def _index(self, name: str, build: Callable[[], DataFrame], column: str) -> OrderStatistics:
        with self._lock:
            if name not in self._indexes:
                self._indexes[name] = OrderStatistics(build(), F.col(column))
            return self._indexes[name]

    @property
    def spend_index(self) -> OrderStatistics:
        """Values of the users' spend, for A5, A26, A27, R1-R3, R7 and E2."""
        return self._index("spend", lambda: self.users, "user_total_spending")

    @property
    def duration_index(self) -> OrderStatistics:
        """Values of the session durations, for A32."""
        return self._index("duration", lambda: self.sessions, "session_duration")

    @property
    def start_cells(self) -> DataFrame:
        """Sessions by month and hour of start (at most 289 rows), for A10-A15."""
        return self._stage("start_cells", lambda: start_cells(self.sessions), write=True)

    @property
    def events_raw(self) -> DataFrame:
        return self._raw()

    @property
    def events(self) -> DataFrame:
        """Cleaned events without the session clock (C1-C6, C10): the input
        of every feature table and event-level analysis."""
        return self._stage("events_base", lambda: clean_base(self._raw()))

    @property
    def search_values(self) -> DataFrame:
        """Distinct (brand, category, product), for D25."""
        return self._stage("search_values", lambda: search_values(self.events))

    @property
    def events_clean(self) -> DataFrame:
        """The full cleaned table (C1-C10) on the materialised base.  The clock
        writes its ordered rows; what is added to them here is not written again."""
        return self._stage("events_clean",
                           lambda: add_session_clock(self.events).select(*CLEAN_COLUMNS), write=False)

    @property
    def sessions(self) -> DataFrame:
        return self._stage("session_features", lambda: session_features(self.events, self.types))

    @property
    def users(self) -> DataFrame:
        return self._stage("user_features", lambda: user_features(self.sessions))

    @property
    def brands(self) -> DataFrame:
        return self._stage("brand_features", lambda: brand_features(self.events, self.types))

    @property
    def categories(self) -> DataFrame:
        return self._stage("category_features", lambda: category_features(self.events, self.types))

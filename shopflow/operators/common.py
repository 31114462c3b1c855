"""Shared DataFrame helpers: top-k and one-row frame combination."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> None:
    """IO12: raise listing the missing columns (no Spark job)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {name}: {missing}")


# Names of the feature tables in messages.
_FRAMES = {"sessions": "session_df", "users": "user_df", "brands": "brand_df", "categories": "category_df"}


def requires(**columns: Iterable[str]) -> Callable:
    """IO12 at the head of an analysis: ``requires(sessions=[...])`` checks the
    argument of that name (when given) before anything is planned."""
    def wrap(fn: Callable) -> Callable:
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def checked(*args, **kwargs):
            given = signature.bind(*args, **kwargs).arguments
            for argument, wanted in columns.items():
                if given.get(argument) is not None:
                    require_columns(given[argument], wanted, _FRAMES.get(argument, argument))
            return fn(*args, **kwargs)
        return checked
    return wrap


def top_k(df: DataFrame, value: str, k: int, key: str | list[str]) -> DataFrame:
    """K7: the k largest by ``value``; ties go to the smallest key (the
    reference keeps the first row, and its tables are sorted by key).
    Planned as TakeOrderedAndProject: a per-partition top-k, then a merge
    of k rows per partition."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in keys]).limit(k)


def zip_one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several global aggregates.

    Every input is a grouping-free aggregate (exactly one row).  The frames
    are stacked with ``unionByName`` (each row fills only its own columns)
    and folded back into one row with ``first(ignorenulls)``: no join, so
    no nested-loop or cartesian plan, and the final step reads one row per
    input frame.
    """
    if len(frames) == 1:
        return frames[0]
    names: list[str] = []
    for f in frames:
        names += [c for c in f.columns if c not in names]
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in names])


def scalar(df: DataFrame, col: str | None = None):
    """First value of a one-row frame (a tiny action)."""
    row = df.first()
    if row is None:
        return None
    return row[col] if col else row[0]


def attach_total(rows: DataFrame, total: DataFrame, bound: int) -> DataFrame:
    """Attach the columns of a one-row aggregate to a frame of at most
    ``bound`` rows (e.g. a top-k list): a window over those few rows, no
    join."""
    tag = "_is_total"
    cols = [c for c in total.columns]
    stacked = rows.withColumn(tag, F.lit(False)).unionByName(total.withColumn(tag, F.lit(True)),
                                                           allowMissingColumns=True)
    whole = Window.partitionBy()
    out = stacked.select(*[c for c in stacked.columns if c not in cols],
                         *[F.max(F.col(c)).over(whole).alias(c) for c in cols])
    return out.where(~F.col(tag)).drop(tag)

"""Text helpers for category names and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_name(col: Column) -> Column:
    """Last dot-separated part of a category code; null and '' are kept."""
    return F.substring_index(col, ".", -1)


def contains_literal(col: Column, term: str) -> Column:
    """Case-insensitive literal substring test; null -> false."""
    return F.coalesce(F.lower(col).contains(F.lit(term.lower())), F.lit(False))


def matches_regex(col: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; null -> false."""
    return F.coalesce(col.rlike("(?i)" + pattern), F.lit(False))

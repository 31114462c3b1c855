"""K2 quantile bins with exact, linearly interpolated edges.

Edges are order statistics.  Equal values are counted first (a combining
aggregate, so a value holding a third of all rows is one row afterwards);
the distinct values are range-partitioned and written in order.  The range
totals, one number per range, tell which range holds each wanted rank, and
only in those ranges is a running count taken.  At most two values per
wanted quantile reach the driver.  The analyses of one table share the index
(``ShopContext.spend_index``, ``duration_index``).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.functions.buckets import cut
from shopflow.operators.ordered import PID, ranged


def _positions(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    out = []
    for p in probs:
        h = (n - 1) * p
        lo = math.floor(h)
        hi = min(lo + 1, n - 1) if h > lo else lo
        out.append((lo, hi, h - lo))
    return out


def _lerp(a: float, b: float, t: float) -> float:
    # Same branch as numpy's linear method, so edges equal pandas.qcut's.
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


class OrderStatistics:
    """Index of a column's values: distinct values in order with their counts,
    written once, and the totals of each of their ranges on the driver.

    Row, null and distinct counts, ranks, quantiles, counts below a value and
    sums of the largest values are read from it; the indexed table is not
    scanned again.  ``n`` counts the non-null values, ``n_rows`` all rows.
    """

    def __init__(self, df: DataFrame, value: Column):
        counted = df.select(value.alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
        self.rows = ranged(counted, [F.col("_v").asc_nulls_first()])
        number = isinstance(counted.schema["_v"].dataType, T.NumericType)
        some = F.col("_v").isNotNull()
        each = F.col("_v") * F.col("_c") if number else F.lit(None).cast("double")
        # One row per range.
        totals = self.rows.groupBy(PID).agg(
            F.sum(F.when(some, F.col("_c"))).alias("n"), F.count_if(some).alias("distinct"), F.sum(F.when(some, each)).alias("total"),
            F.sum(F.when(~some, F.col("_c"))).alias("nulls"), F.max("_v").alias("most")).orderBy(PID).collect()
        self.n_rows = sum((r["n"] or 0) + (r["nulls"] or 0) for r in totals)
        totals = [r for r in totals if r["n"]]
        self.pids = [r[PID] for r in totals]
        self.ends = list(accumulate(r["n"] for r in totals))
        self.n = self.ends[-1] if self.ends else 0
        self.distinct = sum(r["distinct"] for r in totals)
        self.totals = [r["total"] for r in totals]
        self.most = totals[-1]["most"] if totals else None

    def at(self, ranks: Sequence[int]) -> dict[int, object]:
        """Values by 0-based ascending rank; at most one row per rank reaches the driver."""
        if not ranks:
            return {}
        before = {}
        for r in set(ranks):
            i = bisect.bisect_right(self.ends, r)
            before.setdefault(self.pids[i], (self.ends[i - 1] if i else 0, []))[1].append(r)
        run = Window.partitionBy(PID).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = (self.rows.where(F.col(PID).isin(list(before)) & F.col("_v").isNotNull())
                         .withColumn("_end", F.sum("_c").over(run)))
        hit = None
        for pid, (start, wanted) in before.items():
            for r in wanted:
                c = (F.col(PID) == pid) & (F.col("_end") > r - start) & (F.col("_end") - F.col("_c") <= r - start)
                hit = c if hit is None else hit | c
        found = rows.where(hit).select(PID, "_v", "_end", "_c").collect()
        out = {}
        for x in found:
            start, wanted = before[x[PID]]
            out.update({r: x["_v"] for r in wanted if x["_end"] - x["_c"] <= r - start < x["_end"]})
        return out

    def counts(self, value: object) -> tuple[int, int]:
        """(how many values are smaller, how many are equal)."""
        v = F.col("_v")
        row = self.rows.where(v <= F.lit(value)).agg(F.sum(F.when(v < F.lit(value), F.col("_c"))), F.sum(F.when(v == F.lit(value), F.col("_c")))).first()
        return row[0] or 0, row[1] or 0

    def top_sum(self, k: int) -> object:
        """Sum of the ``k`` largest values: whole ranges from their totals, the rest from one range."""
        if k <= 0 or not self.n:
            return 0
        k = min(k, self.n)
        v = self.at([self.n - k])[self.n - k]
        i = bisect.bisect_right(self.ends, self.n - k)
        rest = self.rows.where((F.col(PID) == self.pids[i]) & (F.col("_v") > F.lit(v))).agg(
            F.sum("_c").alias("c"), F.sum(F.col("_v") * F.col("_c")).alias("s")).first()
        places = k - (self.n - self.ends[i]) - (rest["c"] or 0)
        return sum(self.totals[i + 1:], start=rest["s"] or 0) + places * v

    def quantiles(self, probs: Sequence[float], without: object = None, above: object = None) -> list[float] | None:
        """Linear-interpolated quantiles (numpy's method) of all values, of those
        that differ from ``without`` or of those larger than ``above``; None
        when there are none."""
        low, gap = 0, 0  # ranks left out: below ``low``, or ``gap`` of them from ``low`` on
        if above is not None:
            low = sum(self.counts(above))
            n, rank = self.n - low, lambda r: r + low
        elif without is not None:
            low, gap = self.counts(without)
            n, rank = self.n - gap, lambda r: r if r < low else r + gap
        else:
            n, rank = self.n, lambda r: r
        if n <= 0:
            return None
        pos = [(rank(lo), rank(hi), t) for lo, hi, t in _positions(n, probs)]
        v = self.at([r for lo, hi, _ in pos for r in (lo, hi)])
        return [_lerp(float(v[lo]), float(v[hi]), t) for lo, hi, t in pos]


def index_of(df: DataFrame, value: str, index: OrderStatistics | None) -> OrderStatistics:
    """The given index of ``df``'s column, or a new one."""
    return index if index is not None else OrderStatistics(df, F.col(value))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    tiebreak: Sequence[str] = ()) -> list[float] | None:
    """Linear-interpolated quantiles of the non-null values (numpy method).

    Returns None for an empty column.
    """
    return OrderStatistics(df, F.col(value).cast("double")).quantiles(probs)


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int], n: int,
                     tiebreak: Sequence[str] = ()) -> list:
    """Exact values at 0-based ascending ``ranks`` among the ``n`` non-null
    values of ``value`` (kept in the column's own type, e.g. exact decimals)."""
    found = OrderStatistics(df, F.col(value)).at(ranks)
    return [found[r] for r in ranks]


def steps(q: int) -> list[float]:
    """Probabilities of ``q`` equal bins' edges."""
    return [i / q for i in range(q + 1)]


def qcut_column(col: Column, edges: Sequence[float], labels: Sequence[str],
                on_duplicates: str = "collapse") -> Column:
    """Label column for precomputed edges (right-closed, lowest included).

    ``collapse`` drops repeated edges and labels the remaining bins from the
    lowest label up; ``raise`` mirrors pandas, which refuses labels that do
    not fit the de-duplicated edges.
    """
    uniq = sorted(set(edges))
    if len(uniq) != len(edges):
        if on_duplicates == "raise":
            raise ValueError("Bin edges must be unique for the given labels")
        if len(uniq) == 1:
            return F.when(col == F.lit(uniq[0]), F.lit(labels[0]))
    return cut(col.cast("double"), uniq, list(labels)[: len(uniq) - 1], right=True, include_lowest=True)

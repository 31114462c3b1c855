"""Merkle dataset manifest as a content-addressed DAG (operator 12).

Leaves are row digests; in each source they stand by doc_id, every three
neighbouring nodes hash to one above, and the sources' roots form a tree of
the same kind whose root stands for the dataset.  What is stored is one
record per node: its digest and its children's, keyed by the digest, so equal
subtrees are one record.

Proofs come from descent: from the root a request follows the base-3 digits
of the ranks (of its source, then of its leaf); at each node the record names
the children, the digit selects one and the others join the path.  Requests
with a common prefix descend as one row until they part, so a level costs as
many rows as it has nodes asked for.  Reversed, the path is the proof from
leaf to root.

One range shuffle on (source, doc_id, leaf, running number) ranks the leaves;
a source that holds a third of all rows, or a row that is repeated as often,
spreads over many ranges.  Groups have at most three members.  Only the
largest leaf count, the number of sources and the root reach the driver.

Defined results: a null in a leaf column is ``-``, and a null doc_id stands
first in its source, the null source first of all; rows with one doc_id are
ordered by their digest and equal rows are leaves of their own; rows with a
null doc_id are not tampered with.  Texts are hashed whole.  An empty table
gives no rows.  Extra columns of the input are not part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import materialize, read_table
from shopflow.operators.ordered import PID, global_order, ranged

ARITY = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<digit:int,siblings:array<string>>>"


def encoded(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


# -- leaves --------------------------------------------------------------------
def ranked_leaves(rows: DataFrame, group: str, key: str, leaf: str = "leaf") -> DataFrame:
    """``rows`` with ``tree`` (the group's number, null first), ``pos`` (place in
    it by ``key``) and ``n`` (its size)."""
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col(leaf), F.col("_running")]
    placed = ranged(rows.withColumn("_running", F.monotonically_increasing_id()), order)
    # A row for each stretch of a group within a range.
    parts = placed.groupBy(PID, group).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    groups = global_order(parts.groupBy(group).agg(F.sum("_count").alias("n")), [F.col(group).asc_nulls_first()])
    groups = groups.select(F.col(group).alias("_g"), "n", (F.col("_rank") - 1).alias("tree"))
    parts = parts.join(groups, F.col(group).eqNullSafe(F.col("_g"))).select(
        F.col(PID).alias("_p"), "_g", "n", "tree", (F.col("_before") - F.col("_low")).alias("_shift"))
    out = placed.join(parts, (F.col(PID) == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop(PID, "_at", "_running", "_p", "_g", "_shift")


# -- trees ---------------------------------------------------------------------
class Forest:
    """Trees over leaves (tree, pos, n, digest): ``levels[h - 1]`` has the nodes
    of height h with their children, ``roots`` (tree, digest, height)."""

    def __init__(self, leaves: DataFrame, name: str):
        level = leaves.select("tree", "pos", "n", "digest")
        most = level.agg(F.max("n")).first()[0] or 0
        self.levels: list[DataFrame] = []
        roots = self._ended(level, 0)
        while most > 1:
            above = (level.where(F.col("n") > 1)
                          .groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
                          .agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), "digest"))).alias("_c"))
                          .select("tree", "pos", "n", F.transform("_c", lambda x: x["digest"]).alias("children")))
            level = materialize(above.withColumn("digest", joined_digest(F.col("children"))), f"{name}-{len(self.levels) + 1}")
            self.levels.append(level)
            roots = roots.unionByName(self._ended(level, len(self.levels)))
            most = -(-most // ARITY)
        self.roots = roots

    @staticmethod
    def _ended(level: DataFrame, height: int) -> DataFrame:
        return level.where(F.col("n") == 1).select("tree", "digest", F.lit(height).alias("height"))

    def records(self, height: int) -> DataFrame:
        """The store at one height: digest to children, each digest once."""
        return self.levels[height - 1].select("digest", "children").dropDuplicates(["digest"])


def descend(forest: Forest, starts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(tree, pos, digest, path and the other columns of ``starts``) of the
    requested leaves (tree, pos), of all without ``requests``.

    ``starts``: (tree, digest, height, path, ...) of the roots to descend from.
    The path's segments stand from the root to the leaf.
    """
    kept = [c for c in starts.columns if c not in ("tree", "digest", "height", "path")]
    enter = lambda h: starts.where(F.col("height") == h).select(
        "tree", F.lit(0).cast("bigint").alias("pos"), "digest", "path", *kept)
    wanted = lambda h: requests.select("tree", F.expr(f"pos div {ARITY ** h}").alias("pos")).distinct()
    at = enter(len(forest.levels))
    for height in range(len(forest.levels), 0, -1):
        found = at.join(forest.records(height), "digest").select(
            "tree", "pos", "path", *kept, "children", F.posexplode("children").alias("_digit", "_child"))
        others = F.filter("children", lambda _, i: i != F.col("_digit"))
        step = F.array(F.struct(F.col("_digit").alias("digit"), others.alias("siblings")))
        at = found.select("tree", (F.col("pos") * ARITY + F.col("_digit")).alias("pos"), F.col("_child").alias("digest"),
                          F.concat("path", step).alias("path"), *kept)
        if requests is not None:
            at = at.join(wanted(height - 1), ["tree", "pos"], "left_semi")
        at = at.unionByName(enter(height - 1))
        if height > 1:  # a level's plan ends here; the leaves flow on
            at = materialize(at, f"frontier-{height - 1}")
    if requests is not None and not forest.levels:
        at = at.join(wanted(0), ["tree", "pos"], "left_semi")
    return at


class Manifest:
    """The stored DAG of a table: source trees under one tree of their roots."""

    def __init__(self, leaves: DataFrame):
        self.sources = Forest(leaves, "nodes")
        tops = materialize(self.sources.roots, "subroots")
        n = tops.count()
        self.subroots = tops
        top = tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("bigint").alias("n"), "digest")
        self.top = Forest(top, "top")
        first = self.top.roots.first()
        self.root: str | None = first["digest"] if first else None

    def prove(self, requests: DataFrame | None = None) -> DataFrame:
        """(tree, pos, digest, subroot, path) of the requested leaves; the path
        runs from the leaf to the root."""
        empty = F.array().cast(PATH)
        over = descend(self.top, self.top.roots.withColumn("path", empty),
                       None if requests is None else requests.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos")).distinct())
        starts = materialize(over.select(F.col("pos").alias("tree"), "path")
                                 .join(self.subroots, "tree").withColumn("subroot", F.col("digest")), "starts")
        found = descend(self.sources, starts, requests)
        return found.withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    return joined_digest(F.flatten(F.transform(path, lambda s: s["siblings"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    def up(digest: Column, s: Column) -> Column:
        left, right = F.slice(s["siblings"], F.lit(1), s["digit"]), F.slice(s["siblings"], s["digit"] + 1, F.lit(ARITY))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")), 256)
    return F.aggregate(path, leaf, up)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every leaf's proof by descent, folded with a tampered leaf where
    the doc_id's checksum is even."""
    docs = read_table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    parts = [F.col(c) for c in LEAF_COLUMNS]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    stripped = row_digest([*parts[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    rows = docs.select("doc_id", "source", row_digest(parts).alias("leaf"), F.when(even, stripped).alias("_tampered"))
    leaves = materialize(ranked_leaves(rows, "source", "doc_id").drop("source"), "leaves")
    manifest = Manifest(leaves.withColumnRenamed("leaf", "digest"))
    proofs = manifest.prove().drop("digest")
    root = F.lit(manifest.root).cast("string")
    out = leaves.join(proofs, ["tree", "pos"]).withColumn("folded_root", folded(F.coalesce("_tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == root).alias("verified"))

"""Ranked lexical search over a document FP-tree (operator 11).

For each item the ``k`` best documents by an integer term score.  Documents
are restricted to the items' terms; a document's terms stand by falling
document frequency, so documents with common leading terms share a path of
one tree.  Spark sorts the restricted vectors in that order (range partitions
on path, then doc_id), so every task holds a stretch of the tree.  A task
reads its stretch in pieces of bounded size; each piece is a tree whose nodes
know the largest tf of every term below them and the smallest m.  Both give an
upper bound of any score below, and every item walks the tree depth first,
best child first, leaving out what cannot reach its k-th best so far.  Bounds
use the integer arithmetic of the score, which rises with tf and falls with m,
so nothing is lost; a task's results carry over from piece to piece.  The
tasks' k best of each item are ranked by a window.

Term statistics cover all documents.  The items are taken in blocks of at
most ``BLOCK_TERMS`` (item, term) pairs on average, so what a task holds is
bounded whatever their number; a single item must fit in a task.

Defined results: a null or empty text has no terms and is never found; rows
with one doc_id are documents of their own; with equal scores the smaller
doc_id comes first and null last.  Rows with one item_id (null: one more) are
one item with the terms of all its texts; an item without terms, or with terms
that no document has, gives no rows, as does an empty table.  Texts are taken
whole, in chunks.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import Words, flat_utf8, materialize, read_table, text_chunks

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK_TERMS = 20_000
#: Documents of a page, which are scored together.
PAGE = 64
#: Cells (documents x terms) of a piece of the tree.
PIECE_CELLS = 6_000_000
#: Terms of a path that, with the doc_id, cut the ranges; the sample of them that
#: Spark takes to the driver stays narrow.
HEAD = 6
NO_ID = -(1 << 64)  # orders after every doc_id


# -- items -----------------------------------------------------------------------
def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER_LETTERS, LOWER_LETTERS)
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


class Vocabulary:
    """The distinct terms of a block of items, found in flat lower-cased text."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        data = np.frombuffer("".join(terms).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for t in terms])
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        words = Words.__new__(Words)
        words.start, words.end = starts, ends.astype(np.int64)
        hashes = words.hashes(data)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.data, self.start, self.size = data, starts[self.order], (ends - starts)[self.order]
        #: Terms that may share a hash.
        self.depth = int(np.unique(self.hashes, return_counts=True)[1].max())

    def find(self, data: np.ndarray, words: Words) -> np.ndarray:
        """The term of each word, -1 for others; hashes propose, bytes decide."""
        hashes = words.hashes(data)
        first = np.searchsorted(self.hashes, hashes)
        out = np.full(len(hashes), -1, np.int64)
        for step in range(self.depth):
            at = np.minimum(first + step, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (out < 0) & (self.size[at] == words.end - words.start))
            if not len(hit):
                continue
            at, size = at[hit], (words.end - words.start)[hit]
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            inner = np.arange(int(size.sum())) - np.repeat(begin, size)
            differs = data[np.repeat(words.start[hit], size) + inner] != self.data[np.repeat(self.start[at], size) + inner]
            same = np.add.reduceat(differs, begin) == 0
            out[hit[same]] = self.order[at[same]]
        return out


# -- restricted vectors ------------------------------------------------------------
def _restrict(vocabulary: Vocabulary):
    size = len(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            data, offsets = flat_utf8(batch.column(1))
            data = _LOWER[data]
            words = Words(data, offsets, SEPARATOR)
            found = vocabulary.find(data, words)
            known = found >= 0
            cells, tf = np.unique(words.doc[known] * size + found[known], return_counts=True)
            lists = np.searchsorted(cells, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.count, pa.int64()),
                 pa.ListArray.from_arrays(lists, pa.array(cells % size, pa.int32())), pa.ListArray.from_arrays(lists, pa.array(tf, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])
    return run


def restricted_vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): length in terms and the vocabulary's terms."""
    return docs.select("doc_id", "text").mapInArrow(_restrict(vocabulary), "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _paths(rank: np.ndarray, n_docs: int, n_terms: int):
    """Vectors with their terms as frequency ranks in rising order, and m."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.asarray(batch.column(2).offsets)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists))
            ranks, tf = rank[np.asarray(batch.column(2).flatten())], np.asarray(batch.column(3).flatten())
            order = np.lexsort((ranks, doc))
            lists = (lists - lists[0]).astype(np.int32)
            m = 10 + np.asarray(batch.column(1)) * (90 * n_docs) // n_terms
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m, pa.int64()), pa.ListArray.from_arrays(lists, pa.array(ranks[order], pa.int32())),
                 pa.ListArray.from_arrays(lists, pa.array(tf[order], pa.int32()))], names=["doc_id", "m", "path", "tfs"])
    return run


# -- tree ------------------------------------------------------------------------
def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of tf (one column a term) with lengths m."""
    tf = tf.astype(np.int64)
    return ((1_000_000_000 * tf) // (1000 * tf + 8 * m[:, None])) @ weight


class Piece:
    """A piece of the FP-tree: sorted documents, their shared paths and bounds.

    Nodes cover consecutive documents; a page (a leaf of the walk) holds up to
    ``PAGE`` documents of neighbouring branches.
    """

    def __init__(self, ids: list, m: np.ndarray, paths: np.ndarray, tfs: np.ndarray, lists: np.ndarray, n_terms: int):
        n = len(m)
        self.ids, self.m = ids, m
        self.keys = np.array([NO_ID if i is None else -i for i in ids], object)
        self.tf = np.zeros((n, n_terms), np.int32)
        self.tf[np.repeat(np.arange(n), np.diff(lists)), paths] = tfs
        common = np.zeros(n + 1, np.int64)  # shared terms with the document before
        for i in range(1, n):
            a, b = paths[lists[i - 1]:lists[i]], paths[lists[i]:lists[i + 1]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            common[i] = differ[0] if len(differ) else k
        pages: list[int] = []  # first documents
        nodes: list[tuple[int, int, list[int]]] = []  # first and end page, children (pages as -1 - page)
        self.root = self._grow(0, n, common, pages, nodes)
        starts = np.array(pages)
        self.pages = np.append(starts, n)
        page_tf, page_m = np.maximum.reduceat(self.tf, starts, axis=0), np.minimum.reduceat(m, starts)
        page_key = np.array([max(self.keys[a:b]) for a, b in zip(self.pages, self.pages[1:])], object)
        inner = [(page_tf[a:b].max(axis=0), page_m[a:b].min(), max(page_key[a:b])) for a, b, _ in nodes]
        # Nodes first, then pages from the end, so that index -1 - page is a page.
        self.max_tf = np.concatenate([np.array([x[0] for x in inner], np.int32).reshape(len(inner), n_terms), page_tf[::-1]])
        self.min_m = np.concatenate([np.array([x[1] for x in inner], np.int64), page_m[::-1]])
        self.best_key = np.concatenate([np.array([x[2] for x in inner], object), page_key[::-1]])
        self.children = [np.array(c) for _, _, c in nodes]

    @staticmethod
    def _grow(low: int, high: int, common: np.ndarray, pages: list, nodes: list) -> int:
        """Build the node over documents low..high; an explicit stack, as paths are long."""
        def page(a: int) -> int:
            pages.append(a)
            return -len(pages)

        def branches(a: int, b: int) -> list[tuple[int, int]]:
            """Documents that part at the same depth, small neighbours together."""
            inside = common[a + 1:b]
            cuts = [a, *(a + 1 + np.flatnonzero(inside == inside.min())).tolist(), b]
            out: list[tuple[int, int]] = []
            for x, y in zip(cuts, cuts[1:]):
                if out and y - out[-1][0] <= PAGE:
                    out[-1] = (out[-1][0], y)
                else:
                    out.append((x, y))
            return out

        if high - low <= PAGE:
            return page(low)
        nodes.append((0, 0, []))
        stack = [(0, iter(branches(low, high)))]
        while stack:
            node, rest = stack[-1]
            span = next(rest, None)
            if span is None:
                nodes[node] = (nodes[node][0], len(pages), nodes[node][2])
                stack.pop()
            elif span[1] - span[0] <= PAGE:
                nodes[node][2].append(page(span[0]))
            else:
                nodes.append((len(pages), 0, []))
                nodes[node][2].append(len(nodes) - 1)
                stack.append((len(nodes) - 1, iter(branches(*span))))
        return 0

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return contributions(weight, self.max_tf[np.ix_(nodes, terms)], self.min_m[nodes])

    def search(self, terms: np.ndarray, weight: np.ndarray, best: list, k: int) -> int:
        """Add to ``best``, a heap of the k best (score, -doc_id); returns the pages scored."""
        def hopeless(bound: int, node: int) -> bool:
            return bound <= 0 or (len(best) == k and (bound, self.best_key[node]) <= best[0])

        scored = 0
        start = np.array([self.root])
        stack = [(int(self.bounds(start, terms, weight)[0]), self.root)]
        while stack:
            bound, node = stack.pop()
            if hopeless(bound, node):
                continue
            if node >= 0:
                below = self.children[node]
                found = self.bounds(below, terms, weight)
                for i in np.argsort(found, kind="stable").tolist():
                    if not hopeless(int(found[i]), below[i]):
                        stack.append((int(found[i]), int(below[i])))
                continue
            scored += 1
            a, b = self.pages[-1 - node], self.pages[-node]
            scores = contributions(weight, self.tf[a:b, terms], self.m[a:b])
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                entry = (int(scores[i]), self.keys[a + i])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _search(items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int):
    """Sorted vectors in, the task's k best (item, doc_id, score) out."""
    most = max(PAGE, PIECE_CELLS // max(1, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                lists = np.asarray(part.column(2).offsets)
                piece = Piece(part.column(0).to_pylist(), np.asarray(part.column(1)), np.asarray(part.column(2).flatten()),
                              np.asarray(part.column(3).flatten()), lists - lists[0], n_terms)
                for (terms, weight), heap in zip(items, best):
                    if len(terms):
                        piece.search(terms, weight, heap, k)
        rows = [(i, None if key == NO_ID else -key, score) for i, heap in enumerate(best) for score, key in heap]
        if rows:
            i, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                                             names=["item", "doc_id", "score"])
    return run


def _block(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for a block's (item_id, term) pairs."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(sorted({r["term"] for r in pairs}))
    vectors = materialize(restricted_vectors(docs, vocabulary), "vectors")
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals["docs"]:
        return None
    # One row a term of the block.
    held = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    df = np.array([held.get(i, 0) for i in range(len(vocabulary.terms))], np.int64)
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weight = np.floor(1000 * np.log((2 * totals["docs"] + 2) / (2 * df + 1))).astype(np.int64)

    number = {t: i for i, t in enumerate(vocabulary.terms)}
    of_item: dict = {}
    for r in pairs:
        of_item.setdefault(r["item_id"], []).append(number[r["term"]])
    names = list(of_item)
    items = []
    for name in names:
        terms = np.array([t for t in of_item[name] if df[t]], np.int64)
        items.append((rank[terms], weight[terms]))

    n_terms = int((df > 0).sum())  # terms that occur have the first ranks
    paths = (vectors.where(F.size("terms") > 0)
                    .mapInArrow(_paths(rank, totals["docs"], totals["terms"]), "doc_id bigint, m bigint, path array<int>, tfs array<int>"))
    found = (paths.repartitionByRange(F.slice("path", 1, HEAD), "doc_id").sortWithinPartitions("path", "doc_id")
                  .mapInArrow(_search(items, n_terms, k), "item int, doc_id bigint, score bigint"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    table = spark.createDataFrame(list(enumerate(names)), "item int, item_id bigint")  # a row an item of the block
    return materialize(top.join(F.broadcast(table), "item").select("item_id", "rank", "doc_id", "score"), "found")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    pairs = materialize(item_terms(items), "items")
    blocks = -(-pairs.count() // block_terms)
    block = F.pmod(F.xxhash64(F.col("item_id")), F.lit(max(1, blocks)))
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        rows = pairs.where(block == b).collect()  # one block of the query set
        part = _block(docs, rows, k) if rows else None
        found = found if part is None else found.unionByName(part)
    return found  # an item is in one block


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ten best of all documents for each benchmark item."""
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

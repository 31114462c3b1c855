import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import fptree
from shopflow.llm.common import read_table
from tests.llm.edge import SF, documents, edge_docs, no_docs, with_clashes

TERM = re.compile(fptree.TERM)
ITEMS = [(1, "one TWO étÉ password naïve"), (2, None), (3, "zzzz qqqq"), (4, "w5x5 w1x1 Mit"), (4, "license one"), (None, "id here \U0001f600"), (5, "one")]


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(fptree.UPPER_LETTERS, fptree.LOWER_LETTERS)))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, n in bags:
            m = 10 + 90 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("page,cells,block", [(64, 6_000_000, 20_000), (3, 3000, 20_000), (1, 1, 4)])
def test_edges_equal_brute_force(spark, monkeypatch, page, cells, block):
    monkeypatch.setattr(fptree, "PAGE", page)
    monkeypatch.setattr(fptree, "PIECE_CELLS", cells)
    docs, items = edge_docs(spark), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    clashed = items.withColumn("rank", F.lit("clash")).withColumn("term", F.lit("clash")).withColumn("item", F.lit(1))
    rows = fptree.ranked_search(with_clashes(docs), clashed, block_terms=block)
    assert got(rows) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_query_equals_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    want = brute(docs, items)
    assert got(fptree.query(spark, SF)) == want
    from shopflow.llm.sql import ORACLE_SQL
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert sorted(con.sql(ORACLE_SQL["op11_fptree_search"]).select("item_id, rank, doc_id, score").fetchall(), key=str) == want


def test_ties_of_copies_go_to_the_smallest_ids(spark):
    docs = spark.range(3000).select((3000 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same old words").otherwise("other").alias("text"))
    items = spark.createDataFrame([(1, "old words")], "item_id bigint, text string")
    assert got(fptree.ranked_search(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "old words")])


def _random_piece(rng, n, n_terms):
    bags = sorted(sorted(rng.choice(n_terms, rng.integers(1, 8), replace=False, p=np.arange(n_terms, 0, -1) / sum(range(n_terms + 1)))) for _ in range(n))
    lists = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    paths = np.concatenate(bags)
    return fptree.Piece(list(range(n)), rng.integers(20, 300, n), paths, rng.integers(1, 5, len(paths)), lists, n_terms)


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(fptree, "PAGE", 4)
    rng = np.random.default_rng(5)
    piece = _random_piece(rng, 400, 30)
    pages = len(piece.pages) - 1
    left_out = 0
    for _ in range(40):
        ts = rng.choice(30, 5, replace=False)
        weight = rng.integers(500, 9000, 5)
        scores = fptree.contributions(weight, piece.tf[:, ts], piece.m)
        bound = piece.bounds(np.arange(-pages, len(piece.children)), ts, weight)
        for p in range(pages):  # index -1 - page is a page
            assert bound[pages - 1 - p] >= scores[piece.pages[p]:piece.pages[p + 1]].max()
        best = []
        left_out += pages - piece.search(ts, weight, best, 10)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
    assert left_out > pages  # the bounds do leave subtrees out


def test_shared_hash_is_decided_by_bytes(monkeypatch):
    v = fptree.Vocabulary(["ab", "cd", "efg"])
    v.hashes[:], v.depth = 7, 3
    text = np.frombuffer(b"cd efg ab xy", np.uint8)
    words = fptree.Words(text, np.array([0, len(text)]), fptree.SEPARATOR)
    monkeypatch.setattr(fptree.Words, "hashes", lambda self, data: np.full(len(self.start), 7, np.uint64))
    assert [v.terms[i] if i >= 0 else None for i in v.find(text, words)] == ["cd", "efg", "ab", None]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert fptree.ranked_search(no_docs(spark), items).count() == 0
    assert fptree.ranked_search(documents(spark), items.where("false")).count() == 0
    assert fptree.ranked_search(edge_docs(spark).where("text is null"), items).count() == 0

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from shopflow.llm import manifest
from tests.llm.edge import SF, documents, edge_docs, no_docs, with_clashes


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(nodes):
    """(root, siblings left and right of each node, level by level)"""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // 3 * 3:p // 3 * 3 + 3]
            paths[i].append((run[:p % 3], run[p % 3 + 1:]))
            place[i] = p // 3
        nodes = [sha(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        sub[s] = tree([x[2] for x in groups[s]])
    root, above = tree([sub[s][0] for s in order])
    out = []
    for s, high in zip(order, above):
        for (_, _, digest, r), low in zip(groups[s], sub[s][1]):
            path = low + high
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            fold = leaf(r, r.text.replace("\n", "") if r.text is not None and even else r.text)
            for a, b in path:
                fold = sha(*a, fold, *b)
            out.append((r.doc_id, digest, sub[s][0], root, sha(*[x for a, b in path for x in a + b]), fold, fold == root))
    return sorted(out, key=str)


def run(spark, docs, monkeypatch):
    monkeypatch.setattr(manifest, "read_table", lambda *_: docs)
    df = manifest.query(spark, "")
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("make", [edge_docs, documents])
def test_equals_brute_force(spark, make, monkeypatch):
    docs = make(spark)
    assert run(spark, with_clashes(docs), monkeypatch) == brute(docs.collect())


@pytest.mark.parametrize("n", [0, 1, 3, 28])
def test_tree_shapes(spark, n, monkeypatch):
    docs = spark.range(n).select((-F.col("id")).alias("doc_id"), F.lit("line\nline").alias("text"), F.lit("en").alias("lang"),
                                 F.when(F.col("id") < 4, None).otherwise("s").alias("source"), F.lit(9).alias("n_chars"))
    assert run(spark, docs, monkeypatch) == (brute(docs.collect()) if n else [])


def test_repeated_row_spreads_over_ranges(spark):
    docs = spark.range(6000).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("leaf"))
    rows = manifest.ranked_leaves(docs, "source", "doc_id")
    assert sorted(r.pos for r in rows.collect()) == list(range(6000))
    forest = manifest.Forest(rows.withColumnRenamed("leaf", "digest"), "copies")
    assert forest.records(1).count() == 1  # equal subtrees are one record


def test_requested_leaves_only(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "source", manifest.row_digest([F.col(c) for c in manifest.LEAF_COLUMNS]).alias("leaf"))
    leaves = manifest.materialize(manifest.ranked_leaves(rows, "source", "doc_id").drop("source"), "leaves")
    store = manifest.Manifest(leaves.withColumnRenamed("leaf", "digest"))
    asked = leaves.where("doc_id % 7 = 0").select("tree", "pos")
    every = {(r.tree, r.pos): r for r in store.prove().collect()}
    some = {(r.tree, r.pos): r for r in store.prove(asked).collect()}
    assert set(some) == {(r.tree, r.pos) for r in asked.collect()}
    assert all(every[k] == v for k, v in some.items())


def test_sql(spark):
    from shopflow.llm.sql import ORACLE_SQL
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = con.sql(ORACLE_SQL["op12_manifest_descent"]).select("doc_id, leaf, subroot, root, proof_sha256, folded_root, verified").fetchall()
    assert sorted(sql, key=str) == brute(documents(spark).collect())


def test_no_rows(spark, monkeypatch):
    assert run(spark, no_docs(spark), monkeypatch) == []

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopflow.llm import sharding as H
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes


@pytest.mark.parametrize("make,n,bucket", [(documents, 16, 8 << 20), (documents, 16, 4000), (edge_docs, 5, 100)])
def test_law_slots_and_contents(spark, make, n, bucket):
    docs = make(spark)
    rows = H.external_shuffle(docs, n, bucket_bytes=bucket).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in rows) == Counter(
        (r.doc_id, r.text, len((r.text or "").encode()) + 1) for r in docs.collect())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    counts = [len(shards.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_query_digests(spark):
    got = {r.doc_id: r for r in H.query(spark, "/root/testdata/sf0.001").collect()}
    for r in documents(spark).collect():
        assert got[r.doc_id].text_crc32 == zlib.crc32(r.text.encode()) and got[r.doc_id].law == "rows" and got[r.doc_id].grown_shard is None


def test_same_seed_same_order_other_seed_another(spark):
    docs = documents(spark)
    def order(seed):
        return [r.doc_id for r in H.external_shuffle(docs, 4, seed=seed).orderBy("position").collect()]
    first = order(1)
    assert first == order(1) != order(2)
    moved = sum(abs(a - i) > 10 for i, a in enumerate(first))
    assert moved > 0.7 * len(first)


def test_equal_rows_spread_over_buckets(spark):
    docs = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text")).repartition(4)
    rows = H.external_shuffle(docs, 4, bucket_bytes=2000).groupBy("shard").count().collect()
    assert {r["count"] for r in rows} == {1000}


def test_edges(spark):
    assert H.external_shuffle(with_clashes(edge_docs(spark)), 3).count() == edge_docs(spark).count()
    assert H.external_shuffle(no_docs(spark)).count() == 0

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import quality as Q
from shopflow.llm.common import read_table
from tests.llm.edge import edge_docs, no_docs, with_clashes

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    train, test = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    rows = Q.classify(docs, train).join(test, "doc_id").select("kept", "p_low", "p_toxic", "quality", "toxic").collect()
    low = [r.p_low > 0.5 for r in rows if r.quality == 0]
    toxic = [r.p_toxic > 0.5 for r in rows if r.toxic == 1]
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(low) / len(low) > 0.9
    assert sum(toxic) / len(toxic) > 0.85
    assert sum(clean) / len(clean) > 0.99


def test_sparse_sites_shrink_and_bad_hosts_raise(spark):
    """Documents without evidence of their own: a bad host's prior counts, a single bad document's does not."""
    rows = [(f"bad{i % 3}", "p", 3.0) for i in range(300)] + [(f"good{i % 30}", "p", -4.0) for i in range(900)]
    rows += [("bad0", "p", 0.0), ("good0", "p", 0.0), ("new", "p", 0.0), ("tiny", "p", 3.0), ("tiny", "p", 0.0)]
    frame = spark.createDataFrame(rows, "host string, path string, x_low double").withColumn("x_toxic", F.col("x_low"))
    p = {r.host: r.p_low for r in Q.posteriors(frame).where("x_low = 0").collect()}
    assert p["bad0"] > 0.6 > p["good0"] and p["good0"] < p["new"] < p["bad0"]
    assert p["new"] <= p["tiny"] < p["bad0"]


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 0, 0), (5, 1, 0), (8, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = with_clashes(edge_docs(spark))
    out = Q.classify(docs, labels)
    assert out.count() == docs.count() and out.where("kept is null").count() == 0
    assert Q.keep_good(docs, labels).columns == docs.columns
    nobody = labels.limit(0)
    assert Q.keep_good(docs, nobody).count() == docs.count()
    assert Q.classify(no_docs(spark), labels).count() == 0
    assert Q.keep_good(no_docs(spark), nobody).count() == 0


def test_posteriors_equal_plain_python(spark):
    """The grouped aggregation against the formulas over plain lists."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 41 == 0 else f"h{int(rng.integers(0, 9))}", None if i % 17 == 0 else f"p{int(rng.integers(0, 4))}",
             float(rng.normal(-1, 2)), float(rng.normal(-3, 1))) for i in range(500)]
    frame = spark.createDataFrame(rows, "host string, path string, x_low double, x_toxic double").repartition(5)
    got = sorted((str(r.host), str(r.path), r.x_low, r.p_low, r.p_toxic) for r in Q.posteriors(frame).collect())

    def strength(groups):
        """groups: (mean, rate, n)"""
        spread = sum(n * ((rate - m) ** 2 - m * (1 - m) / n) for m, rate, n in groups) / sum(m * (1 - m) * n for m, rate, n in groups)
        share = min(0.99, max(0.001, spread))
        return min(1000.0, max(1.0, (1 - share) / share))

    want = {}
    for t, target in enumerate(("low", "toxic")):
        own = [1 / (1 + math.exp(-r[2 + t])) for r in rows]
        world = sum(own) / len(own)
        hosts, paths = {}, {}
        for (h, p, *_), s in zip(rows, own):
            hosts.setdefault(h, []).append(s)
            paths.setdefault((h, p), []).append(s)
        k_host = strength([(world, sum(v) / len(v), len(v)) for v in hosts.values()])
        rate = {h: (sum(v) + k_host * world) / (len(v) + k_host) for h, v in hosts.items()}
        k_path = strength([(rate[h], sum(v) / len(v), len(v)) for (h, _), v in paths.items()])
        for i, ((h, p, *x), s) in enumerate(zip(rows, own)):
            host = (sum(hosts[h]) - s + k_host * world) / (len(hosts[h]) - 1 + k_host)
            path = (sum(paths[h, p]) - s + k_path * host) / (len(paths[h, p]) - 1 + k_path)
            path = min(max(path, 1e-6), 1 - 1e-6)
            odds = x[t] + math.log(path / (1 - path)) - math.log(world / (1 - world))
            want.setdefault(i, []).append(1 / (1 + math.exp(-odds)))
    expected = sorted((str(r[0]), str(r[1]), r[2], *want[i]) for i, r in enumerate(rows))
    for a, b in zip(got, expected, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


def test_a_label_on_very_many_rows_stays_one_row_of_the_fit(spark, monkeypatch):
    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word other "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 0, 0), (2950, 1, 0), (2960, 1, 1)], "doc_id bigint, quality int, toxic int")
    kept = []
    keep = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: kept.append((name, keep(df, name))) or kept[-1][1])
    Q.fit(docs, labels, "text")
    assert dict(kept)["labelled"].count() == 3

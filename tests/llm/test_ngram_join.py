import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import ngram_join as J
from shopflow.session import settings
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_force(rows, width, threshold):
    """[(doc_id, size, component id)] by comparing all rows that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            parent[top(a)] = top(b)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[top(i)] = min(doc_id, lowest.get(top(i), doc_id))
    return sorted(((d, len(s), lowest.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def mutated_families(seed=5):
    """Families of texts edited by a few to many words, some around the threshold."""
    rnd = random.Random(seed)
    rows, n = [], 0
    for family in range(14):
        base = [f"f{family}t{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 5, 9, 20, 45, 120, 400]))]
        for copy in range(9):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, len(words) // 18))):
                i = rnd.randrange(len(words))
                if rnd.random() < 0.5:
                    words[i] = f"n{rnd.randrange(10**6)}"
                elif rnd.random() < 0.5:
                    del words[i]
                    words = words or ["x"]
                else:
                    words.insert(i, f"m{rnd.randrange(10**6)}")
            rows.append((n, " ".join(words)))
            n += 1
    passage = " ".join(f"shared{i}" for i in range(60))
    for k in range(40):
        rows.append((n, f"{passage} " + " ".join(f"own{k}x{i}" for i in range(rnd.choice([5, 12, 60])))))
        n += 1
    return rows


@pytest.mark.parametrize("width,threshold", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, threshold):
    rows = mutated_families()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(J.components(frame, width=width, threshold=threshold)) == brute_force(rows, width, threshold)


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert got(J.components(documents(spark))) == brute_force(rows, 4, 85)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute_force(rows, 4, 85)
    assert got(J.components(docs)) == expected
    assert got(J.components(with_clashes(docs))) == expected
    assert J.components(no_docs(spark)).count() == 0


def test_keep_first_keeps_one_of_each_component(spark):
    docs = with_clashes(edge_docs(spark))
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 not in ids and 5 in ids          # the second copy of the long text goes
    assert ids.count(4) == 3 and ids.count(None) == 2


def test_allocation_always_covers_the_bound():
    """Whatever a set may link to, its units of tolerance exceed the differing shingles."""
    for t in (80, 85):
        bands = J.Bands(t)
        size = np.arange(1, 5000)
        for cross in (False, True):
            band, m, d, spare = bands.plan(size, cross)
            used = m > 0
            assert (spare[used] >= 0).all()
        low = -(-t * size // 100)
        assert (bands.of(size) - bands.of(low) <= 1).all()


def test_hot_family_is_not_expanded_into_pairs(spark):
    """Thousands of near copies: far fewer verified pairs than pairs of members."""
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rnd.randrange(150)] = f"own{i}"
        rows.append((i, " ".join(words)))
    seen = []
    real = J._verified
    try:
        J._verified = lambda pairs, *a, **k: (seen.append(pairs.count()), real(pairs, *a, **k))[1]
        out = J.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        J._verified = real
    assert {r.component_id for r in out} == {0}
    assert sum(seen) < 10 * len(rows)


def test_parity_maps_never_exceed_the_difference():
    rnd = np.random.default_rng(4)
    a = np.unique(rnd.integers(0, 1 << 62, 300).astype(np.uint64))
    for cut, new in ((0, 0), (5, 9), (120, 80), (300, 300)):
        b = np.unique(np.concatenate([a[cut:], rnd.integers(0, 1 << 62, new).astype(np.uint64)]))
        both = np.concatenate([a, b])
        maps = J.parity_maps(np.array([0, len(a), len(both)]), both)
        bits = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in maps[0] ^ maps[1])
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0) == (cut + new > 0)


def test_signature_counts_are_written_before_the_rows_are_shuffled(spark, monkeypatch):
    names, real = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, name: (names.append(name), real(df, name))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 2}") for i in range(6)], "doc_id bigint, text string")
    assert J.components(docs).count() == 6
    assert names.index("shared") < names.index("hits")


def test_borderline_family_is_contracted_before_its_pairs_are_listed(spark, monkeypatch):
    """Near copies of which about half the pairs are linked: neither the open pairs
    nor the links whose components are found grow with the square of the family."""
    rnd = random.Random(6)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 2, 2, 3])):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    sizes = defaultdict(int)

    def counting(name):
        real = getattr(J, name)
        monkeypatch.setattr(J, name, lambda df, *a, **k: (sizes.__setitem__(name, sizes[name] + df.count()), real(df, *a, **k))[1])

    counting("_verified")
    counting("connected_components")
    found = J.components(spark.createDataFrame(rows, "doc_id bigint, text string"), width=5, threshold=80)
    assert got(found) == brute_force(rows, 5, 80)
    assert sizes["connected_components"] < 3 * len(rows), sizes
    assert sizes["_verified"] < 6 * len(rows), sizes


def test_open_pairs_shuffle_their_prefixes_once(spark, monkeypatch):
    """Holders are written before the shingles are shuffled; both sides of the self-join read one shuffle."""
    names, real = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, name: (names.append(name), real(df, name))[1])
    lists = [(i * 8, i * 8, [*range(40), 100 + i], [0] * J.PARITY_WORDS) for i in range(6)]
    shingles = spark.createDataFrame(lists, "sid bigint, component bigint, shingles array<bigint>, parity array<bigint>").withColumn("n", F.size("shingles"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        pairs = J._open_pairs(shingles.select("sid", "component"), shingles.drop("component"), 85)
        assert pairs.count() == 15
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan, plan
    assert names.count("holders") == 2 and names.index("holders") < names.index("open")

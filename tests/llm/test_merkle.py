import hashlib

import pytest

from pyspark.sql import functions as F

from shopflow.llm import merkle as M
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes


def brute_force(rows):
    """Rows in descending doc_id (nulls last); equal ids in any order: a set of allowed results per row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + nxt[:half]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), str(M.Tree(text)), str(M.Tree(new)),
                    M.likeness(str(M.Tree(text)), str(M.Tree(new))), M.likeness(str(M.Tree(text)), str(M.Tree(nxt)))))
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_documents_equal_brute_force(spark, ranges):
    docs = documents(spark)
    expected = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(rows_of(M.edit_fingerprints(docs, ranges=ranges))) == sorted(expected)


def test_edges(spark):
    docs = edge_docs(spark)
    for frame in (docs, with_clashes(docs)):
        out = rows_of(M.edit_fingerprints(frame, ranges=5))
        assert sorted((r[0], r[1]) for r in out if r[0] is not None) == sorted((r.doc_id, len(r.text or "")) for r in docs.collect() if r.doc_id is not None)
        assert len(out) == docs.count()
        by_text = {}
        for r in docs.collect():
            by_text.setdefault(r.text or "", set()).add(r.doc_id)
        for r in out:
            assert any(r[0] in ids and r[3] == str(M.Tree(t)) for t, ids in by_text.items())
    unique = docs.where("doc_id in (5, 6, 7, 8, 2)")
    assert sorted(rows_of(M.edit_fingerprints(unique, ranges=3))) == sorted(brute_force([(r.doc_id, r.text) for r in unique.collect()]))
    assert M.edit_fingerprints(no_docs(spark)).count() == 0
    one = docs.where("doc_id = 8")
    (row,) = rows_of(M.edit_fingerprints(one))
    assert row == brute_force([(r.doc_id, r.text) for r in one.collect()])[0] and row[6] == 1.0


def test_edits_are_located_and_likeness_is_graded():
    lines = [f"Paragraph {i} says {i * 7}. It goes on. And ends {i}!" for i in range(40)]
    a = str(M.Tree("\n".join(lines)))
    assert M.likeness(a, a) == 1.0 and M.changed_paragraphs(a, a) == []
    changed = list(lines)
    changed[17] = "Something else stands here now."
    b = str(M.Tree("\n".join(changed)))
    assert M.changed_paragraphs(a, b) == [17] and M.changed_paragraphs(b, a) == [17]
    assert 0.9 < M.likeness(a, b) < 1
    inserted = str(M.Tree("\n".join(["New first line."] + lines)))
    assert 0.95 < M.likeness(a, inserted) < 1 and M.changed_paragraphs(inserted, a) == [0]
    other = str(M.Tree("\n".join(f"Wholly other {i} text." for i in range(40))))
    assert M.likeness(a, other) == 0.0
    assert M.likeness(str(M.Tree("")), a) == 0.0 and M.likeness(str(M.Tree("")), str(M.Tree(""))) == 1.0
    assert str(M.Tree("x")) != str(M.Tree("x\n")) and str(M.Tree("a. b")) != str(M.Tree("a.\n b"))


def test_fingerprints_of_equal_texts_are_equal(spark):
    rows = M.fingerprints(edge_docs(spark)).collect()
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1 and len(rows) == edge_docs(spark).count()


def test_smallest_id_and_a_key_that_fills_several_ranges(spark):
    rows = [(-(1 << 63), "first of all"), ((1 << 63) - 1, "last of all"), (0, "zero")] + [(7, "the same row. " * 3)] * 600
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = M.edit_fingerprints(docs, ranges=12)
    assert sorted(rows_of(out)) == sorted(brute_force(rows))
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 8 and max(shares) < 250

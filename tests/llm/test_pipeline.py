import itertools
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from shopflow.llm import packing
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Every stage keeps the columns, drops only what its operator rejects, and the last packs what is left."""
    docs = documents(spark)
    columns = docs.columns
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        left = {r.doc_id for r in out.collect()}
        assert left <= ids and left, name
        if name == "secret_scan":
            assert left == ids
        ids, docs = left, out
    final = corpus_pipeline.run(spark, SF)
    rows = final.collect()
    assert {i for r in rows for i in r.doc_ids} == ids
    want = {r.doc_id: r.text for r in docs.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in rows:
        assert r.n_tokens <= packing.CAPACITY and len(r.ids) == 4 * r.n_tokens
        for doc, start, length, offset in zip(r.doc_ids, r.starts, r.lengths, r.offsets):
            pieces.setdefault(doc, {})[start] = np.frombuffer(r.ids, "<u4")[offset:offset + length].tolist()
    for doc, parts in pieces.items():
        assert sum((parts[s] for s in sorted(parts)), []) == tokenizer.encode(want[doc], add_special_tokens=False).ids + [packing.END_ID]


def test_stages_take_awkward_tables(spark):
    for docs in (edge_docs(spark), with_clashes(edge_docs(spark)), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0, name
            if name != "packing":
                assert out.columns == docs.columns, name


def test_what_each_stage_keeps(spark):
    """Rules and classifier keep what their operators' verdicts keep; near duplicates equal plain Python."""
    from shopflow.llm import perplexity, quality
    from shopflow.llm.common import read_table
    docs, stages = documents(spark), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(stages["quality_rules"](spark, docs, SF)) == ids(perplexity.query(spark, SF).where("kept"))
    labels = read_table(spark, SF, "labels")
    assert ids(stages["quality_classifier"](spark, docs, SF)) == ids(quality.classify(docs, labels).where("kept"))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    first = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and first[a] != first[b]:
            low, high = sorted((first[a], first[b]))
            first = {i: low if f == high else f for i, f in first.items()}
    assert ids(stages["near_duplicates"](spark, docs, SF)) == sorted(i for i, f in first.items() if i == f)

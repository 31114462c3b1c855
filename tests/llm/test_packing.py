import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopflow.llm import packing as P
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from(" \n\t'sSéÉ́Jǰ̌\x1c 　<|>endoftext")), max_size=60))
def test_chunks_give_the_ids_of_the_whole_text(text):
    t = Tokenizer.from_file(PATH)
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(P.ChunkIds(PATH).encode([text])[0], "<u4").tolist()
    assert got == t.encode(text, add_special_tokens=False).ids


def check(rows, docs, tokenizer):
    expected = Counter()
    for r in docs.collect():
        ids = np.array(ids_of(tokenizer, r.text), "<u4")
        for s in range(0, len(ids), P.CAPACITY):
            part = ids[s:s + P.CAPACITY]
            expected[r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return sequences


def test_documents_whole_and_tight(spark, tokenizer):
    docs = documents(spark, "/root/testdata/sf0.01")
    sequences = check(P.packed_documents(docs).collect(), docs, tokenizer)
    used = sum(length for parts in sequences.values() for _, length in parts)
    assert used > 0.98 * P.CAPACITY * (len(sequences) - 1)


def test_edges(spark, tokenizer):
    check(P.packed_documents(with_clashes(edge_docs(spark))).collect(), edge_docs(spark), tokenizer)
    assert P.packed_documents(no_docs(spark)).count() == 0


def test_sequences_hold_the_documents_ids(spark, tokenizer):
    docs = edge_docs(spark)
    found = P.pieces(docs, PATH)
    rows = {r.sequence_id: r for r in P.sequences(found, group_tokens=3000).collect()}
    placed = P.pack(found, group_tokens=3000).join(found.select("row", "start", "ids"), ["row", "start"]).collect()
    for r in placed:
        s = rows[r.sequence_id]
        assert s.ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert (r.doc_id, r.start, r.length, r.offset) in zip(s.doc_ids, s.starts, s.lengths, s.offsets)
    assert sum(len(s.doc_ids) for s in rows.values()) == len(placed)
    assert all(len(s.ids) == 4 * s.n_tokens == 4 * sum(s.lengths) and s.n_tokens <= P.CAPACITY for s in rows.values())
    assert P.sequences(P.pieces(no_docs(spark), PATH)).count() == 0


def test_special_tokens_in_texts_are_the_librarys(tokenizer):
    texts = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> c.", "<|ENDOFTEXT|> É É<|endoftext|>É", "x<| y|>", "Ünder, straße... ÀÉ!! it's don't #%$ w$$$ 12ab a1 ÿ.%%% µ ª", "’quoted’"]
    encoder = P.ChunkIds(PATH)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert 49407 in np.frombuffer(encoder.encode([texts[0]])[0], "<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_equals_plain_first_fit_decreasing(sizes):
    where, offset = P.first_fit_decreasing(np.array(sizes, np.int64), 64)
    bins, expected = [], {}
    for p in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((i for i, used in enumerate(bins) if used + sizes[p] <= 64), len(bins))
        if b == len(bins):
            bins.append(0)
        expected[p] = (b, bins[b])
        bins[b] += sizes[p]
    assert [(int(a), int(b)) for a, b in zip(where, offset)] == [expected[i] for i in range(len(sizes))]

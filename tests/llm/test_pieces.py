import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from shopflow.llm import pieces as E
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\n▁éＡ①ﬁ́　ab<s>0x41")), max_size=50)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


CODER = E.PieceCoder(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_decoding_and_spans(text):
    ids, spans = CODER.encode(text)
    assert ids == LIBRARY.encode(text)
    (entries, _), = CODER.units([text])
    assert CODER.decoded(entries).decode() == LIBRARY.decode(ids)
    data = text.encode()
    if len(spans):
        assert spans[0, 0] == 0 and spans[-1, 1] == len(data) and (spans[1:, 0] == spans[:-1, 1]).all()
        for i, (a, b) in zip(ids, spans):
            piece = LIBRARY.id_to_piece(i)
            if not LIBRARY.is_byte(i) and "▁" not in text:
                assert data[a:b].decode() in (piece.replace("▁", " "), piece.removeprefix("▁").replace("▁", " "))


def with_character_map(name, **spec):
    """The public model with another normaliser's compiled character map."""
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    source = pb.ModelProto()
    source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto())
    model.normalizer_spec.CopyFrom(source.normalizer_spec)
    for k, v in {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, **spec}.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


@pytest.fixture(scope="module", params=[("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", True)])
def mapped(request):
    name, squeeze = request.param
    proto = with_character_map(name, remove_extra_whitespaces=squeeze)
    return E.PieceCoder(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


def test_compiled_character_map(mapped):
    coder, library = mapped

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def same(text):
        ids, spans = coder.encode(text)
        assert ids == library.encode(text)
        assert (spans[:, 0] <= spans[:, 1]).all() and (not len(spans) or spans[-1, 1] <= len(text.encode()))
    same()
    ids, spans = coder.encode("ｆｕｌｌ ①  ﬁn")
    data = "ｆｕｌｌ ①  ﬁn".encode()
    assert "".join(data[a:b].decode() for a, b in spans).replace(" ", "") == "ｆｕｌｌ①ﬁn"


def check(docs, library):
    expected = {}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        expected.setdefault(r.doc_id, set()).add((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                                  hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((r.text or "").encode())))
    rows = E.digests(docs, PATH).collect()
    assert len(rows) == docs.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.covered_bytes) in expected[r.doc_id] for r in rows)


def test_documents_equal_the_library(spark, library):
    check(documents(spark, "/root/testdata/sf0.01"), library)


def test_edges(spark, library):
    check(edge_docs(spark), library)
    check(with_clashes(edge_docs(spark)), library)
    assert E.digests(no_docs(spark), PATH).count() == 0


def test_arrays(spark, library):
    docs = documents(spark).limit(30)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in E.encode(docs, PATH).collect():
        assert r.ids == library.encode(text[r.doc_id]) and r.decoded == library.decode(r.ids)
        assert r.starts[0] == 0 and r.ends[-1] == len(text[r.doc_id].encode()) and np.all(np.array(r.starts[1:]) == np.array(r.ends[:-1]))


def test_long_texts_are_cut_at_edges(library, monkeypatch):
    monkeypatch.setattr(E, "SEGMENT", 8)
    for text in ("one two  three\n\nfour " * 30, "x" * 100, "  \n \n" * 20, "word" * 9 + " " + "é\U0001f600" * 20 + "\n" + "▁ ▁a" * 5):
        ids, spans = CODER.encode(text)
        assert ids == library.encode(text) and spans[-1, 1] == len(text.encode())
        (entries, _), = CODER.units([text])
        assert CODER.decoded(entries).decode() == library.decode(ids)
    norm = "▁one▁two▁▁three\n\nfour"
    assert "".join(CODER.segments(norm)) == norm and len(CODER.segments(norm)) > 1

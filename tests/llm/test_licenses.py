import random
import re

from shopflow.llm import licenses as L
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for label, phrase in L.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(docs):
    rows = L.scan(docs).collect()
    expected = sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == expected
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    return rows


def test_documents_equal_brute_force(spark):
    rows = check(documents(spark, "/root/testdata/sf0.01"))
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3"} <= {x for r in rows for x in r.labels.split(",")}


TEXTS = [
    "Under the MIT license. under the mit  LICENSE! cc by nc cc by nc cc-by-nc Apache License, Version 2.0",
    "under the mit licence", "cc by", "by nc cc", "", "éunder the mit license", "under the mit license" * 3,
    "underthe mit license version 2 apache license version apache license version 2", "Under THE mİt license under the mit́ license cc byK nc",
]


def test_tricky_texts_and_edges(spark):
    check(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"))
    check(edge_docs(spark))
    check(with_clashes(edge_docs(spark)))
    assert L.scan(no_docs(spark)).count() == 0


def test_changed_templates_are_found(spark):
    mit = L.TEMPLATES[0][1].split()
    dropped = mit[:10] + mit[11:25] + ["extra", "words"] + mit[25:]
    texts = [" ".join(mit), "intro " * 50 + " ".join(dropped) + " tail", " ".join(mit[:12]), " ".join(reversed(mit)),
             " ".join(x for i, w in enumerate(mit) for x in (w, *(["noise"] if i % 2 else [])))]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows[0].labels == "mit" and rows[0].score == 1.0 and rows[0].n_base == 0
    assert rows[1].labels == "mit" and 0.6 < rows[1].score < 1
    assert all(rows[i].labels == "" and rows[i].score == 0 for i in (2, 3, 4))


# A whole public license.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return list(zip(w, w[1:], w[2:]))


def on_diagonal(text, template, offset=0):
    """Share of the template's 3-grams that stand at their own places in the text."""
    have, want = grams(text)[offset:], grams(template)
    return sum(a == b for a, b in zip(have, want)) / len(want)


def anywhere(text, template):
    """Share of the template's 3-grams that stand in the text."""
    have, want = set(grams(text)), grams(template)
    return sum(g in have for g in want) / len(want)


def test_whole_licenses_are_templates(spark):
    draw = random.Random(5)
    long = " ".join(f"clause{draw.randrange(900)}" for _ in range(2000))  # 32 blocks of 64
    templates = [("mit-text", MIT), ("long", long)]
    cut = long.split()
    cut[700:702] = []
    cut[1200:1200] = ["put", "in"]
    texts = [MIT, "before " * 70 + MIT.lower() + " after", MIT[:400], MIT.replace("Software", "Program"), long, "x " * 99 + " ".join(cut),
             " ".join(long.split()[:1100]), " ".join(reversed(cut)), MIT + "\n" + long, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in L.scan(docs, templates=templates).collect()}
    labels = {i: r.labels for i, r in rows.items()}
    assert labels == {0: "mit-text", 1: "mit-text", 2: "", 3: "mit-text", 4: "long", 5: "long", 6: "", 7: "", 8: "long,mit-text", 9: ""}
    assert [rows[i].score for i in (0, 1, 4)] == [on_diagonal(MIT, MIT), on_diagonal(texts[1], MIT, 70), 1.0] == [1.0] * 3
    # Words replaced one by one leave one diagonal; words cut out and put in leave
    # two that are near, and no 3-gram of this template stands elsewhere.
    assert abs(rows[3].score - on_diagonal(texts[3], MIT)) < 1e-9 and rows[3].score < 1
    assert abs(rows[5].score - anywhere(texts[5], long)) < 1e-9 and rows[5].score < 1


def test_many_template_grams_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(0, MIT), (1, TEXTS[0]), (2, None)], "doc_id bigint, text string")
    few = sorted(L.scan(docs).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 0)
    assert sorted(L.scan(docs).collect(), key=lambda r: r.doc_id) == few

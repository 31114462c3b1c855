import re
from collections import Counter

import numpy as np

from shopflow.llm import perplexity as P
from tests.llm.edge import documents, edge_docs, no_docs, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def as_rows(frame):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in frame.collect()), key=str)


def test_rule_counts_equal_brute_force(spark):
    for docs in (documents(spark), edge_docs(spark), with_clashes(edge_docs(spark))):
        expected = sorted(((r.doc_id, *rules(r.text)) for r in docs.collect()), key=str)
        out = P.quality_rules(docs)
        assert as_rows(out) == expected
        assert all(r.kept is not None and not (r.kept and r.base_failed) for r in out.collect())


def test_empty_table(spark):
    assert P.quality_rules(no_docs(spark)).count() == 0
    assert P.keep_good(no_docs(spark)).count() == 0


def test_counts_cover_every_text(spark):
    docs = documents(spark)
    n = P.count_grams(docs).where("order = 4").agg({"n": "sum"}).first()[0]
    assert n == sum(max(0, len(r.text) - 3) for r in docs.collect())


def test_model_is_a_distribution():
    """Kneser-Ney probabilities of all characters after a context sum to about one."""
    text = ("the cat sat on the mat and the dog sat on the log " * 40).encode()
    data, offsets, langs = np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([7], np.uint64)
    slots, _ = P.gram_slots(data, offsets, langs)
    rows = {}
    for k in P.SLOT_BITS:
        seen, at, n = np.unique(slots[k], return_index=True, return_counts=True)
        rows[k] = {"slot": seen, "n": n, "context": slots["ctx", k][at] if k > 1 else 0 * seen,
                   "suffix": slots[k - 1][at] if k > 1 else 0 * seen}
    scorer = P.Scorer(P.kneser_ney(rows))
    letters = sorted(set(text.decode()))
    for context in ("the", "sat", " on", "zzz"):
        total = 0.0
        for c in letters:
            d = np.frombuffer((context + c).encode(), np.uint8)
            s, _ = P.gram_slots(d, np.array([0, 4]), langs)
            total += float(np.exp(scorer.log_p(s, 4))[0])
        assert 0.8 < total < 1.02, (context, total)


def test_bands_reject_foreign_text(spark):
    """Texts of random letters stand out among plain ones; plain ones stay."""
    rnd = np.random.default_rng(1)
    vocabulary = ["the", "house", "river", "walks", "under", "green", "stone", "people", "water", "light", "night", "winter"]
    plain = [(i, " ".join(rnd.choice(vocabulary, 120)), "en", "s", 0) for i in range(300)]
    odd = [(1000 + i, " ".join("".join(rnd.choice(list("bcdfgjkqvxz"), 6)) for _ in range(120)), "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(plain + odd, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id: r.kept for r in P.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(3))


def test_bands_reject_labelled_junk(spark):
    """Of the labelled documents that pass the base rules the bands reject junk and keep nearly all good ones."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in P.read_table(spark, sf, "labels").collect()}
    rows = [r for r in P.quality_rules(documents(spark, sf)).collect() if not r.base_failed]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    assert junk.count(False) >= 0.2 * len(junk), (junk.count(False), len(junk))
    assert good.count(True) >= 0.95 * len(good), (good.count(True), len(good))


def test_copies_do_not_teach_their_own_score(spark):
    """A text is as surprising with a hundred copies of it in the table as alone."""
    rnd = np.random.default_rng(2)
    vocabulary = ["the", "house", "river", "walks", "under", "green", "stone", "people", "water", "light", "night", "winter"]
    plain = [(i, " ".join(rnd.choice(vocabulary, 120)), "en", "s", 0) for i in range(300)]
    odd = " ".join("".join(rnd.choice(list("bcdfgjkqvxz"), 6)) for _ in range(120))
    scores = []
    for copies in (1, 100):
        docs = spark.createDataFrame(plain + [(1000 + i, odd, "en", "s", 0) for i in range(copies)],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint")
        out = {r.doc_id: r for r in P.quality_rules(docs).collect()}
        assert not any(out[1000 + i].kept for i in range(copies))
        assert len({out[1000 + i].perplexity for i in range(copies)}) == 1
        scores.append(out[1000].perplexity)
    assert np.isclose(*scores)


def test_model_counts_every_gram_and_grows(spark):
    """One row per (fold, language, n-gram): no slots, no collisions, whatever the corpus."""
    docs = documents(spark)
    grams = {}
    for r in docs.collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        fold = int(P.text_folds(data, np.array([0, len(data)]))[0])
        padded = "\0" * P.ORDER + r.text
        for end in range(P.ORDER + 4, len(padded) + 1):
            for k in P.SLOT_BITS:
                grams.setdefault((fold, k), Counter())[r.lang, padded[end - k:end]] += 1
    out = {}
    for r in P.count_grams(docs).collect():
        out.setdefault((r.fold, r.order), []).append(r.n)
    assert {key: sorted(n) for key, n in out.items()} == {key: sorted(c.values()) for key, c in grams.items()}


def test_spark_model_equals_the_one_in_memory(spark):
    docs = documents(spark).limit(60).localCheckpoint()
    table = P.count_grams(docs).toArrow()
    model = P.fit(docs)
    for f in range(P.FOLDS):
        part = table.filter(P.pc.equal(table["fold"], f))
        order = part["order"].to_numpy()
        small = P.kneser_ney({k: {c: part[c].to_numpy()[order == k] for c in ("slot", "context", "suffix", "n")} for k in P.SLOT_BITS})
        got = P.sorted_arrays(model.where(f"fold = {f}").toArrow())
        for k in small:
            for a, b in zip(small[k], got[k]):
                assert np.allclose(a, b)


def test_joined_model_scores_as_the_broadcast_one(spark, monkeypatch):
    for docs in (documents(spark), with_clashes(edge_docs(spark)), no_docs(spark)):
        def rows():
            return sorted(((r.doc_id, r.n_words, r.kept, r.perplexity and round(r.perplexity, 9)) for r in P.quality_rules(docs).collect()), key=str)
        expected, kept = rows(), sorted(map(str, P.keep_good(docs).collect()))
        with monkeypatch.context() as m:
            m.setattr(P, "MODEL_ROWS", -1)
            m.setattr(P, "TASK_BYTES", 1 << 16)
            m.setattr(P, "small_enough", lambda df, n: False)
            assert rows() == expected
            assert sorted(map(str, P.keep_good(docs).collect())) == kept


def test_grams_are_taken_from_small_chunks():
    import pyarrow as pa

    from shopflow.llm import perplexity
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 9), pa.array(range(9))], names=["text", "at"])
    parts = list(perplexity._gram_chunks(iter([batch])))
    assert [r for p in parts for r in p.column(1).to_pylist()] == list(range(9))
    assert max(p.num_rows for p in parts) * 100_000 <= perplexity.GRAM_BYTES

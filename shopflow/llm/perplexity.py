"""Quality rules with an n-gram perplexity filter (operator 10).

Rules on a document's own words and lines come first; then a modified
Kneser-Ney model of character 4-grams, counted by Spark over every whole
text, gives each document a mean negative log probability per character.
Texts are dealt into two folds by a hash of the text, and a document is scored
by the model of the other fold: neither its own counts nor those of its exact
copies are in its score.  Each language has its own lower and upper band
around its median, as wide as its quartiles say; documents outside are rejected.

N-grams are counted one by one under 64-bit keys of (language, order,
n-gram), so the model grows with the corpus.  Counts combine in the tasks;
discounts come from the counts of counts (the only numbers the driver needs),
context totals from Spark aggregates.  A model of at most ``MODEL_ROWS`` rows is
broadcast as sorted arrays; a larger one is joined by key to the distinct
n-grams of text chunks, and each chunk is scored with the rows it needs.  Both
ways give the same results.

Defined results: a null text is an empty one (0 words, base_failed); texts
under four characters have no 4-gram, a null perplexity and no verdict from
the model; a null language is a language of its own; repeated rows give
repeated results; extra columns are ignored by ``quality_rules`` and kept by
``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.llm.common import (
    SMALL_BATCHES, SPACE, Words, code_points_before, field_index, flat_utf8, give_back, materialize, mix64, maybe_broadcast,
    read_table, row_chunks, settings, small_enough, span_hashes, texts_of_rows, _BYTE,
)

ORDER = 4
#: The first character scored is a text's fourth; longer n-grams would be padded there.
FIRST = 4
#: Bits of an n-gram's key, by order.
SLOT_BITS = dict.fromkeys(range(1, ORDER + 1), 64)
#: Models of more rows than this are joined, not broadcast.
MODEL_ROWS = 4_000_000
#: Bytes of text in a counting task and in a chunk that is joined to the model.
TASK_BYTES = 48 << 20
#: Distinct n-grams gathered in a counting task before they are combined.
GATHER = 1 << 18
#: Bands: the median plus and minus this many times the distance to the quartile on that side ...
BAND_WIDTH = 8.0
#: ... and at least this many nats a character (for quartiles that fall together; languages' own spread is wider).
LEAST_BAND = 0.02
#: Texts are dealt into this many folds and scored by the counts of another.
FOLDS = 2

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[0x0A] = True


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, found earlier) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, earlier


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = Words(data, offsets)
    before = code_points_before(data)
    out = {"n_words": words.count.astype(np.int64),
           "word_chars": _per_doc(before[words.end] - before[words.start], words.first),
           "n_symbols": _per_doc(_SYMBOL[data], offsets)}

    codes = _BYTE[data]
    lines = Words(data, offsets, _NOT_NEWLINE)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=filled[1:])
    has_word = filled[lines.end] > filled[lines.start]
    key = mix64(span_hashes(codes, lines.start, lines.end) ^ mix64(lines.doc.astype(np.uint64)))
    earlier = np.zeros(len(key), bool)
    earlier[has_word] = _repeated(key[has_word])[1]
    out["n_dup_lines"] = _per_doc(earlier, lines.first)

    h = span_hashes(codes, words.start, words.end)
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        w = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        key = mix64(h[w] * np.uint64(3) + h[w + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[w + 2] * np.uint64(0x165667B19E3779F9))
        twice = w[_repeated(mix64(key ^ mix64(words.doc[w].astype(np.uint64))))[0]]
        for i in range(3):
            covered[twice + i] = True
    out["n_repeat_words"] = _per_doc(covered, words.first)
    return out


# -- the language model -------------------------------------------------------
def _lang_codes(langs: pa.Array) -> np.ndarray:
    """A 64-bit number per row's language; nulls are a language of their own."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = [1]
    for name in names:
        raw = np.frombuffer(b"\x01" + name.encode(), np.uint8)
        seeds.append(int(span_hashes(_BYTE[raw], np.array([0]), np.array([len(raw)]))[0]))
    idx = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(seeds, np.uint64)[idx + 1]


def text_folds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fold of each text; equal texts share one."""
    return (span_hashes(_BYTE[data], offsets[:-1], offsets[1:]) % np.uint64(FOLDS)).astype(np.int64)


class Grams:
    """The n-grams that end at each character from a text's fourth on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.codes = mix64(points.astype(np.uint64) + np.uint64(1))
        self.langs = langs
        chars = code_points_before(data)[offsets]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(chars))
        self.begin = chars[:-1]
        n = len(points)
        self.at = np.flatnonzero(doc[:n - FIRST + 1] == doc[FIRST - 1:]) + FIRST - 1 if n >= FIRST else np.zeros(0, np.int64)
        self.doc = doc[self.at]

    def _values(self, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
        """The k characters that end before ``at`` + 1 as a polynomial; nothing stands before a text."""
        value, power = np.zeros(len(at), np.uint64), 1
        for i in range(k):
            code = self.codes[at - i]
            if i >= FIRST:
                code = np.where(at - i >= self.begin[doc], code, np.uint64(0))
            value += code * np.uint64(power)
            power = power * _BASE % (1 << 64)
        return value

    def _slot(self, value: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
        return mix64(value ^ mix64(self.langs + np.uint64(k))[doc]).view(np.int64)

    def top(self, where: np.ndarray) -> np.ndarray:
        """Keys of the longest n-grams at some of the positions."""
        return self._slot(self._values(self.at[where], self.doc[where], ORDER), self.doc[where], ORDER)

    def slots(self, where: np.ndarray | slice = slice(None)) -> dict:
        """``{k: keys, ("ctx", k): keys of the n-grams before the last character}``."""
        at, doc, out = self.at[where], self.doc[where], {}
        for k in range(1, ORDER + 1):
            out[k] = self._slot(self._values(at, doc, k), doc, k)
            if k > 1:
                before = self._values(at, doc, k) - self.codes[at]
                out["ctx", k] = self._slot(before * _BASE_INVERSE, doc, k - 1)
        return out


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def gram_slots(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[dict, np.ndarray]:
    """Keys of the n-grams ending at each character from a text's fourth on.

    Returns ``{order: keys}`` plus, under ``("ctx", k)``, the key of the
    (k-1)-gram before the last character, and the document of each position.
    """
    grams = Grams(data, offsets, langs)
    return grams.slots(), grams.doc


_COUNT_SCHEMA = "fold int, order int, slot bigint, context bigint, suffix bigint, n bigint"
_NAMES = [*range(1, ORDER + 1), *[("ctx", k) for k in range(2, ORDER + 1)]]


def _combined(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a row of each distinct key, sums of ``n``), in the keys' order."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return order[first], (np.add.reduceat(n[order], first) if len(first) else n[:0])


def _distinct(grams: Grams, folds: np.ndarray, f: int) -> tuple[dict, np.ndarray]:
    """Slots and counts of the distinct n-grams in the texts of one fold."""
    where = np.flatnonzero(folds == f)
    _, first, n = np.unique(grams.top(where), return_index=True, return_counts=True)
    return grams.slots(where[first]), n


class _Gathered:
    """Distinct longest n-grams of one fold with their counts."""

    def __init__(self):
        self.parts, self.pending = [], 0

    def add(self, slots: dict, n: np.ndarray) -> None:
        self.parts.append((slots, n))
        self.pending += len(n)
        if self.pending > GATHER:
            self.combine()
            self.pending = 0

    def combine(self) -> tuple[dict, np.ndarray]:
        slots = {name: np.concatenate([p[0][name] for p in self.parts]) for name in _NAMES}
        at, n = _combined(slots[ORDER], np.concatenate([p[1] for p in self.parts]))
        self.parts = [({name: v[at] for name, v in slots.items()}, n)]
        return self.parts[0]


#: Bytes of text whose n-grams are held at once: each takes some hundred bytes of working arrays.
GRAM_BYTES = 1 << 18


def _gram_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from row_chunks(batch, "text", GRAM_BYTES)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's n-grams, combined over the whole task."""
    gathered = [_Gathered() for _ in range(FOLDS)]
    for batch in _gram_chunks(batches):
        data, offsets = flat_utf8(batch.column(0))
        grams = Grams(data, offsets, _lang_codes(batch.column(1)))
        folds = text_folds(data, offsets)[grams.doc]
        for f in range(FOLDS):
            gathered[f].add(*_distinct(grams, folds, f))
    for f in range(FOLDS):
        if not gathered[f].parts:
            continue
        slots, n_top = gathered[f].combine()
        for k in SLOT_BITS:
            at, n = _combined(slots[k], n_top)
            none = np.zeros(len(at), np.int64)
            columns = [slots[k][at], slots["ctx", k][at] if k > 1 else none, slots[k - 1][at] if k > 1 else none, n]
            for i in range(0, len(at), 1 << 16):
                part = [c[i:i + (1 << 16)] for c in columns]
                same = [pa.array(np.full(len(part[0]), v, np.int32)) for v in (f, k)]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, part)], names=["fold", "order", "slot", "context", "suffix", "n"])
        gathered[f] = slots = columns = part = at = n = n_top = None
    give_back()


def _in_large_tasks(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` in fewer tasks, of about TASK_BYTES of text each (n-grams combine better there)."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(fold, order, slot, context, suffix, n) over all texts: one row per fold and n-gram."""
    return (_in_large_tasks(docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")), "text")
                .mapInArrow(_count_grams, _COUNT_SCHEMA)
                .groupBy("fold", "order", "slot")
                .agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n")))


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; ``n[i]``
    n-grams were counted i times."""
    if not (n[1] and n[2]):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0, *(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3))]
    return np.clip(np.array(d), 0, [0, 0.95, 1.9, 2.9])


def kneser_ney(rows: dict[int, dict[str, np.ndarray]]) -> dict:
    """``fit``'s model from one fold's counts in memory (small inputs; the tests hold ``fit`` against it).

    {order: (sorted keys, discounted counts, context totals, context
    discounts)}; order 0 is the empty context.  The highest order uses counts,
    lower orders the number of distinct n-grams one longer that end in them.
    """
    model, above = {k: [{}, {}, {}] for k in range(ORDER + 1)}, {}
    for k in range(ORDER, 0, -1):
        r = rows.get(k)
        if r is None or not len(r["slot"]):
            return {}
        c = np.array(r["n"] if k == ORDER else [above.get(s, 1) for s in r["slot"].tolist()], np.int64)
        d = _discounts([np.count_nonzero(c == i) for i in range(5)])[np.minimum(c, 3)]
        above = {}
        for s, ctx, suffix, ci, di in zip(r["slot"].tolist(), r["context"].tolist(), r["suffix"].tolist(), c, d):
            model[k][0][s] = ci - di
            model[k - 1][1][ctx] = model[k - 1][1].get(ctx, 0) + ci
            model[k - 1][2][ctx] = model[k - 1][2].get(ctx, 0) + di
            above[suffix] = above.get(suffix, 0) + 1
    out = {}
    for k, columns in model.items():
        keys = sorted({key for c in columns for key in c})
        out[k] = (np.array(keys, np.int64), *[np.array([c.get(key, 0) for key in keys], np.float64) for c in columns])
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(fold, order, slot, less, total, spare): Kneser-Ney statistics of all documents.

    ``less`` is an n-gram's discounted count, ``total`` and ``spare`` the counts
    and discounts of the n-grams it is the context of.  Order 0 is the empty context.
    """
    spark = docs.sparkSession
    grams = materialize(count_grams(docs, text, lang), "grams")
    longer = (grams.where("order > 1").groupBy("fold", (F.col("order") - 1).alias("order"), F.col("suffix").alias("slot"))
                   .agg(F.count(F.lit(1)).alias("ends")))
    c = F.when(F.col("order") == ORDER, F.col("n")).otherwise(F.coalesce("ends", F.lit(1)))
    counted = materialize(grams.join(longer, ["fold", "order", "slot"], "left").select("fold", "order", "slot", "context", c.alias("c")), "counted")
    few = counted.groupBy("fold", "order").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(5)]).collect()
    discounts = spark.createDataFrame([(r.fold, r.order, *map(float, _discounts([r[f"n{i}"] for i in range(5)])[1:])) for r in few],
                                      "fold int, order int, d1 double, d2 double, d3 double")
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    counted = counted.join(F.broadcast(discounts), ["fold", "order"]).withColumn("d", d)
    # A gram's own row and its rows as a context come together in one aggregate.
    own = counted.select("fold", "order", "slot", (F.col("c") - F.col("d")).alias("less"), F.lit(0).cast("bigint").alias("total"), F.lit(0.0).alias("spare"))
    context = (counted.groupBy("fold", (F.col("order") - 1).alias("order"), F.col("context").alias("slot"))
                      .agg(F.lit(0.0).alias("less"), F.sum("c").alias("total"), F.sum("d").alias("spare")))
    return materialize(own.unionByName(context).groupBy("fold", "order", "slot").agg(*[F.sum(x).alias(x) for x in ("less", "total", "spare")]), "model")


def sorted_arrays(table: pa.Table) -> dict:
    """A model (as of ``kneser_ney``) from rows (order, slot, less, total, spare)."""
    order = table.column("order").to_numpy()
    columns = [table.column(c).to_numpy() for c in ("slot", "less", "total", "spare")]
    out = {}
    for k in range(ORDER + 1):
        at = np.flatnonzero(order == k)
        at = at[np.argsort(columns[0][at])]
        out[k] = (columns[0][at], *[c[at].astype(np.float64) for c in columns[1:]])
    return out


class Scorer:
    """Interpolated probabilities from a model's sorted arrays.

    ``letters`` is the number of distinct characters the model has seen, if
    the model holds only some of its rows.
    """

    def __init__(self, model: dict, letters: int | None = None):
        self.model = model
        self.letters = letters if letters is not None else np.count_nonzero(model[1][1]) if model else 0

    def _find(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = self.model[k][0]
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys

    def log_p(self, slots: dict, k: int) -> np.ndarray:
        """Log probabilities of the last characters of the n-grams of order ``k``."""
        if not self.letters:
            return np.full(len(slots[k]), np.nan)
        p = np.full(len(slots[k]), 1 / (self.letters + 1))
        for j in range(1, k + 1):
            at, seen = self._find(j - 1, slots["ctx", j] if j > 1 else np.zeros(len(p), np.int64))
            _, less, total, spare = self.model[j - 1]
            known = seen.copy()
            known[seen] = total[at[seen]] > 0
            at = at[known]
            own, found = self._find(j, slots[j][known])
            less = np.zeros(len(own))
            less[found] = self.model[j][1][own[found]]
            p[known] = (less + spare[at] * p[known]) / total[at]
        return np.log(p)


_METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scores(batch: pa.RecordBatch, text: pa.Array, lang: pa.Array, scorers: list) -> list[pa.Array]:
    """The metrics and ``nll`` of a batch's texts."""
    data, offsets = flat_utf8(text)
    counts = rule_counts(data, offsets)
    grams = Grams(data, offsets, _lang_codes(lang))
    folds, log_p = text_folds(data, offsets)[grams.doc], np.zeros(len(grams.doc))
    for f in range(FOLDS):
        where = np.flatnonzero(folds == f)
        _, first, inverse = np.unique(grams.top(where), return_index=True, return_inverse=True)
        log_p[where] = scorers[(f + 1) % FOLDS].log_p(grams.slots(where[first]), ORDER)[inverse]
    n = np.bincount(grams.doc, minlength=batch.num_rows)
    loss = -np.bincount(grams.doc, log_p, batch.num_rows)
    return [*[pa.array(counts[m]) for m in _METRICS], pa.array(loss / np.maximum(n, 1), mask=(n == 0) | np.isnan(loss))]


def _chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, fold, order, slot): the model rows that each chunk's texts need."""
    need = {}
    for batch in _gram_chunks(batches):
        chunks = batch.column(2).to_numpy()
        data, offsets = flat_utf8(batch.column(0))
        grams = Grams(data, offsets, _lang_codes(batch.column(1)))
        folds = text_folds(data, offsets)[grams.doc]
        for chunk in np.unique(chunks).tolist():
            here = np.where(chunks[grams.doc] == chunk, folds, -1)
            for f in range(FOLDS):
                need.setdefault((chunk, f), _Gathered()).add(*_distinct(grams, here, f))
    for (chunk, f), gathered in need.items():
        slots, _ = gathered.combine()
        for k in SLOT_BITS:
            keys = np.unique(np.concatenate([slots[k], *([slots["ctx", k + 1]] if k < ORDER else [])]))
            for i in range(0, len(keys), 1 << 16):
                part = keys[i:i + (1 << 16)]
                same = [pa.array(np.full(len(part), v, np.int32)) for v in (chunk, (f + 1) % FOLDS, k)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], names=["chunk", "fold", "order", "slot"])


def _scored(docs: DataFrame, model: DataFrame, keep_row: bool, text: str, lang: str) -> DataFrame:
    """Metrics and ``nll`` (mean negative log probability a character) of every row."""
    context = docs.sparkSession.sparkContext
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_row else F.struct(F.col("doc_id"))
    at = field_index(docs.columns, text) if keep_row else None
    source = docs.select(*([] if keep_row else [F.col(text).alias("text")]), F.col(lang).cast("string").alias("lang"), row.alias("row"))
    schema = T.StructType([source.schema["row"], T.StructField("lang", T.StringType()),
                           *[T.StructField(m, T.LongType()) for m in _METRICS],
                           T.StructField("nll", T.DoubleType())])
    if small_enough(model, MODEL_ROWS):
        rows = [model.where(F.col("fold") == f).drop("fold").toArrow() for f in range(FOLDS)]
        shared = context.broadcast([sorted_arrays(r) for r in rows])
        del rows

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers = [Scorer(m) for m in shared.value]
            for batch in _gram_chunks(batches if at is None else texts_of_rows(batches, at)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), batch.column(1), *_scores(batch, batch.column(0), batch.column(1), scorers)], names=schema.names)
            give_back()

        return source.mapInArrow(score, schema)

    letters = {r.fold: r.n for r in model.where("order = 1 and less > 0").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    roots = {r.fold: (float(r.total), r.spare) for r in model.where("order = 0").collect()}
    field = "text" if at is None else f"row.`{docs.columns[at]}`"
    source = materialize(_in_large_tasks(source, field).withColumn("chunk", F.spark_partition_id()), "chunks")
    if at is not None:    # the text is written once, in its row
        source = source.select(F.col(field).alias("text"), "lang", "row", "chunk")
    schema = T.StructType([source.schema["row"], *schema.fields[1:]])    # as written: all fields may be null
    need = source.select("text", "lang", "chunk").mapInArrow(_chunk_grams, "chunk int, fold int, order int, slot bigint").distinct()
    rows = need.join(model, ["fold", "order", "slot"]).select("chunk", "fold", "order", "slot", "less", "total", "spare")

    def score_chunk(texts: pa.Table, rows: pa.Table) -> pa.Table:
        scorers, out = [], []
        for f in range(FOLDS):
            part = sorted_arrays(rows.filter(pc.equal(rows.column("fold"), f)))
            if f in roots:
                part[0] = (np.zeros(1, np.int64), np.zeros(1), *[np.array([v]) for v in roots[f]])
            scorers.append(Scorer(part, letters.get(f, 0)))
        for batch in _gram_chunks(texts.to_batches()):
            out.append(pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), *_scores(batch, batch.column(0), batch.column(1), scorers)], names=schema.names))
        return pa.Table.from_batches(out)

    return source.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(score_chunk, schema)


def _verdicts(scored: DataFrame) -> DataFrame:
    """Adds base_failed, the language's band and kept to a written scored table."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    q = F.percentile_approx("nll", [0.25, 0.5, 0.75], 10_000)
    bands = (scored.where(~F.col("base_failed")).groupBy("lang").agg(q.alias("_q"))
                   .select(F.col("lang").alias("_lang"),
                           (F.col("_q")[1] - F.greatest(F.lit(LEAST_BAND), BAND_WIDTH * (F.col("_q")[1] - F.col("_q")[0]))).alias("lower"),
                           (F.col("_q")[1] + F.greatest(F.lit(LEAST_BAND), BAND_WIDTH * (F.col("_q")[2] - F.col("_q")[1]))).alias("upper")))
    out = scored.join(maybe_broadcast(bands), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    inside = F.coalesce(F.col("nll").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the rule counts, nll, perplexity, band and verdict of every row."""
    docs = docs.select("doc_id", *dict.fromkeys((text, lang)))
    with settings(docs.sparkSession, SMALL_BATCHES):
        out = _verdicts(materialize(_scored(docs, fit(docs, text, lang), False, text, lang), "quality_rules"))
    return out.select("row.doc_id", *_METRICS, "base_failed", "kept", F.exp("nll").alias("perplexity"),
                      F.exp("lower").alias("lower_perplexity"), F.exp("upper").alias("upper_perplexity"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows (all columns) that pass the rules and the language's band."""
    out = _verdicts(materialize(_scored(docs, fit(docs, text, lang), True, text, lang), "quality_rules"))
    return out.where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: rule counts and verdicts of all documents."""
    return quality_rules(read_table(spark, sf_dir, "documents"))

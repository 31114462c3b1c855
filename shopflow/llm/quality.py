"""Quality classifier with hierarchical empirical Bayes (operator 5).

Evidence of a document: the log odds, by logistic regression, of the words,
word beginnings, shares of word shapes and word variety it shows.  Spark
counts features (64-bit hashes) over the labelled sample and keeps, for each
label, the ``MAX_FEATURES`` that speak for it most clearly; their weights
are fitted on the same sample with a penalty.

The site prior: the expected share of bad documents of each host and of each
path within it, by grouped aggregation over all documents.  Host rates are
shrunk toward the global rate and path rates toward their host's, by prior
strengths estimated from the spread between hosts and between paths (method
of moments), so sparse sites fall back on what is known above them.  A
document's own evidence is left out of its site's rates.

Posterior log odds = calibrated evidence + log odds of the path's rate
- log odds of the global rate, for low quality and for toxicity apart; a
document is rejected when either exceeds ``REJECT``.

The training sample is bounded: the ``max_labels`` labelled documents with
the smallest hash of their doc_id.  Everything else covers all rows.

Defined results: a null or empty text has no features, only its site and the
base rate; null hosts and paths are groups of their own; labels without
doc_id are ignored, a document labelled twice takes the larger of each;
repeated rows count as often as they occur; without labels nothing is
rejected; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.llm.common import (
    Words, _BYTE, _LOWER, field_index, flat_utf8, give_back, materialize, maybe_broadcast, mix64, read_table,
    span_hashes, text_chunks, texts_of_rows,
)

MAX_LABELS = 20_000
MAX_FEATURES = 4096  # a target
LEAST_DOCS = 3       # a feature occurs in so many documents of the sample at least
LEAST_Z = 2.5        # and its log odds are so many standard errors above 0
PENALTY = 0.05       # squared weights
REJECT = 0.5
TARGETS = ("low", "toxic")
START = 4            # bytes of a word's beginning

_NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NOT_ALNUM[_lo:_hi] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")
_WORD_CODE = _BYTE[_LOWER]
_SHAPE_CODE = _BYTE[::-1][_SHAPE]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every feature occurrence."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets, _NOT_ALNUM)
    codes = _WORD_CODE[data]
    h = span_hashes(codes, words.start, words.end)
    long = np.flatnonzero(words.end - words.start > START)
    begins = span_hashes(codes, words.start[long], words.start[long] + START)
    docs, keys = [words.doc, words.doc[long]], [h, mix64(begins + np.uint64(1))]

    # Shapes: classes of a white-space token's characters, runs collapsed;
    # a feature is a shape with the magnitude of its share of the tokens.
    tokens = Words(data, offsets)
    shape = _SHAPE[data]
    first = np.ones(len(shape), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[tokens.start] = True
    at = np.flatnonzero(first)
    s, e = np.searchsorted(at, tokens.start), np.searchsorted(at, tokens.end)
    key = mix64(span_hashes(_SHAPE_CODE[data[at]], s, e) + np.uint64(2))
    order = np.lexsort((key, tokens.doc))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (tokens.doc[order][1:] != tokens.doc[order][:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(order)))
    owner = tokens.doc[order][begin]
    share = np.floor(np.log2(64 * times / np.maximum(tokens.count[owner], 1)) / 2).clip(-1, 3).astype(np.int64) + 1
    docs.append(owner)
    keys.append(mix64(key[order][begin] + share.astype(np.uint64)))

    # Variety: distinct words among all, in tenths.
    key = mix64(h ^ mix64(words.doc.astype(np.uint64)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(words.doc[order][new], minlength=n_docs)
    docs.append(np.arange(n_docs))
    keys.append(mix64((10 * distinct // np.maximum(words.count, 1) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(docs), np.concatenate(keys)


class Lookup:
    """Numbers of the chosen features among hashes: a bit table, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature number) pairs."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, keys[some]), len(self.hashes) - 1)
        hit = self.hashes[at] == keys[some]
        both = np.unique(doc[some][hit] * len(self.hashes) + at[hit])
        return both // len(self.hashes), both % len(self.hashes)


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n, low, toxic): documents with a feature and how many have each label."""
    for batch in text_chunks(batches):
        doc, key = features(*flat_utf8(batch.column(0)))
        labels = [batch.column(1 + i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(TARGETS))]
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        once = new_key.copy()
        once[1:] |= doc[1:] != doc[:-1]
        doc, group = doc[once], np.cumsum(new_key)[once] - 1
        n = int(new_key.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[new_key].view(np.int64)), pa.array(np.bincount(group, minlength=n)),
             *[pa.array(np.bincount(group, y[doc], n).astype(np.int64)) for y in labels]], names=["hash", "n", *TARGETS])


def regress(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on present features."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.1
    w, b = np.zeros(n_features), float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return w, b
    seen = np.full(n_features + 1, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[feature], len(y)) + b, -30, 30)))
        g = np.append(np.bincount(feature, (p - y)[doc], n_features) + PENALTY * w, (p - y).sum())
        seen += g * g
        step = 0.5 * g / np.sqrt(seen)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _evidence_rows(shared, names: list[str], at: int | None):
    """``at``: the text's place in the rows, if they are carried along."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lines = shared.value
        lookup = Lookup(hashes)
        for batch in text_chunks(batches if at is None else texts_of_rows(batches, at)):
            doc, feature = lookup.find(*features(*flat_utf8(batch.column(0))))
            x = [np.bincount(doc, w[feature], batch.num_rows) + b for w, b in lines]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, x)], names=names)
        give_back()
    return rows


def _feature_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in text_chunks(batches):
            doc, feature = lookup.find(*features(*flat_utf8(batch.column(0))))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))],
                                             names=[*TARGETS, "features"])
    return rows


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_labels: int = MAX_LABELS):
    """(feature hashes, [(weights, intercept) of each target]) from a bounded labelled sample."""
    spark = docs.sparkSession
    sample = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                    .agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
                    .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    # At most max_labels narrow rows: small enough to broadcast.
    sample = sample.select(F.col("doc_id").alias("_id"), *TARGETS)
    held = materialize(docs.select("doc_id", F.col(text).alias("text"))
                           .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
                           .select("_id", "text", *TARGETS, F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row")), "held")
    # One text an id, however many rows repeat it, so the fit stays bounded; the
    # texts are not shuffled for it.
    chosen = held.groupBy("_id").agg(F.min(F.struct("_h", "_row"))["_row"].alias("_row")).select("_row")
    known = materialize(held.join(F.broadcast(chosen), "_row").select("text", *TARGETS), "labelled")
    total = known.agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    counts = (known.mapInArrow(_count_features, "hash bigint, n bigint, low bigint, toxic bigint")
                     .groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).where(F.col("n") >= LEAST_DOCS))
    chosen = []
    for t in TARGETS:
        yes, no = total[t] or 0, (total["n"] or 0) - (total[t] or 0)
        a, b = F.col(t) + 0.5, F.col("n") - F.col(t) + 0.5
        z = (F.log(a / (yes + 1)) - F.log(b / (no + 1))) / F.sqrt(1 / a + 1 / b)
        best = counts.select("hash", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "hash").limit(MAX_FEATURES)
        chosen.append(best.select("hash").toArrow().column("hash").to_numpy().view(np.uint64))
    hashes = np.unique(np.concatenate(chosen))
    held = known.mapInArrow(_feature_rows(spark.sparkContext.broadcast(hashes)), "low int, toxic int, features array<int>").toArrow()
    lists = held.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    lines = []
    for t, own in zip(TARGETS, chosen):
        y = held.column(t)
        known_rows = np.array(y.is_valid(), dtype=bool)
        row = np.cumsum(known_rows) - 1
        # A target's evidence is what speaks for it; a document without any keeps the base rate.
        ok = known_rows[doc] & np.isin(hashes, own)[feature] if len(doc) else np.zeros(0, bool)
        lines.append(regress(row[doc[ok]] if len(doc) else doc, feature[ok], y.fill_null(0).to_numpy()[known_rows].astype(float), len(hashes)))
    return hashes, lines


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: Column, mean: Column, n: Column) -> Column:
    """Prior strength (pseudo-documents) from the spread of group rates around ``mean``:
    expected squared deviation = m(1-m) * (1/n + (1-1/n)/(k+1))."""
    base = mean * (1 - mean)
    spread = F.sum(n * ((rate - mean) * (rate - mean) - base / n)) / F.sum(base * n)
    share = F.least(F.lit(0.99), F.greatest(F.lit(0.001), spread))
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), (1 - share) / share))


def posteriors(scored: DataFrame) -> DataFrame:
    """Adds p_low and p_toxic to rows with host, path, x_low and x_toxic (log odds)."""
    sig = {t: 1 / (1 + F.exp(-F.col(f"x_{t}"))) for t in TARGETS}
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(sig[t]).alias(f"s_{t}") for t in TARGETS])
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS])
    world = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"h_{t}").alias(t) for t in TARGETS]).first()
    if not world["n"]:
        return scored.withColumns({f"p_{t}": F.lit(None).cast("double") for t in TARGETS})
    mean = {t: min(max(world[t] / world["n"], 1e-6), 1 - 1e-6) for t in TARGETS}
    by_host = hosts.agg(*[_strength(hosts, F.col(f"h_{t}") / F.col("hn"), F.lit(mean[t]), F.col("hn")).alias(t) for t in TARGETS]).first()
    table = paths.alias("p").join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    host_rate = {t: (F.col(f"h_{t}") + by_host[t] * mean[t]) / (F.col("hn") + by_host[t]) for t in TARGETS}
    by_path = table.agg(*[_strength(table, F.col(f"s_{t}") / F.col("n"), host_rate[t], F.col("n")).alias(t) for t in TARGETS]).first()
    site = table.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "hn",
                        *[f"s_{t}" for t in TARGETS], *[f"h_{t}" for t in TARGETS])
    out = scored.join(maybe_broadcast(site), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))).drop("_h", "_p")
    for t in TARGETS:
        own = sig[t]
        host = (F.col(f"h_{t}") - own + by_host[t] * mean[t]) / (F.col("hn") - 1 + by_host[t])
        path = (F.col(f"s_{t}") - own + by_path[t] * host) / (F.col("n") - 1 + by_path[t])
        odds = F.col(f"x_{t}") + _logit(path) - F.lit(float(np.log(mean[t] / (1 - mean[t]))))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-odds)))
    return out.drop("n", "hn", *[f"{a}_{t}" for a in "sh" for t in TARGETS])


def _scored(docs: DataFrame, labels: DataFrame, keep_row: bool, text: str, host: str, path: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_row else F.struct("doc_id")
    source = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), row.alias("row"),
                         F.col(text).alias("text"))
    schema = T.StructType([*source.schema.fields[:3], *[T.StructField(f"x_{t}", T.DoubleType()) for t in TARGETS]])
    at = field_index(docs.columns, text) if keep_row else None
    source = source.drop("text") if keep_row else source.select("text", "host", "path", "row")
    return materialize(source.mapInArrow(_evidence_rows(shared, schema.names, at), schema), "evidence")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence (log odds), posteriors and verdict of every row."""
    out = posteriors(_scored(docs, labels, False, text, host, path))
    return out.select("row.doc_id", "host", "path", *[F.col(f"x_{t}").alias(f"evidence_{t}") for t in TARGETS],
                      *[f"p_{t}" for t in TARGETS], _kept().alias("kept"))


def _kept() -> Column:
    return ~F.coalesce((F.col("p_low") > REJECT) | (F.col("p_toxic") > REJECT), F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The rows (all columns) that the classifier does not reject."""
    return posteriors(_scored(docs, labels, True, text, host, path)).where(_kept()).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: evidence, posteriors and verdicts of all documents."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

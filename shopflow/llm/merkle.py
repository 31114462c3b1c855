"""Document fingerprints as Merkle trees (operator 4).

A text is a tree: the document holds sections, a section holds paragraphs
(lines), a paragraph holds pieces (sentences, cut at 200 characters).  A leaf
is the hash of its piece, an inner node the hash of its children, so equal
roots mean equal texts and only differing branches need a look to locate
edits.  A section ends at an empty line or after a paragraph whose hash says
so (one in four), which keeps the sections after an edit where they were.

A fingerprint is the tree in text form:
``root/section:paragraph=leaf.leaf,paragraph=leaf/section:...`` with the root
in 32 hex digits and all other hashes in 16 (inner) or 8 (leaves).

The edited text of a document needs the next document's, in descending
doc_id.  Documents are range-partitioned on (doc_id, text hash) with split
points from a sample, as many ranges as the texts' bytes ask for and each a
partition of its own; rows of one key that fill several ranges are dealt over
them.  Each range is read in order by one task, and the first document of
every range is also sent to the end of the range before, so one shuffle of the
texts does.

Defined results: a null text is an empty one (one empty paragraph); null
doc_ids come last; rows of equal doc_id are ordered by their text's hash,
repeated rows being interchangeable; a text of any length is taken whole; a single document is its own next;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import read_table, row_chunks

RANGE_BYTES = 64 << 20
_PIECE = re.compile(r"[^.!?]{1,200}[.!?]*|[.!?]+")


def _hash(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


class Tree:
    """Sections of a text: (hash, [(paragraph hash, [leaf hashes])]) and the root over them."""

    __slots__ = ("root", "sections")

    def __init__(self, text: str):
        self.sections, open_ = [], []
        for line in text.split("\n"):
            leaves = [_hash(p.encode(), 8) for p in _PIECE.findall(line)]
            own = _hash(b"p" + b"".join(leaves), 16)
            open_.append((own, leaves))
            if not line or own[0] < 64:
                self._close(open_)
                open_ = []
        if open_:
            self._close(open_)
        self.root = _hash(b"d" + b"".join(s[0] for s in self.sections), 16)

    def _close(self, paragraphs: list) -> None:
        self.sections.append((_hash(b"s" + b"".join(p[0] for p in paragraphs), 16), paragraphs))

    def __str__(self) -> str:
        return self.root.hex() + "".join(
            "/" + s.hex()[:16] + ":" + ",".join(p.hex()[:16] + "=" + ".".join(x.hex()[:8] for x in leaves) for p, leaves in ps)
            for s, ps in self.sections)


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, sections) of a fingerprint string."""
    root, *sections = fingerprint.split("/")
    out = []
    for section in sections:
        head, _, body = section.partition(":")
        out.append((head, [(p.partition("=")[0], [x for x in p.partition("=")[2].split(".") if x]) for p in body.split(",")]))
    return root, out


def _likeness(root_a, a, root_b, b) -> float:
    """Equal roots: 1.  Else the shared leaves among all (Dice), equal sections
    matched as a whole before their leaves are looked at."""
    if root_a == root_b:
        return 1.0
    count = [sum(len(leaves) for _, ps in s for _, leaves in ps) for s in (a, b)]
    if not sum(count):
        return 0.0
    both = Counter(s[0] for s in a) & Counter(s[0] for s in b)
    shared, rest = 0, []
    for k, sections in enumerate((a, b)):
        left, leaves_left = Counter(both), Counter()
        for own, ps in sections:
            if left[own] > 0:
                left[own] -= 1
                shared += (not k) * sum(len(leaves) for _, leaves in ps)
            else:
                for _, leaves in ps:
                    leaves_left.update(leaves)
        rest.append(leaves_left)
    shared += sum((rest[0] & rest[1]).values())
    return 2 * shared / sum(count)


def likeness(a: str, b: str) -> float:
    """Likeness (0 to 1) of two fingerprint strings."""
    (ra, sa), (rb, sb) = parse(a), parse(b)
    return _likeness(ra, sa, rb, sb)


def changed_paragraphs(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of ``a`` that are not in ``b``, found by
    descending only into sections ``b`` lacks."""
    (ra, sa), (rb, sb) = parse(a), parse(b)
    if ra == rb:
        return []
    known = {s for s, _ in sb}
    paragraphs = {p for _, ps in sb for p, _ in ps}
    out, at = [], 0
    for own, ps in sa:
        if own not in known:
            out += [at + i for i, (p, _) in enumerate(ps) if p not in paragraphs]
        at += len(ps)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the next text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# -- Spark side -----------------------------------------------------------------
def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""
    source = docs.select(F.col(text).alias("text"), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (c for b in batches for c in row_chunks(b, "text")):
            texts = batch.column(0).fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([str(Tree(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def _split_points(keys: DataFrame, ranges: int, per_range: int = 40) -> list[tuple]:
    """``ranges`` - 1 keys that cut the rows evenly, from a sample of about
    ``ranges * per_range`` rows; a key that many rows share may stand there
    several times.  They only balance the ranges."""
    if ranges < 2:
        return []
    n = keys.count()
    sample = keys.sample(min(1.0, ranges * per_range / max(1, n)), seed=5).toArrow()
    found = sorted(zip(sample.column("absent").to_pylist(), sample.column("k").to_pylist(), sample.column("h").to_pylist()))
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def _in_ranges(points: list[tuple]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with equal keys take turns over the ranges between equal split points."""
        turn = 0
        for batch in batches:
            at = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("absent", "k", "h"))):
                low, high = bisect.bisect_left(points, key), bisect.bisect_right(points, key)
                if high - low > 1:
                    turn += 1
                    at.append(low + 1 + turn % (high - low))
                else:
                    at.append(high)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "range"])
    return rows


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; a row's next is the following one of its range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = None  # (range, doc_id, text, tree) of the row that waits for its next
    for batch in (c for b in batches for c in row_chunks(b, "text")):
        out = []
        id_type = batch.schema.field("doc_id").type
        for own, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text"))):
            waits = last is not None and last[0] == own
            if copy and not waits:
                continue
            tree = Tree(text)
            if waits:
                _, prev_id, prev, prev_tree = last
                new = edited(prev, text)
                new_tree = Tree(new)
                out.append((prev_id, len(prev), hashlib.sha256(new.encode()).hexdigest(), str(prev_tree), str(new_tree),
                            _likeness(prev_tree.root, prev_tree.sections, new_tree.root, new_tree.sections),
                            _likeness(prev_tree.root, prev_tree.sections, tree.root, tree.sections)))
            last = None if copy else (own, doc_id, text, tree)
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)


def edit_fingerprints(docs: DataFrame, text: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Order: doc_id descending with nulls last, then the text's hash.
    source = docs.select(F.col("doc_id").isNull().alias("absent"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("bigint")), F.lit(0)).alias("k"),
                         F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), "doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = source.select("absent", "k", "h")
    points = _split_points(keys, ranges)
    # First key of every range: as many rows as ranges, on the driver.
    heads = (keys.mapInArrow(_in_ranges(points), "absent boolean, k bigint, h bigint, range bigint")
                 .groupBy("range").agg(F.min(F.struct("absent", "k", "h")).alias("first")).orderBy("range").collect())
    if not heads:
        return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
            ("near_edited", "double"), ("near_next", "double"))])
    follows = [(heads[(i + 1) % len(heads)]["first"], head["range"]) for i, head in enumerate(heads)]
    target = spark.createDataFrame([(f["absent"], f["k"], f["h"], r) for f, r in follows], "absent boolean, k bigint, h bigint, range bigint")
    # One row of each wanted key, then a copy of it for every range that it follows.
    wanted = target.select("absent", "k", "h").distinct()
    copies = (source.join(F.broadcast(wanted), ["absent", "k", "h"], "left_semi").dropDuplicates(["absent", "k", "h"])
                    .join(F.broadcast(target), ["absent", "k", "h"]))
    ranged = source.mapInArrow(_in_ranges(points), f"absent boolean, k bigint, h bigint, doc_id {kind}, text string, range bigint")
    order = ["range", "copy", "absent", "k", "h"]
    both = (ranged.withColumn("copy", F.lit(0)).select(*order, "doc_id", "text")
                  .union(copies.withColumn("copy", F.lit(1)).select(*order, "doc_id", "text")))
    return (both.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions(*order)
                .mapInArrow(_edits, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: fingerprints of all documents and of their edited texts."""
    return edit_fingerprints(read_table(spark, sf_dir, "documents"))

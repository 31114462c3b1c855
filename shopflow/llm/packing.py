"""Packing of tokenised documents into fixed-length sequences (operator 8).

Documents are tokenised in Arrow batches and end with id 2.  A document is
cut into full sequences and one rest, which are written with their ids; the
pieces of randomised groups of documents (a seeded hash of a row number, as
many groups as the corpus's tokens ask for) are packed apart from each other
by first-fit decreasing.  The first bin that still takes a piece is found in a
tournament tree over the bins' free room, in logarithmic time.  ``sequences``
puts the ids of each bin together in the group's task.

Tokenising: the tokenizer drops white space and never joins characters
across it, so a text's ids are those of its chunks between spaces and line
ends in turn; each task keeps a bounded table of the ids of chunks it has met.
A chunk that is one word of Latin letters, or such a word before a run of
signs, is the word's ids and the run's: new words go through the model alone,
joined in one call, and are told apart by their word-end tokens.  All other
chunks go through the whole tokenizer.  Ids are kept as little-endian unsigned
32-bit numbers.

Defined results: a null or empty text is the single id 2; a text of any length
is tokenised whole (a task holds one document's chunks and ids); the
tokenizer's special tokens standing in a text are those tokens, as in the
library; rows with null or repeated doc_ids and repeated rows are documents of
their own; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import give_back, materialize, read_table, text_chunks

CAPACITY = 4096
END_ID = 2
CACHE_ENTRIES = 600_000  # about 150 MB


# Lower-case Latin letters, whose words are one piece for the tokenizer, and
# signs that form a piece of their own in any run.
_WORD = re.compile(r"([a-z\xDF-\xF6\xF8-\xFF]+)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    for printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class ChunkIds:
    """ids of texts by a ``tokenizers`` file, chunk by chunk, as little-endian uint32 bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # The model alone, for chunks that need no other step.
        self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
        self.letters = _byte_letters()
        ends = [i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]
        self.word_end = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.word_end[ends] = True
        self.entries, self.known = entries, {"": b""}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """ids of words of letters: one call, cut after each word-end token."""
        text = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words])
        ids = np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self.word_end[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, new: set[str]) -> None:
        known = self.known
        parts = {c: m.groups() for c in new if (m := _WORD.fullmatch(c))}
        words = list({w for w, _ in parts.values()}.difference(known))
        for i in range(0, len(words), 2000):
            known.update(zip(words[i:i + 2000], self._word_ids(words[i:i + 2000])))
        others = list(new.difference(parts).union(s for _, s in parts.values()).difference(known))
        for i in range(0, len(others), 10_000):
            known.update(zip(others[i:i + 10_000], self._ids(others[i:i + 10_000])))
        for chunk, (word, signs) in parts.items():
            if signs:
                known[chunk] = known[word] + known[signs]

    @staticmethod
    def _lower(text: str) -> str:
        """Lower case where that is the tokenizer's own, letter by letter (Latin-1)
        and the text cannot hold a special token."""
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        chunks = [self._lower(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > self.entries:
            self.known = {"": b""}
        new = set().union(*chunks).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


_PIECE = ["row", "doc_id", "start", "length", "doc_tokens", "ids"]


def _piece_rows(path: str, capacity: int, end_id: int):
    end = struct.pack("<I", end_id)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkIds(path)
        for batch in text_chunks(batches):
            texts = batch.column(0).fill_null("").to_pylist()
            row, start, total, parts = [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    row.append(i)
                    start.append(s)
                    total.append(n)
                    parts.append(ids[4 * s:4 * (s + capacity)])
            take = pa.array(row, pa.int64())
            length = [len(p) // 4 for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), batch.column(2).take(take), *[pa.array(c, pa.int64()) for c in (start, length, total)],
                 pa.array(parts, pa.binary())], names=_PIECE)
        encoder = None
        give_back()
    return rows


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(row, doc_id, start, length, doc_tokens, ids) of every piece, written to
    the shared folder.  ``row`` numbers the documents."""
    source = docs.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), "doc_id")
    kinds = ["bigint", source.schema["doc_id"].dataType.simpleString(), "bigint", "bigint", "bigint", "binary"]
    return materialize(source.mapInArrow(_piece_rows(tokenizer, capacity, end_id), ", ".join(f"{n} {k}" for n, k in zip(_PIECE, kinds))), "pieces")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: largest first, each into the first bin with room."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [capacity] * (2 * leaves)  # tree[i] = most room in the bins below node i
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for p in order.tolist():
        size, node = int(sizes[p]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[p], offset[p] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return where, offset


def _placed(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by([("row", "ascending"), ("start", "ascending")])
    where, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
    return table, (table.column("group").to_numpy() << 32) + where, offset


def _pack_group(capacity: int):
    def place(table):
        table, where, offset = _placed(table, capacity)
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
    return place


def _join_group(capacity: int):
    def join(table):
        """One row per sequence: its pieces in order and their ids together."""
        table, where, offset = _placed(table, capacity)
        order = np.lexsort((offset, where))
        table, where, offset = table.take(pa.array(order)), where[order], offset[order]
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        bounds = pa.array(np.append(starts, len(where)), pa.int32())
        ids = table.column("ids").to_pylist()
        lists = [pa.ListArray.from_arrays(bounds, c) for c in (
            table.column("doc_id").combine_chunks(), table.column("start").combine_chunks(), table.column("length").combine_chunks(), pa.array(offset))]
        joined = [b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]
        return pa.table([pa.array(where[starts]), pa.array([len(x) // 4 for x in joined], pa.int64()), *lists, pa.array(joined, pa.binary())],
                        names=["sequence_id", "n_tokens", "doc_ids", "starts", "lengths", "offsets", "ids"])
    return join


def _grouped(found: DataFrame, seed: int, group_tokens: int) -> DataFrame:
    tokens = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    return found.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(groups)))


def pack(found: DataFrame, capacity: int = CAPACITY, seed: int = 29, group_tokens: int = 1 << 22) -> DataFrame:
    """Adds sequence_id and offset to pieces (row, start, length and others but ids)."""
    narrow = found.drop("ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return _grouped(narrow, seed, group_tokens).groupBy("group").applyInArrow(_pack_group(capacity), f"{fields}, sequence_id bigint, offset bigint")


def sequences(found: DataFrame, capacity: int = CAPACITY, seed: int = 29, group_tokens: int = 1 << 22) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, starts, lengths, offsets, ids): the packed
    sequences of the same groups, with the ids of their pieces in order."""
    kind = found.schema["doc_id"].dataType.simpleString()
    rows = _grouped(found.select("row", "doc_id", "start", "length", "ids"), seed, group_tokens)
    return rows.groupBy("group").applyInArrow(
        _join_group(capacity), f"sequence_id bigint, n_tokens bigint, doc_ids array<{kind}>, starts array<bigint>, "
        "lengths array<bigint>, offsets array<bigint>, ids binary")


def _tokenizer(path: str | None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def packed_sequences(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The sequences of all documents, with their ids."""
    return sequences(pieces(docs, _tokenizer(tokenizer)))


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place; the checksum is that of the written ids."""
    found = pieces(docs, _tokenizer(tokenizer)).withColumn("ids_crc32", F.crc32("ids"))
    return pack(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the pieces of all documents and their sequences."""
    return packed_documents(read_table(spark, sf_dir, "documents"))

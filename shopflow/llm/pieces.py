"""Offset-preserving SentencePiece encoding and decoding (operator 9).

A text is normalised by longest-prefix matches in the model's compiled
character map (a double-array trie) while each normalised byte's place in
the source is recorded; every piece is projected through that record to a
byte span of the source.  Pieces are found by the library itself, on
normalised text: a copy of the model with its normaliser switched off
encodes it whole, long texts in segments that end at a word mark or line end.
No piece of the vocabulary reaches across such an edge (checked when the model
is loaded; otherwise a text is one segment), so the pieces of the segments in
turn are those of the text.  Sizes and surfaces of pieces are table look-ups.

Decoding joins the pieces' surfaces, resolves byte pieces and drops the
space that stands for the dummy prefix.

Defined results: a null text is an empty one (no pieces, decoded to an empty
text); a text of any length is encoded whole, segment by segment; repeated rows give repeated results; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import read_table, row_chunks

MARK = "▁"
_MARK = MARK.encode()
SEGMENT = 1 << 16  # characters that the library gets at once, if they have an edge


class CharMap:
    """A compiled character map: byte strings and what replaces them.

    Layout: size of the trie in bytes, the trie's 32-bit units, then the
    replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:]
        self.first = self._first_bytes()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _first_bytes(self) -> frozenset[int]:
        if not self.units:
            return frozenset()
        root = self._offset(self.units[0])
        return frozenset(b for b in range(1, 256) if (root ^ b) < len(self.units)
                         and self.units[root ^ b] & 0x800000FF == b)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes matched, replacement) of the longest key at ``at``; 0 if none."""
        found, value = 0, 0
        if not self.units:
            return 0, b""
        node = self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return (found, self.texts[value:self.texts.index(b"\0", value)]) if found else (0, b"")


class Pieces(NamedTuple):
    """A text's pieces: their ids (list and array) and bytes, in the normalised
    text or, where that is the source but for marks, in the source."""
    ids: list[int]
    array: np.ndarray
    sizes: np.ndarray


class PieceCoder:
    """Encoding with source spans, and decoding, for one model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape, self.suffix = spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix
        self.plain = not self.charmap.units and not self.squeeze and self.escape and not self.suffix
        kinds = pb.ModelProto.SentencePiece
        self.unk = model.trainer_spec.unk_surface
        self.kind = [p.type for p in model.pieces]
        self.piece = [p.piece for p in model.pieces]
        self.byte = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.UNKNOWN, self.CONTROL = kinds.UNKNOWN, kinds.CONTROL
        plain_pieces = [p.piece for p in model.pieces if p.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)]
        self.apart = not any(MARK in p.lstrip(MARK) for p in plain_pieces) and not any("\n" in p and p != "\n" for p in plain_pieces)
        self.edge = re.compile(f"(?<!{MARK}){MARK}|(?<!\n)\n")
        # By id: bytes in normalised text, word marks, the id in decimal, the surface, and
        # whether a decoder must look at the neighbours (bytes of longer characters, unknown).
        self.size = np.array([1 if i in self.byte else len(p.encode()) for i, p in enumerate(self.piece)], np.int64)
        self.marks = np.array([0 if i in self.byte else p.count(MARK) for i, p in enumerate(self.piece)], np.int64)
        self.number = [str(i) for i in range(len(self.piece))]
        self.text = [self._single(i) for i in range(len(self.piece))]
        self.joint = np.array([k == self.UNKNOWN or (i in self.byte and self.byte[i] >= b"\x80") for i, k in enumerate(self.kind)])
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    # -- normalisation ------------------------------------------------------
    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each normalised byte and of the end)."""
        data = text.encode()
        out, source = bytearray(), []
        space = _MARK if self.escape else b" "
        if not data:
            return "", np.zeros(1, np.int64)
        if self.prefix and not self.suffix:
            out += space
            source += [0] * len(space)
        i, blank = 0, self.squeeze
        while i < len(data):
            n, new = self.charmap.longest(data, i) if data[i] in self.charmap.first else (0, b"")
            same = not n
            if same:
                n = 1 if data[i] < 0xC0 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                new = data[i:i + n]
            for j in range(len(new)):
                if new[j] == 0x20:
                    if not (blank and self.squeeze):
                        out += space
                        source += [i] * len(space)
                    blank = True
                else:
                    out.append(new[j])
                    source.append(i + j if same else i)
                    blank = False
            i += n
        end = len(data)
        if self.squeeze:
            while out.endswith(space) and len(out) > (len(space) if self.prefix and not self.suffix else 0):
                del out[-len(space):]
                end = source[len(out)]
                del source[len(out):]
            if self.prefix and not self.suffix and len(out) == len(space):
                return "", np.zeros(1, np.int64)
        if self.prefix and self.suffix:
            out += space
            source += [end] * len(space)
        return out.decode(), np.array([*source, end], np.int64)

    # -- pieces ----------------------------------------------------------------
    def _unknown_sizes(self, unit: str, ids: list[int], size: list[int]) -> list[int]:
        """Byte sizes when some pieces are unknown: what known neighbours leave."""
        at, data, out = 0, unit.encode(), []
        for k, i in enumerate(ids):
            if self.kind[i] != self.UNKNOWN:
                out.append(size[k])
                at += size[k]
                continue
            nxt = next((self.piece[j].encode() for j in ids[k + 1:k + 2] if self.kind[j] != self.UNKNOWN), None)
            end = data.index(nxt, at + 1) if nxt else len(data)
            out.append(end - at)
            at = end
        return out

    def _single(self, i: int) -> bytes:
        kind = self.kind[i]
        if i in self.byte:
            return self.byte[i]
        return (b"" if kind == self.CONTROL else self.unk.encode() if kind == self.UNKNOWN
                else self.piece[i].replace(MARK, " ").encode())

    def surface(self, ids: list[int]) -> bytes:
        """Decoded bytes, before the dummy prefix is dropped: byte pieces in a row
        are decoded together."""
        out, run = [], b""
        for i in ids:
            if i in self.byte:
                run += self.byte[i]
                continue
            if run:
                out.append(run.decode("utf-8", "replace").encode())
                run = b""
            out.append(self.text[i])
        if run:
            out.append(run.decode("utf-8", "replace").encode())
        return b"".join(out)

    def segments(self, norm: str) -> list[str]:
        """The normalised text, cut at edges that no piece reaches across."""
        if len(norm) <= SEGMENT or not self.apart:
            return [norm] if norm else []
        cuts, at = [0], 0
        while len(norm) - at > SEGMENT:
            found = None
            for found in self.edge.finditer(norm, at + SEGMENT // 2, at + SEGMENT):
                pass  # the last edge of the window
            found = found or self.edge.search(norm, at + SEGMENT)
            if found is None:
                break
            at = found.start()
            cuts.append(at)
        return [norm[a:b] for a, b in zip(cuts, [*cuts[1:], len(norm)])]

    def units(self, texts: list[str]) -> list[tuple[Pieces, np.ndarray | None]]:
        """Per text: its pieces, and the source of its normalised bytes (None where
        every mark stands for one space and all else for itself)."""
        norms, sources, flat, count = [], [], [], []
        for text in texts:
            if self.plain and MARK not in text:
                norm, source = ((MARK if self.prefix else "") + text.replace(" ", MARK), None) if text else ("", None)
            else:
                norm, source = self.normalize(text)
            parts = self.segments(norm)
            norms.append(norm)
            sources.append(source)
            flat += parts
            count.append(len(parts))
        found = iter(self.bare.encode(flat, num_threads=1) if flat else [])
        out = []
        for norm, source, n in zip(norms, sources, count):
            ids = next(found) if n == 1 else [i for _ in range(n) for i in next(found)]
            array = np.array(ids, np.int64)
            size = self.size[array]
            if self.joint[array].any() and self.UNKNOWN in map(self.kind.__getitem__, ids):
                size = np.array(self._unknown_sizes(norm, ids, size.tolist()), np.int64)
            out.append((Pieces(ids, array, size if source is not None else size - 2 * self.marks[array]), source))
        return out

    def spans(self, entries: Pieces, source: np.ndarray | None) -> np.ndarray:
        """(pieces, 2): byte spans of the source."""
        sizes = entries.sizes
        if source is None:
            if len(sizes) and self.prefix:
                sizes[0] -= 1  # the dummy prefix has no source
                ends = np.cumsum(sizes)
                begins = ends - sizes
                sizes[0] += 1
                return np.stack([begins, ends], axis=1)
            ends = np.cumsum(sizes)
            return np.stack([ends - sizes, ends], axis=1)
        ends = np.cumsum(sizes)
        return np.stack([source[ends - sizes], source[ends]], axis=1)

    def decoded(self, entries: Pieces) -> bytes:
        out = self.surface(entries.ids) if self.joint[entries.array].any() else b"".join([self.text[i] for i in entries.ids])
        return out[1:] if self.prefix and out.startswith(b" ") else out

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        (entries, source), = self.units([text])
        return entries.ids, self.spans(entries, source)

    def digest(self, entries: Pieces) -> str:
        """SHA-256 of the ids in decimal, joined by commas."""
        number = self.number
        return hashlib.sha256(",".join([number[i] for i in entries.ids]).encode()).hexdigest()


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded): pieces, their byte spans, the decoded text."""
    source = docs.select(F.col(text).alias("text"), "doc_id")
    kind = source.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model)
        for batch in (c for b in batches for c in row_chunks(b, "text")):
            ids, starts, ends, decoded = [], [], [], []
            for entries, src in coder.units(batch.column(0).fill_null("").to_pylist()):
                spans = coder.spans(entries, src)
                ids.append(entries.array)
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
                decoded.append(coder.decoded(entries).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "starts", "ends", "decoded"])
    return source.mapInArrow(rows, f"doc_id {kind}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string")


def digests(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32, covered_bytes): the same
    pieces, spans and decoded texts, digested in the task that makes them."""
    source = docs.select(F.col(text).alias("text"), "doc_id")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "covered_bytes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(model)
        for batch in (c for b in batches for c in row_chunks(b, "text")):
            n, ids, decoded, crc, covered = [], [], [], [], []
            for entries, src in coder.units(batch.column(0).fill_null("").to_pylist()):
                spans = coder.spans(entries, src)
                n.append(len(spans))
                ids.append(coder.digest(entries))
                decoded.append(hashlib.sha256(coder.decoded(entries)).hexdigest())
                crc.append(zlib.crc32(spans.tobytes()))
                covered.append(int((spans[:, 1] - spans[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(c, t) for c, t in ((n, pa.int64()), (ids, pa.string()), (decoded, pa.string()), (crc, pa.int64()), (covered, pa.int64()))]], names=names)
    return source.mapInArrow(rows, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint, covered_bytes bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: digests of the pieces and decoded texts of all documents."""
    import public_tokenizers
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

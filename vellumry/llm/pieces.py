"""Offset-preserving SentencePiece encoding and decoding.

The model file gives a compiled character map (a double-array trie of UTF-8 prefixes and their
replacements).  Normalisation walks a text, replaces the longest prefix that the map knows, and
records for every byte of the normalised text the source byte range it came from.  The library's
merge core (the same model with its own normaliser switched off) then encodes the normalised text,
and every piece is projected through the alignment onto a byte span of the original.

A normalised text is cut where no piece of the vocabulary can reach across (before the space mark,
around line ends), and the pieces of the parts are remembered, because words repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import slices, texts_of

MARK = "▁"
#: Remembered parts per worker and the longest part that is remembered; a full memory is emptied.
CACHE_PARTS = 700_000
CACHE_CHARS = 48


class CharacterMap:
    """A compiled character map: longest-prefix lookups in its double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:], or None."""
        units, best = self.units, None
        node = self._child_base(units[0], 0)
        for i in range(at, len(data)):
            byte = data[i]
            if byte == 0:
                break
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:  # label; the top bit marks a value
                break
            node = self._child_base(unit, node)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self.texts[start:self.texts.index(0, start)]

    @staticmethod
    def _child_base(unit: int, node: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Normaliser:
    """Normalisation of one model specification with source alignment."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map and not self.squeeze and self.escape

    def _chunks(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Replacement, source start and source end of each longest prefix."""
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found:
                used, text = found
            else:
                used = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                text = data[at:at + used]
            yield text, at, at + used
            at += used

    def __call__(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text, and the source start and end of each of its bytes."""
        data = text.encode()
        space = MARK.encode() if self.escape else b" "
        out, begin, end = bytearray(), [], []
        chunks = list(self._chunks(data))
        if self.squeeze:
            while chunks and chunks[0][0] in (b" ", b""):
                chunks.pop(0)
        if chunks and self.prefix:
            out += space
            begin += [chunks[0][1]] * len(space)
            end += [chunks[0][1]] * len(space)
        after_space = self.squeeze
        for piece, s, e in chunks:
            if after_space:
                piece = piece.lstrip(b" ")
            for byte in piece:
                new = space if byte == 0x20 else bytes([byte])
                out += new
                begin += [s] * len(new)
                end += [e] * len(new)
            if piece:
                after_space = self.squeeze and piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space):], begin[-len(space):], end[-len(space):]
        return out.decode(errors="replace"), begin, end


class Encoder:
    """Encoding with spans, equal to the library's ids, for one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.normalise = Normaliser(model.normalizer_spec)
        pieces = [p.piece for p in model.pieces]
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.core = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.joined, self.opening = {}, {}  # parts after a space, and parts after none
        kinds = model_pb2.ModelProto.SentencePiece
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        #: Bytes of each piece in the normalised text, and in a source where the mark is a space.
        self.normal_bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], "<u4")
        self.source_bytes = np.array([1 if p.type == kinds.BYTE else len(p.piece.replace(MARK, " ").encode()) for p in model.pieces], "<u4")
        self.opens = np.array([p.piece.startswith(MARK) for p in model.pieces])
        self.surfaces = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.line_end = next((i for i, x in enumerate(self.surfaces) if x == b"\n"), -1)
        self.cuts &= model.trainer_spec.byte_fallback and self.line_end >= 0

    def _parts(self, keys: list[str], marked: bool) -> list[tuple[bytes, bytes, bytes]]:
        """(ids, source bytes of each piece, decoded bytes) as packed arrays for plain parts."""
        memory = self.joined if marked else self.opening
        found = list(map(memory.get, keys))
        if None in found:
            fresh = self._fresh(list({k for k, v in zip(keys, found) if v is None}), marked)
            if len(memory) + len(fresh) > CACHE_PARTS:
                memory.clear()
            memory.update((k, v) for k, v in fresh.items() if len(k) <= CACHE_CHARS)
            found = [fresh[k] if v is None else v for k, v in zip(keys, found)]
        return found

    def _fresh(self, keys: list[str], marked: bool) -> dict[str, tuple[bytes, bytes, bytes]]:
        """One call of the core for all keys; a part begins at each mark, or ends at each line end."""
        odd = [k for k in keys if MARK in k or "\n" in k or not k]
        usual = [k for k in keys if k and MARK not in k and "\n" not in k] if odd else keys
        out = {}
        for k in odd:
            out[k] = self._packed(np.array(self.core.encode(MARK + k if marked else k), "<u4"))
        if usual:
            ids = np.array(self.core.encode(MARK + MARK.join(usual) if marked else "\n" + "\n".join(usual)), "<u4")
            starts = np.flatnonzero(self.opens[ids] if marked else ids == self.line_end)
            packed, sizes, plain = self._packed(ids)
            at = np.concatenate([[0], np.cumsum(self.source_bytes[ids], dtype=np.int64)])
            skip = 0 if marked else 1
            lows, highs = (starts + skip).tolist(), [*starts[1:].tolist(), len(ids)]
            for k, s, e, x, y in zip(usual, lows, highs, at[lows].tolist(), at[highs].tolist()):
                out[k] = packed[4 * s:4 * e], sizes[4 * s:4 * e], plain[x:y]
        return out

    def _packed(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        return ids.tobytes(), self.source_bytes[ids].tobytes(), b"".join([self.surfaces[i] for i in ids.tolist()])

    def encode(self, text: str) -> tuple[bytes, bytes, bytes | None]:
        """Packed ids, packed source bytes per piece, and the decoded bytes where they are known."""
        if not text:
            return b"", b"", b""
        if self.cuts and self.normalise.plain and self.normalise.prefix and MARK not in text and "\0" not in text:
            return self._encode_plain(text)
        ids, spans = self.spans(text)
        sizes = np.diff(np.array([0] + [e for _, e in spans]))
        return np.array(ids, "<u4").tobytes(), sizes.astype("<u4").tobytes(), None

    def _encode_plain(self, text: str) -> tuple[bytes, bytes, bytes | None]:
        plan, spaced, opening = [], [], []
        for n, line in enumerate(text.split("\n")):
            if n:
                plan.append((False, len(opening), 1))
                opening.append("\n")
            words = line.split(" ")
            if "" in words:
                words = _merge_spaces(words, bool(n))
            if n:
                if words[0]:
                    plan.append((False, len(opening), 1))
                    opening.append(words[0])
                words = words[1:]
            if words:
                plan.append((True, len(spaced), len(words)))
                spaced.extend(words)
        a, b = self._parts(spaced, True), self._parts(opening, False)
        parts = []
        for marked, at, n in plan:
            parts.extend((a if marked else b)[at:at + n])
        ids, sizes, out = (b"".join(x) for x in zip(*parts))
        if text[0] == " " or text[0] == "\n":
            return ids, self._without_prefix(sizes), None
        return ids, self._without_prefix(sizes), out[1:]

    @staticmethod
    def _without_prefix(sizes: bytes) -> bytes:
        """The first mark is the dummy prefix, which has no source byte."""
        return struct.pack("<I", struct.unpack_from("<I", sizes)[0] - 1) + sizes[4:]

    def spans(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and original byte spans by full normalisation and projection."""
        normal, begin, end = self.normalise(text)
        if not normal:
            return [], []
        ids = self.core.encode(normal)
        if self.unknown.isdisjoint(ids):
            sizes = self.normal_bytes[ids].tolist()
        else:  # only the proto tells how much an unknown piece covers
            sizes = [len(p.surface.encode()) for p in self.core.encode(normal, return_type="proto").pieces]
        spans, at = [], 0
        for size in sizes:
            spans.append((begin[at], end[at + size - 1]) if size else (end[at - 1], end[at - 1]) if at else (0, 0))
            at += size
        return ids, spans

    def framed(self, text: str) -> tuple[bytes, np.ndarray, bytes]:
        """Packed ids between the model's begin and end ids, the end of every id's source byte span
        (empty ones at the borders) and the decoded bytes.  The library decodes the two to nothing."""
        ids, sizes, plain = self.encode(text)
        ids = struct.pack("<I", self.library.bos_id()) + ids + struct.pack("<I", self.library.eos_id())
        ends = np.cumsum(np.concatenate([[0], np.frombuffer(sizes, "<u4"), [0]]), dtype="<u4")
        return ids, ends, self.decode(ids) if plain is None else plain

    def decode(self, ids: bytes) -> bytes:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist()).encode() if ids else b""


def _merge_spaces(words: list[str], keep_first: bool) -> list[str]:
    """Empty words (runs of spaces) become leading marks of the next word, as in the pieces.  The
    first word of a later line has no mark of its own, so it stays apart even if it is empty."""
    out, marks = words[:1] if keep_first else [], 0
    for w in words[len(out):-1]:
        if w:
            out.append(MARK * marks + w)
            marks = 0
        else:
            marks += 1
    return out + [MARK * marks + words[-1]] if len(words) > len(out) else out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a model file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 and n_bytes for each row.

    The ids equal the library's with begin and end ids; the decoded text equals its decode(ids).
    spans_sha256 digests the end of every id's original byte span (the begin id's is 0) as
    little-endian unsigned 32-bit integers, and n_bytes is the end of the last span, which is the
    length of the text in UTF-8.  Null and empty texts are the begin and the end id.  A text of any
    length is encoded whole, in the memory of one row.  A null doc_id stays null; rows that repeat
    stay repeated; an empty table gives no rows; only doc_id and text are read.
    """
    schema = StructType([docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("spans_sha256", StringType()), StructField("n_bytes", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(model)
        for b in slices(batches):
            out = [], [], [], [], []
            for text in texts_of(b.column(1)):
                ids, ends, decoded = code.framed(text)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), hashlib.sha256(ends.tobytes()).hexdigest(), int(ends[-1]))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], schema=pa.schema([("doc_id", b.column(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string()), ("n_bytes", pa.int64())]))

    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix matches in the model's compiled character
map, recording for every normalised byte the source bytes it stands for. Pieces
come from the sentencepiece library, word by word: no piece of the model holds a
space mark behind another character, so words are encoded apart and remembered.
Each piece's normalised bytes are then projected to the original text's bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Remembered, small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words a task remembers in each of two generations.
REMEMBERED = 150_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A compiled character map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` on, and what replaces them."""
        units = self.units
        found = None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, place = found
        return size, self.replacements[place : self.replacements.index(b"\0", place)]


@dataclass(frozen=True)
class Normal:
    """Normalised bytes; byte ``i`` stands for source bytes ``start[i]`` up to ``end[i]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray


class Pieces:
    """A model file with its normaliser, one per task."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            whole = f.read()
        normaliser = next((v for k, v in _fields(whole) if k == 3), b"")
        options = dict(_fields(normaliser))
        self.chars = CharMap(options.get(2, b""))
        self.dummy_prefix = bool(options.get(3, 1))
        self.squeezes = bool(options.get(4, 1))
        self.escapes = bool(options.get(5, 1))
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        self.sizes = np.array(
            [1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(names)], dtype=np.int32
        )
        # Words may be encoded apart if nothing but an identity map, a prefix and
        # escapes is applied, and no piece runs on over a space mark.
        plain = not self.chars.units and self.dummy_prefix and self.escapes and not self.squeezes
        spanning = any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        bytes_known = all(self.model.piece_to_id(f"<0x{b:02X}>") != self.model.unk_id() for b in range(256))
        self.by_word = plain and not spanning and bytes_known
        self.known = Remembered(REMEMBERED)

    def normalised(self, text: str) -> Normal:
        """Longest-prefix normalisation with the source bytes of every byte.

        Bytes put in (the space in front) stand for an empty span of the source.
        """
        source = text.encode("utf-8", "surrogatepass")
        if not self.chars.units and not self.squeezes:
            data = np.frombuffer(source, dtype=np.uint8)
            space = data == 0x20
            size = np.where(space & self.escapes, 3, 1)
            start = np.repeat(np.arange(len(data)), size)
            out = np.repeat(data, size)
            if self.escapes:
                at = np.flatnonzero(np.repeat(space, size))
                out[at] = np.tile(np.frombuffer(MARK.encode(), dtype=np.uint8), len(at) // 3)
            end = start + 1
        else:
            pieces, start, end = self._mapped(source)
            out = np.frombuffer(pieces, dtype=np.uint8)
        front = (MARK if self.escapes else " ").encode()
        if self.dummy_prefix and len(out):
            first = start[0]
            out = np.concatenate([np.frombuffer(front, dtype=np.uint8), out])
            start = np.concatenate([np.full(len(front), first), start])
            end = np.concatenate([np.full(len(front), first), end])
        return Normal(out.tobytes(), start.astype(np.int64), end.astype(np.int64))

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Character by character through the map, spaces escaped and, if asked, squeezed."""
        space = MARK.encode() if self.escapes else b" "
        out, start, end = bytearray(), [], []
        at, after_space = 0, self.squeezes
        while at < len(source):
            match = self.chars.longest(source, at) if self.chars.units else None
            if match is None:
                lead = source[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                match = size, source[at : at + size]
            size, new = match
            if self.squeezes and after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.squeezes and new.endswith(b" ")
            new = new.replace(b" ", space)
            out += new
            start += [at] * len(new)
            end += [at + size] * len(new)
            at += size
        while self.squeezes and out.endswith(space):
            del out[-len(space) :], start[-len(space) :], end[-len(space) :]
        return bytes(out), np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, exactly the library's."""
        if not self.by_word:
            return [np.array(x, dtype=np.int32) for x in self.model.encode(texts, num_threads=1)]
        known = self.known
        split = [words_apart(x) for x in texts]
        fresh = known.missing(set().union(*split))
        for word, ids in zip(fresh, self.model.encode(fresh, num_threads=1)):
            known[word] = np.array(ids, dtype=np.int32).tobytes()
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.int32) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.model.decode([x.tolist() for x in ids], num_threads=1)

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of every piece in the original text's bytes."""
        normal = self.normalised(text)
        if not len(ids):
            return np.zeros((0, 2), dtype=np.int64)
        if self.by_word or not (ids == self.model.unk_id()).any():
            last = np.cumsum(self.sizes[ids])
        else:  # an unknown piece has the length of what it stands for
            said = self.model.encode(text, out_type="immutable_proto").pieces
            last = np.cumsum([len(p.piece.encode()) for p in said])
        if last[-1] != len(normal.data):
            raise ValueError("pieces and normalised text differ in length")
        first = np.concatenate([[0], last[:-1]])
        return np.stack([normal.start[first], np.maximum(normal.end[last - 1], normal.start[first])], axis=1)


def words_apart(text: str) -> list[str]:
    """The text cut at spaces, each word with the spaces that follow the first one before it.

    A word is encoded with a space in front, so the space cut away comes back.
    Empty text has no words.
    """
    if not text:
        return []
    words = text.split(" ")
    if "" not in words and MARK not in text:
        return words
    return re.split(f"(?<=[^ {MARK}]) (?=.)", text, flags=re.S)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


ENCODED = "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, starts, ends, decoded`` of each text.

    ``starts`` and ``ends`` are byte offsets of the pieces in the original text.
    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null text is
    empty text and has no pieces; repeated rows are encoded alike. ``path`` is a
    model file that every executor has. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = pieces.encode(texts)
            spans = [pieces.spans(x, i) for x, i in zip(texts, ids)]
            lengths = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), dtype=np.int64)

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))

            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": lists(np.concatenate([*ids, np.zeros(0, dtype=np.int32)])),
                    "starts": lists(np.ascontiguousarray(flat[:, 0])),
                    "ends": lists(np.ascontiguousarray(flat[:, 1])),
                    "decoded": pa.array(pieces.decode(ids), pa.string()),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def _digested(docs: DataFrame, path: str, *, ids_too: bool) -> DataFrame:
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        pieces = pieces_of(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = pieces.encode(texts)
            hashed = [hashlib.sha256(str(x.tolist())[1:-1].replace(" ", "").encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(x.encode()).hexdigest() for x in pieces.decode(ids)]
            spans = [crc32(pieces.spans(x, i).astype("<i8").tobytes()) for x, i in zip(texts, ids)]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array(hashed, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
                "spans_crc32": pa.array(spans, pa.int64()),
            }
            if ids_too:
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, dtype=np.int32)])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_pydict(columns)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(digest, DIGESTS + ", ids array<int>" * ids_too)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of the ids, the decoded text and the spans of each text.

    Encodes, projects and decodes as ``encoded`` does, but what leaves the task
    is one thin row per document.
    """
    return _digested(docs, path, ids_too=False)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``digests`` with the ids themselves."""
    return _digested(docs, path, ids_too=True)

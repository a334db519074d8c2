"""Token ids in binary files, coded by a static range asymmetric numeral system.

One table of symbol frequencies, counted over all documents, is shared by all
blocks. A block of ids is coded on its own by interleaved lanes, so blocks decode
in parallel; an index of checkpoints gives each block's place, first id and
checksum.

Blocks stand in files, one record after another, each followed by a line feed:

    block     b"RNSB", file, block, ids, lanes, words, documents, CRC-32 of the ids;
              documents (id, null flag, ids) that begin in the block; lane states; words

A stretch of documents has a number, ``file``, and its blocks are numbered from 0,
so the order of all ids is that of ``file, block``, whatever part file holds a
block. The table is a file of its own: b"RNSQ", length, compressed frequencies.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.storage import scratch_path, written
from .common import Remembered, shuffle_width, small_batches
from .files import append_files, list_files, opened

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Frequencies of the table sum to 2 ** PRECISION.
PRECISION = 18
#: Ids of a block, and lanes that share its words.
BLOCK = 1 << 17
LANES = 1024
#: A file is cut at the first document that begins after so many ids.
FILE_IDS = 1 << 22
#: Words a task remembers in each of two generations.
REMEMBERED = 300_000
#: Words encoded as one text.
WORDS_AT_ONCE = 2000

LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Tokens

#: Printing characters of ASCII and Latin-1. Where one stands on either side of a
#: single space, the usual pattern of byte-level vocabularies begins a token at that
#: space, so what stands before and behind it can be encoded apart.
SOLID = "!-~À-ÿ"
SEAM = re.compile(f"(?<=[{SOLID}]) (?=[{SOLID}])")
ALONE = re.compile(f"[{SOLID}](?:.*[{SOLID}])?", re.S)
#: Letters, then marks: tokens never run from the ones into the others.
MARKS = ".,;:!?*%$#&|"
PLAIN = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*")


class Encoder:
    """Ids of whole texts by the tokenizers library, with words remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known = Remembered(REMEMBERED)
        self.letters = Remembered(REMEMBERED)
        names = self.model.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)
        self.spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        # The seams rest on this pattern; other pre-tokenizers encode whole texts.
        self.by_word = (
            self.model.normalizer is None
            and type(self.model.pre_tokenizer).__name__ == "ByteLevel"
            and not self.model.pre_tokenizer.add_prefix_space
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(x.ids, dtype="<u4").tobytes()
            for x in self.model.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space in front, many words in one text.

        All words begin and end in printing characters and hold no space, so a
        token begins with a space exactly where a word begins.
        """
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            (made,) = self.model.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(made.ids, dtype="<u4")
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(some):
                raise ValueError("tokens and words differ in number")
            data, edges = ids.tobytes(), (4 * np.append(begins, len(ids))).tolist()
            out += [data[i:j] for i, j in zip(edges, edges[1:])]
        return out

    def _learn(self, words: list[str]) -> set[str]:
        """Remember the ids of words with a space in front, by their letters and marks.

        Returned are words that don't stand alone, which are not remembered.
        """
        unsafe, kept, fronts, marked = set(), [], [], []
        for word in words:
            front = word.rstrip(MARKS)
            # most words are ASCII letters; a pattern looks at the others
            if not (front.isascii() and front.isalpha()) and not PLAIN.fullmatch(word):
                if not ALONE.fullmatch(word):
                    unsafe.add(word)
                    continue
                front = word
            if len(front) < len(word):
                marked.append((word, front))
            else:
                kept.append(word)
            fronts.append(front)
        letters, known = self.letters, self.known
        fresh = letters.missing(set(fronts))
        letters.update(zip(fresh, self._spaced(fresh)))
        known.update(zip(kept, map(letters.__getitem__, kept)))
        marks = list({word[len(front) :] for word, front in marked})
        ids = dict(zip(marks, self._whole(marks)))
        for word, front in marked:
            known[word] = letters[front] + ids[word[len(front) :]]
        return unsafe

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.by_word:
            return self._whole(texts)
        split = [text.split(" ") for text in texts]
        fresh = self.known.missing(set().union(*(words[1:] for words in split)))
        unsafe = self._learn(fresh)
        odd: set[str] = set()
        for i, (text, words) in enumerate(zip(texts, split)):
            if not unsafe.isdisjoint(words[1:]) or words[0] and not ALONE.fullmatch(words[0][-1]):
                split[i] = SEAM.split(text)
                odd.update(split[i][1:])
        rest = [x for x in odd if x not in self.known]  # whole stretches of text: not remembered
        known = ChainMap(self.known, dict(zip(rest, self._whole([" " + x for x in rest]))))
        first = self._whole([words[0] for words in split])
        out = []
        for ids, words in zip(first, split):
            try:
                out.append(ids + b"".join(map(self.known.__getitem__, words[1:])))
            except KeyError:
                out.append(ids + b"".join(map(known.__getitem__, words[1:])))
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One per Python worker: its next tasks know the words of earlier ones."""
    return Encoder(path)


# Coding


def frequency_table(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of a power-of-two sum; every symbol that occurs has at least one."""
    used = np.flatnonzero(counts)
    whole = 1 << precision
    if len(used) > whole:
        raise ValueError("more symbols than the precision has places")
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return out
    exact = counts[used] / counts[used].sum() * whole
    share = np.maximum(1, np.floor(exact)).astype(np.int64)
    left = whole - int(share.sum())
    if left >= 0:  # the largest remainders first
        order = np.lexsort((used, share - exact))
        share[order[: left % len(order)]] += 1
        share += left // len(order)
    else:  # take back from the most frequent
        for at in np.argsort(-share, kind="stable"):
            back = min(-left, int(share[at]) - max(1, int(share[at]) // 2))
            share[at] -= back
            left += back
            if not left:
                break
    out[used] = share
    return out


class Coder:
    """Encoder and decoder of blocks under one table."""

    def __init__(self, table: np.ndarray, precision: int = PRECISION):
        self.bits = np.uint64(precision)
        self.mask = np.uint64((1 << precision) - 1)
        self.size = table.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(table)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(table), dtype=np.uint32), table)
        self.limit = self.size << np.uint64(63 - precision)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """Final lane states and words, in the order the decoder reads them."""
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            now = ids[at : at + lanes]
            x, size = state[: len(now)], self.size[now]
            full = np.flatnonzero(x >= self.limit[now])
            if len(full):
                words.append(x[full].astype(np.uint32))
                x[full] >>= WORD_BITS
            whole = x // size
            x[:] = (whole << self.bits) + (x - whole * size) + self.first[now]
        return state, np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)

    def decode(self, count: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.empty(count, dtype=np.uint32)
        state, read, lanes = state.copy(), 0, len(state)
        for at in range(0, count, lanes):
            x = state[: min(lanes, count - at)]
            slot = x & self.mask
            now = self.symbol[slot]
            out[at : at + len(now)] = now
            x[:] = self.size[now] * (x >> self.bits) + slot - self.first[now]
            short = np.flatnonzero(x < LOW)
            if len(short):
                if read + len(short) > len(words):
                    raise ValueError("a block's words end early, so its checksum differs")
                x[short] = (x[short] << WORD_BITS) | words[read : read + len(short)]
                read += len(short)
        return out


BLOCK_HEAD = struct.Struct("<4sqIIIIII")
DOC = struct.Struct("<qBI")


def doc_entry(doc: int | None, count: int) -> bytes:
    return DOC.pack(doc or 0, doc is None, count)


def block_record(coder: Coder, ids: np.ndarray, docs: bytes, file: int = 0, block: int = 0) -> bytes:
    lanes = min(LANES, max(1, len(ids)))
    state, words = coder.encode(ids, lanes)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = BLOCK_HEAD.pack(b"RNSB", file, block, len(ids), lanes, len(words), len(docs) // DOC.size, crc)
    return head + docs + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def block_head(head: bytes) -> dict[str, int]:
    """What a block says of itself, with the bytes of its whole record."""
    mark, file, block, count, lanes, n_words, n_docs, crc = BLOCK_HEAD.unpack(head)
    if mark != b"RNSB":
        raise ValueError("no block begins here")
    length = BLOCK_HEAD.size + n_docs * DOC.size + 8 * lanes + 4 * n_words
    return {"file": file, "block": block, "n_ids": count, "lanes": lanes, "n_docs": n_docs, "n_words": n_words, "crc": crc, "length": length}


def read_block(coder: Coder, record: bytes) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """Ids of a block, checked, and the documents that begin in it."""
    head = block_head(record[: BLOCK_HEAD.size])
    at = BLOCK_HEAD.size
    docs = [DOC.unpack_from(record, at + i * DOC.size) for i in range(head["n_docs"])]
    at += head["n_docs"] * DOC.size
    state = np.frombuffer(record, dtype="<u8", count=head["lanes"], offset=at).astype(np.uint64)
    words = np.frombuffer(record, dtype="<u4", count=head["n_words"], offset=at + 8 * head["lanes"]).astype(np.uint64)
    ids = coder.decode(head["n_ids"], state, words)
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["crc"]:
        raise ValueError("a block's checksum differs")
    return ids, [(None if null else doc, n) for doc, null, n in docs]


# Writing

STAGED = "file long, block int, ids binary, docs binary, symbols array<int>, counts array<long>"


def narrow(ids: np.ndarray) -> bytes:
    """Ids in 16 bits each if all fit, behind a byte that says so."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return b"\x02" + ids.astype("<u2").tobytes() if small else b"\x04" + ids.astype("<u4").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.uint32)


def _staged(docs: DataFrame, path: str, block: int, file_ids: int) -> DataFrame:
    """Blocks of plain ids, in order of document within each range slice."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        part = None
        file = number = first = 0
        kept: list[bytes] = []  # ids not yet staged
        size = 0
        entries: list[bytes] = []

        def cut(ids: np.ndarray, entries: list[bytes]) -> pa.RecordBatch:
            nonlocal number, first
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            made = pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([(part << 24) + file], pa.int64()),
                    "block": pa.array([number], pa.int32()),
                    "ids": [narrow(ids)],
                    "docs": [b"".join(entries)],
                    "symbols": pa.array([symbols.astype(np.int32)], pa.list_(pa.int32())),
                    "counts": pa.array([counts[symbols]], pa.list_(pa.int64())),
                }
            )
            number, first = number + 1, first + len(ids)
            return made

        for batch in batches:
            part = batch.column("part")[0].as_py()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                if first + size >= file_ids:  # the next document begins another file
                    yield cut(np.frombuffer(b"".join(kept), dtype="<u4"), entries)
                    kept, size, entries = [], 0, []
                    file, number, first = file + 1, 0, 0
                entries.append(doc_entry(doc, len(ids) // 4 + 1))
                kept += [ids, end]
                size += len(ids) // 4 + 1
                if size >= block:
                    flat = np.frombuffer(b"".join(kept), dtype="<u4")
                    for at in range(0, size - block + 1, block):
                        yield cut(flat[at : at + block], entries)
                        entries = []
                    rest = flat[size // block * block :]
                    kept, size = [rest.tobytes()], len(rest)
        if size or entries:
            yield cut(np.frombuffer(b"".join(kept), dtype="<u4"), entries)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "_tie")
        .withColumn("part", F.spark_partition_id().cast("long"))
        .sortWithinPartitions("doc_id", "_tie")
        .select("part", "doc_id", "text")
    )
    return ordered.mapInArrow(stage, STAGED)


def write_ids(
    docs: DataFrame, path: str, *, block: int = BLOCK, file_ids: int = FILE_IDS
) -> str:
    """Encode all texts and write their ids: the folder of the files.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Documents
    stand in ascending ``doc_id``, null ids first, rows of one id by a hash of
    their text; each ends with id ``END_ID``; null text is empty. Files hold
    whole documents and follow each other in the same order. The symbol counts
    of all blocks are summed by Spark; only the table, bounded by the
    vocabulary, reaches the driver. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stage = scratch_path(spark, "ids-staged")
    _staged(docs, path, block, file_ids).write.option("compression", "zstd").parquet(stage)
    blocks = spark.read.schema(STAGED).parquet(stage)
    counted = (
        blocks.select(F.explode(F.arrays_zip("symbols", "counts")).alias("s"))
        .groupBy(F.col("s.symbols").alias("symbol"))
        .agg(F.sum("s.counts").alias("n"))
        .toArrow()
    )  # at most one row per symbol of the vocabulary
    symbols = counted.column("symbol").to_numpy()
    counts = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, dtype=np.int64)
    counts[symbols] = counted.column("n").to_numpy()
    table = frequency_table(counts)
    shared = spark.sparkContext.broadcast(table.astype(np.uint32))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "block", "ids", "docs")))
            made = [block_record(coder, widened(ids), docs, file, block) for file, block, ids, docs in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(made, pa.binary())], ["file", "block", "record"]
            )

    coded = blocks.select("file", "block", "ids", "docs").mapInArrow(code, "file long, block int, record binary")
    out = scratch_path(spark, "ids")
    append_files(coded, f"{out}/blocks", file="file", order=["block"], content="record", end="\n")
    packed = b"RNSQ" + struct.pack("<I", len(table)) + zlib.compress(table.astype("<u4").tobytes())
    one = pa.table({"file": pa.array([0], pa.int64()), "block": pa.array([0], pa.int32()), "record": [packed]})
    append_files(spark.createDataFrame(one), f"{out}/table", file="file", order=["block"], content="record", end="\n")
    _checkpoints(spark, f"{out}/blocks").write.parquet(f"{out}/index")
    return out


POINTS = "file long, block int, path string, offset long, length long, n_ids long, crc long"


def _checkpoints(spark, folder: str) -> DataFrame:
    """The index: every block's place and checksum, and its first id among all ids.

    Tasks step from head to head through the files. First ids are running sums:
    over the blocks of a stretch, over the stretches of a range slice, and over
    the slices, which are as many as a shuffle has partitions.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                rows = heads(path, size)
                names = ["file", "block", "offset", "length", "n_ids", "crc"]
                columns = {n: [r[n] for r in rows] for n in names} | {"path": [path] * len(rows)}
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(POINTS))
    files = list_files(spark, folder).select("path", "bytes").repartition(shuffle_width(spark), "path")
    points = written(files.mapInArrow(walk, POINTS), "ids-points")

    def before(*by: str, order: str) -> Window:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    part = F.shiftright("file", 24).alias("part")
    stretches = points.groupBy("file", part).agg(F.sum("n_ids").alias("n"))
    slices = stretches.groupBy("part").agg(F.sum("n").alias("n"))
    slices = slices.select("part", F.coalesce(F.sum("n").over(before(order="part")), F.lit(0)).alias("base"))
    stretches = stretches.join(slices, "part").select(
        "file", (F.col("base") + F.coalesce(F.sum("n").over(before("part", order="file")), F.lit(0))).alias("base")
    )
    inside = F.coalesce(F.sum("n_ids").over(before("file", order="block")), F.lit(0))
    return points.join(stretches, "file").select("*", (F.col("base") + inside).alias("start")).drop("base")


# Reading


def read_table(path: str) -> np.ndarray:
    with opened(path) as f:
        data = f.read()
    (count,) = struct.unpack_from("<I", data, 4)
    return np.frombuffer(zlib.decompressobj().decompress(data[8:]), dtype="<u4", count=count)


def heads(path: str, size: int) -> list[dict[str, int]]:
    """The blocks of a file, from head to head."""
    out, at = [], 0
    with opened(path) as f:
        while at < size:
            head = block_head(f.read_at(BLOCK_HEAD.size, at))
            out.append(head | {"offset": at})
            at += head["length"] + 1
    return out


def read_stretch(coder: Coder, points: list[dict]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``doc_id, start, ids`` of a stretch's documents in order, one block in memory at a time."""
    start = points[0]["start"]
    waiting: list[tuple[int | None, int]] = []
    held: list[np.ndarray] = []
    have = 0
    for point in points:
        with opened(point["path"]) as f:
            ids, docs = read_block(coder, f.read_at(point["length"], point["offset"]))
        waiting += docs
        held.append(ids)
        have += len(ids)
        if waiting and have >= waiting[0][1]:
            flat, at, done = np.concatenate(held), 0, 0
            for doc, count in waiting:
                if at + count > have:
                    break
                yield doc, start, flat[at : at + count]
                at, start, done = at + count, start + count, done + 1
            held, have, waiting = [flat[at:]], have - at, waiting[done:]


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"


def read_ids(spark, folder: str, *, ids: bool = True) -> DataFrame:
    """Documents read back from the files below ``folder``; ``ids`` null if not asked for."""
    small_batches(spark)
    table_path = list_files(spark, f"{folder}/table").first().path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(read_table(table_path))
        for batch in batches:
            for points in batch.column("points").to_pylist():
                rows: list[tuple] = []
                for doc, start, found in read_stretch(coder, points):
                    crc = zlib.crc32(found.astype("<u4").tobytes())
                    rows.append((doc, start, len(found), crc, found if ids else None))
                    if len(rows) == 1024:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # a stretch holds at most FILE_IDS ids and one more document, so few points
    index = spark.read.schema(POINTS + ", start long").parquet(f"{folder}/index")
    point = F.struct("block", "path", "offset", "length", "start")
    stretches = index.groupBy("file").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return stretches.select("points").mapInArrow(read, READ)

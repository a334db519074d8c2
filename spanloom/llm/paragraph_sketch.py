"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a sentence, line or stretch of at most ``LONGEST`` characters, so
an edit changes the paragraphs around it and no others. Its digest is 64 bits; the
k-th repeat in a document has a digest of its own, so repeats count. A sketch
throws every digest into one cell of each of three rows; a cell keeps a count, the
digests xored and their check sums xored. Sketches of two versions subtract cell
by cell: what both hold vanishes, and a cell left with one digest gives it away
(its check sum fits). Taking that digest out of its other cells bares more, until
all differing digests are recovered, or a core is left that no cell resolves. Then
both are sketched again, four times as large with new places, until it works.

The fingerprint is the smallest sketch: 512 characters for a text of any length.
Likeness is the number of paragraphs shared over the number in either.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.storage import written_counted
from .common import small_batches

#: Characters of a paragraph at most.
LONGEST = 80
PARAGRAPH = re.compile(
    rf"[^.!?\n。！？]{{0,{LONGEST}}}[.!?\n。！？]+|[^.!?\n。！？]{{1,{LONGEST}}}"
)
#: Cells of a fingerprint, and the factor of each larger try.
CELLS = 24
LARGER = 4
ROWS = 3
#: Cells that are subtracted and peeled together.
TOGETHER = 1 << 20
#: Bytes of text in a slice of the order of ids.
SLICE_BYTES = 32 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    """Paragraphs of a text; joined they give the text."""
    return PARAGRAPH.findall(text)


class Digests:
    """Paragraph digests of several texts, text after text."""

    def __init__(self, texts: list[str]):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        found = [[digest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(t)] for t in texts]
        self.sizes = np.array([len(f) for f in found], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        keys = np.fromiter((d for f in found for d in f), dtype=np.uint64, count=int(self.sizes.sum()))
        place = np.repeat(np.arange(len(texts)), self.sizes)
        order = np.lexsort((keys, place))
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (place[order][1:] != place[order][:-1])
        at = np.arange(len(keys))
        repeat = np.zeros(len(keys), dtype=np.uint64)
        repeat[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        self.keys = np.where(repeat > 0, mixed(keys + repeat * GOLDEN), keys)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the texts ``which``, and for each its place in ``which``."""
        sizes = self.sizes[which]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts = np.repeat(self.ends[which] - sizes, sizes)
        return self.keys[starts + inside], np.repeat(np.arange(len(which)), sizes)


class Sketches:
    """Cells of several texts' digests, ``cells`` of them for each."""

    def __init__(self, texts: int, cells: int):
        self.cells = cells
        self.counts = np.zeros(texts * cells, dtype=np.int32)
        self.keys = np.zeros(texts * cells, dtype=np.uint64)
        self.checks = np.zeros(texts * cells, dtype=np.uint32)

    @staticmethod
    def check(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)

    def add(self, keys: np.ndarray, text: np.ndarray, by) -> None:
        """Add digests ``by`` 1 or take them out by -1."""
        width = self.cells // ROWS
        checks = self.check(keys)
        by = np.broadcast_to(np.asarray(by, dtype=np.int32), keys.shape)
        for row in range(ROWS):
            seed = np.uint64((self.cells * ROWS + row + 1) * int(GOLDEN) % (1 << 64))
            spot = mixed(keys ^ seed) % np.uint64(width)
            cell = text * self.cells + row * width + spot.astype(np.int64)
            np.add.at(self.counts, cell, by)
            np.bitwise_xor.at(self.keys, cell, keys)
            np.bitwise_xor.at(self.checks, cell, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.counts = self.counts - other.counts
        out.keys = self.keys ^ other.keys
        out.checks = self.checks ^ other.checks
        return out

    def packed(self) -> list[bytes]:
        """One text's cells after another: counts, then digests, then check sums."""
        parts = (self.counts.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4"))
        each = [p.reshape(-1, self.cells) for p in parts]
        return [b"".join(e[i].tobytes() for e in each) for i in range(len(each[0]))]

    @staticmethod
    def unpacked(packed: list[bytes], cells: int) -> Sketches:
        out = Sketches(0, cells)
        whole = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), cells * 16)
        out.counts = whole[:, : cells * 4].copy().view("<i4").reshape(-1)
        out.keys = whole[:, cells * 4 : cells * 12].copy().view("<u8").reshape(-1)
        out.checks = whole[:, cells * 12 :].copy().view("<u4").reshape(-1)
        return out

    def sizes(self) -> np.ndarray:
        """Paragraphs of each text: every one is in one cell of the first row."""
        return self.counts.reshape(-1, self.cells)[:, : self.cells // ROWS].sum(axis=1, dtype=np.int64)

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``text, digest, sign`` of all recovered digests, and per text whether that is all of them."""
        found = []
        for _ in range(2 * self.cells):  # each round takes a digest out, or a false one was taken
            single = np.flatnonzero(np.abs(self.counts) == 1)
            single = single[self.check(self.keys[single]) == self.checks[single]]
            if not len(single):
                break
            taken = np.rec.fromarrays([single // self.cells, self.keys[single], self.counts[single]])
            taken = np.unique(taken)
            found.append(taken)
            self.add(taken.f1, taken.f0, -taken.f2)
        empty = (self.counts == 0) & (self.keys == 0) & (self.checks == 0)
        whole = empty.reshape(-1, self.cells).all(axis=1)
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none.astype(np.uint64), none, whole
        every = np.concatenate(found)
        return every["f0"], every["f1"], every["f2"], whole


def sketched(digests: Digests, which: np.ndarray, cells: int = CELLS) -> Sketches:
    out = Sketches(len(which), cells)
    out.add(*digests.of(which), 1)
    return out


def likeness(left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Shared paragraphs over those in either, from both counts and the number that differ."""
    either = (left + right + apart) / 2
    return np.where(either == 0, 1.0, (left + right - apart) / 2 / np.maximum(either, 1))


def compared(a: Digests, left: np.ndarray, b: Digests, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of texts ``left`` of ``a`` and ``right`` of ``b``, and the cells it took."""
    apart = np.zeros(len(left), dtype=np.int64)
    took = np.zeros(len(left), dtype=np.int64)
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        failed = []
        step = max(1, TOGETHER // cells)
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            text, _, _, whole = sketched(a, left[part], cells).minus(sketched(b, right[part], cells)).peeled()
            apart[part] = np.bincount(text, minlength=len(part))
            took[part] = cells
            failed.append(part[~whole])
        todo, cells = np.concatenate(failed), cells * LARGER
    return likeness(a.sizes[left], b.sizes[right], apart), took


def spelled(sketches: Sketches) -> list[str]:
    return [base64.b64encode(p).decode() for p in sketches.packed()]


#: Stands for a null id in the order of ids.
NO_ID = -(1 << 63)


def _followed(docs: DataFrame) -> DataFrame:
    """Rows dealt into slices of the order of ids, each slice ended by the first row of the next.

    Columns ``_slice, _border, doc_id, _key, _hash, text``. Cuts are the first keys
    of range partitions, two numbers for every ``SLICE_BYTES`` of text. The text
    moves once. Rows that tie in id are ordered by a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(NO_ID)).alias("_key"), F.xxhash64("text").alias("_hash"))
    held = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    slices = max(1, -(-(held or 0) // SLICE_BYTES))
    keys = rows.select("_key", "_hash").repartitionByRange(slices, "_key", "_hash")
    cuts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("_key", "_hash")).alias("cut"))
    cuts = sorted((r["cut"]["_key"], r["cut"]["_hash"]) for r in cuts.collect())
    cut_keys = np.array([k for k, _ in cuts], dtype=np.int64)
    cut_hashes = np.array([h for _, h in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def slice_of(key: pd.Series, hashed: pd.Series) -> pd.Series:
        key, hashed = key.to_numpy(), hashed.to_numpy()
        low, high = np.searchsorted(cut_keys, key, "left"), np.searchsorted(cut_keys, key, "right")
        out = low - 1
        for i in np.flatnonzero(high > low):  # ids that are cuts
            out[i] += np.searchsorted(cut_hashes[low[i] : high[i]], hashed[i], "right")
        return pd.Series(np.maximum(out, 0).astype(np.int32))

    inside = rows.withColumn("_slice", slice_of("_key", "_hash")).withColumn("_border", F.lit(False))
    firsts = spark.createDataFrame(
        [(k, h, (i - 1) % len(cuts)) for i, (k, h) in enumerate(cuts)], "_key long, _hash long, _slice int"
    )  # no more rows than slices
    border = rows.join(F.broadcast(firsts), ["_key", "_hash"]).dropDuplicates(["_slice"])
    both = inside.unionByName(border.withColumn("_border", F.lit(True)))
    return both.repartitionById(max(1, len(cuts)), "_slice").sortWithinPartitions("_slice", "_border", "_key", "_hash")


FOUND = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_cells long, next_cells long"
)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Each document with the fingerprints of its text and of an edited text.

    The edited text has the second half of the code points replaced by the first
    as many of the next document in ascending ``doc_id`` (all, if it has fewer;
    after the last document comes the first). ``near_edited`` and ``near_next``
    are the likeness to the edited text and to the next document,
    ``edited_cells`` and ``next_cells`` the size of the sketches that told them.

    Takes ``doc_id`` and ``text``; other columns are ignored. A null text is
    empty, two empty texts are alike (1.0). Null ids come first, rows that repeat
    an id follow each other by a hash of the text, every row is returned. A single
    document is its own next; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            ids = [*(h[0] for h in held), *batch.column("doc_id").to_pylist()]
            texts = [*(h[1] for h in held), *batch.column("text").to_pylist()]
            border = np.array([*(h[2] for h in held), *batch.column("_border").to_pylist()], dtype=bool)
            held = ((ids[-1], texts[-1], border[-1]),) if len(ids) else ()
            own = np.flatnonzero(~border[:-1])  # each is followed by its next
            if not len(own):
                continue
            keep = [len(texts[i]) - len(texts[i]) // 2 for i in own]
            edited = [texts[i][:k] + texts[i + 1][: len(texts[i]) - k] for i, k in zip(own, keep)]
            mine, theirs, every = Digests(texts), Digests(edited), np.arange(len(own))
            near_edited, edited_cells = compared(mine, own, theirs, every)
            near_next, next_cells = compared(mine, own, mine, own + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array(spelled(sketched(mine, own))),
                    pa.array(spelled(sketched(theirs, every))),
                    pa.array(near_edited),
                    pa.array(near_next),
                    pa.array(edited_cells),
                    pa.array(next_cells),
                ],
                [c.split()[0] for c in FOUND.split(", ")],
            )

    return _followed(docs).select("doc_id", "text", "_border").mapInArrow(digest, FOUND)


def _versions(docs: DataFrame, cells: int) -> DataFrame:
    """``doc_id, hash, sketch``: of rows that repeat an id, the one with the least text hash."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = Digests([t or "" for t in batch.column("text").to_pylist()])
            for at in range(0, len(digests.sizes), step := max(1, TOGETHER // cells)):
                some = np.arange(at, min(at + step, len(digests.sizes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(some)),
                        batch.column("hash").slice(at, len(some)),
                        pa.array(sketched(digests, some, cells).packed(), pa.binary()),
                    ],
                    ["doc_id", "hash", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    made = rows.mapInArrow(sketch, "doc_id long, hash long, sketch binary")
    return made.groupBy("doc_id").agg(F.min(F.struct("hash", "sketch")).alias("v")).select("doc_id", "v.sketch")


CHANGES = "doc_id long, n_old long, n_new long, removed array<long>, added array<long>, likeness double, cells long"


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of either table, the paragraph digests that two versions differ in.

    ``doc_id, n_old, n_new, removed, added, likeness, cells``. Only sketches meet,
    not texts: they are joined by id (null ids are one document), subtracted and
    peeled; documents whose core is left are sketched again from their texts,
    ``LARGER`` times as large, the others are done. A document missing from one
    table has no paragraphs there. Of rows that repeat an id, the text with the
    least hash counts. Two empty tables give no rows.
    """
    small_batches(old.sparkSession)
    cells, done = CELLS, []
    while True:
        a = _versions(old, cells).withColumnRenamed("sketch", "a")
        b = _versions(new, cells).select(F.col("doc_id").alias("_id"), F.col("sketch").alias("b"))
        pairs = a.join(b, a["doc_id"].eqNullSafe(b["_id"]), "full").select(
            F.coalesce("doc_id", "_id").alias("doc_id"), "a", "b"
        )
        met, _ = written_counted(pairs.mapInArrow(_subtracted(cells), CHANGES + ", failed boolean"), "sketch-changes")
        done.append(met.where("not failed").drop("failed"))
        failed, count = written_counted(met.where("failed").select(F.col("doc_id").alias("_id")), "sketch-failed")
        if not count:
            break
        cells *= LARGER
        old, new = (v.join(failed, v["doc_id"].cast("long").eqNullSafe(failed["_id"]), "left_semi") for v in (old, new))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _subtracted(cells: int):
    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = bytes(16 * cells)
        for batch in batches:
            for at in range(0, len(batch), step := max(1, TOGETHER // cells)):
                part = batch.slice(at, step)
                a, b = (Sketches.unpacked([x or none for x in part.column(c).to_pylist()], cells) for c in ("a", "b"))
                text, digest, sign, whole = a.minus(b).peeled()
                digest = digest.view(np.int64)
                sides = []
                for s in (1, -1):
                    mine = np.flatnonzero(sign == s)
                    mine = mine[np.lexsort((digest[mine], text[mine]))]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(text[mine], minlength=len(part)))])
                    sides.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(digest[mine])))
                apart = np.bincount(text, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(a.sizes()),
                        pa.array(b.sizes()),
                        *sides,
                        pa.array(likeness(a.sizes(), b.sizes(), apart)),
                        pa.array(np.full(len(part), cells)),
                        pa.array(~whole),
                    ],
                    [*(c.split()[0] for c in CHANGES.split(", ")), "failed"],
                )

    return subtract


def paragraph_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, place, digest, paragraph``: what the digests of ``changes`` stand for."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            digests, cut = Digests(texts), [paragraphs(t) for t in texts]
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, c in zip(ids, cut) for _ in c], pa.int64()),
                    pa.array([k for c in cut for k in range(len(c))], pa.int64()),
                    pa.array(digests.keys.view(np.int64)),
                    pa.array([p for c in cut for p in c], pa.string()),
                ],
                ["doc_id", "place", "digest", "paragraph"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(digest, "doc_id long, place long, digest long, paragraph string")

"""Quality classifier: ordinal regression with cumulative links on hashed text.

Grades order documents: 0 poor, 1 sound but unfit, 2 fit. One weight vector over
hashed text features is shared by all grades, and ordered thresholds cut the
line: ``P(grade <= k) = sigmoid(threshold_k - w . x)``. Expected grade and tail
probability of the top grade follow; documents are selected by the tail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Remembered, small_batches, words_of
from .quality_rules import labelled_sample

BUCKETS = 1 << 18
GRADES = 3
#: Labelled documents the weights are fitted on, at most.
SAMPLE = 8_000
#: A bucket needs so many documents of the sample to get a weight.
LEAST_DOCS = 4
#: Added to document shares before their ratio is taken.
SMOOTH = 2e-3
#: Share of held-out top-grade documents the threshold must keep.
KEEP_TOP = 0.995
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: Words whose buckets a task remembers in each of two generations.
REMEMBERED = 100_000


def grade(quality: Column, toxic: Column) -> Column:
    """0 for low quality, 1 for toxic text of good quality, 2 for the rest; null if unknown."""
    return F.when(quality == 0, 0).when(quality.isNull(), None).when(toxic > 0, 1).otherwise(2)


class Hashing:
    """Buckets of a text's words: the lower-cased word, its stems, ending and shape."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.known = Remembered(REMEMBERED)

    def of_word(self, word: bytes) -> tuple[int, ...]:
        bare = word.lower().strip(b".,;:!?*%$#&|\"'()")
        shape = (b"U" if word.isupper() and len(word) > 1 else b"l") + word[-1:]
        stems = [b"p" + bare[:n] for n in STEMS if n < len(bare)]
        parts = (b"w" + bare, b"e" + word[-3:], b"s" + shape, *stems)
        return tuple(crc32(part) % self.buckets for part in parts)

    def of_text(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets."""
        known, words = self.known, set(words_of(text))
        for word in known.missing(words):
            known[word] = self.of_word(word)
        found = set(chain.from_iterable(map(known.__getitem__, words)))
        return np.array(sorted(found), dtype=np.int64)


@lru_cache(maxsize=2)
def hashing_of(buckets: int) -> Hashing:
    """One per Python worker: its next tasks know the words of earlier ones."""
    return Hashing(buckets)


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return flat, lengths


def _dot(flat: np.ndarray, lengths: np.ndarray, weight: np.ndarray) -> np.ndarray:
    of_row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(of_row, weight[flat], len(lengths))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Ordinal:
    weight: np.ndarray
    cuts: np.ndarray
    least_tail: float = 0.5

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """``P(grade > k)`` for each row and cut ``k``."""
        score = _dot(*_csr(rows), self.weight)
        return _sigmoid(score[:, None] - self.cuts[None, :])


def fit(
    rows: list[np.ndarray], grades: np.ndarray, *, steps: int = 150, rate: float = 0.05, ridge: float = 1e-2
) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over the whole sample.

    A weight is a coefficient times the bucket's smoothed log ratio of document
    shares in and below the top grade, so the ridge bears on buckets that tell
    grades apart least. Thresholds are the first one and logs of their
    distances, so they stay ordered. The same sample gives the same weights.
    """
    flat, lengths = _csr(rows)
    of_row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    top = grades == GRADES - 1
    high = np.bincount(flat[top[of_row]], minlength=BUCKETS)
    docs = np.bincount(flat, minlength=BUCKETS)
    ratio = (high / max(top.sum(), 1) + SMOOTH) / ((docs - high) / max((~top).sum(), 1) + SMOOTH)
    scale = np.where(docs >= LEAST_DOCS, np.abs(np.log(ratio)), 0.0)
    used = docs[flat] >= LEAST_DOCS
    flat, of_row = flat[used].astype(np.int32), of_row[used]
    levels = GRADES - 1
    share = np.array([np.clip((grades <= k).mean(), 0.01, 0.99) for k in range(levels)])
    cuts = np.log(share / (1 - share))
    rest = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    w = np.zeros(BUCKETS)
    moments = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(levels), np.zeros(levels)]
    n = len(grades)
    rows_at = np.arange(n)
    for step in range(1, steps + 1):
        cuts = np.concatenate([rest[:1], rest[0] + np.cumsum(np.exp(rest[1:]))])
        score = np.bincount(of_row, (w * scale)[flat], n)
        below = np.concatenate(
            [np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1
        )
        upper, lower = below[rows_at, grades + 1], below[rows_at, grades]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        g_score = (du - dl) / p
        g_w = scale * np.bincount(flat, g_score[of_row], BUCKETS) / n + ridge * w
        g_cut = np.zeros(levels)
        for k in range(levels):
            g_cut[k] = ((np.where(grades == k + 1, dl, 0) - np.where(grades == k, du, 0)) / p).sum() / n
        g_rest = np.concatenate([[g_cut.sum()], np.exp(rest[1:]) * np.cumsum(g_cut[::-1])[::-1][1:]])
        for i, (value, g) in enumerate(((w, g_w), (rest, g_rest))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = np.concatenate([rest[:1], rest[0] + np.cumsum(np.exp(rest[1:]))])
    return Ordinal(w * scale, cuts)


def calibrated(
    rows: list[np.ndarray], grades: np.ndarray, *, keep_top: float = KEEP_TOP, folds: int = 5
) -> Ordinal | None:
    """A model whose tail limit keeps ``keep_top`` of the held-out top grade, and is 0.5 at most.

    None without two grades, however many documents there are; where those left
    after holding some out are of one grade, none is held out and the limit is 0.5.
    """
    if len(set(grades.tolist())) < 2:
        return None
    held = np.arange(len(grades)) % folds == 0
    if len(set(grades[~held].tolist())) < 2:
        held[:] = False
    model = fit([r for r, out in zip(rows, held) if not out], grades[~held])
    top = [r for r, out, g in zip(rows, held, grades) if out and g == GRADES - 1]
    if not top:
        return model
    return replace(model, least_tail=min(0.5, float(np.quantile(model.tails(top)[:, -1], 1 - keep_top))))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Ordinal | None:
    """Fit on at most ``sample`` documents of ``labels`` (``doc_id, quality, toxic``).

    The sample is chosen by a hash of the id. None without two grades.
    """
    small_batches(docs.sparkSession)
    graded = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rows = labelled_sample(docs, graded, "grade", sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = hashing_of(BUCKETS)
        for batch in batches:
            found = [hashing.of_text(x).astype(np.int32).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "grade": batch.column("label").cast(pa.int32()),
                    "buckets": pa.array(found, pa.binary()),
                }
            )

    got = rows.mapInArrow(measure, "doc_id long, grade int, buckets binary").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    found = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in got.column("buckets").to_pylist()]
    return calibrated(found, got.column("grade").to_numpy().astype(np.int64))


SCORED = "doc_id long, expected_grade double, tail_probability double, kept boolean"


def _shared(docs: DataFrame, model: Ordinal | None):
    """The weights reach each executor once; their size is fixed by BUCKETS."""
    if model is None:
        return None
    return docs.sparkSession.sparkContext.broadcast(
        (model.weight.astype(np.float32), model.cuts, model.least_tail)
    )


def _score(shared, hashing: Hashing, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if shared is None:
        ones = np.ones(len(texts))
        return ones * (GRADES - 1), ones, ones > 0
    model = Ordinal(*shared.value)
    tails = model.tails([hashing.of_text(x) for x in texts])
    return tails.sum(axis=1), tails[:, -1], tails[:, -1] >= model.least_tail


def scored(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """Expected grade, probability of the top grade and verdict of each document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts have no features and are judged by the thresholds alone; repeated
    rows score alike. Without a model every document is kept.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = hashing_of(BUCKETS)
        for batch in batches:
            expected, tail, kept = _score(shared, hashing, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "expected_grade": pa.array(expected),
                    "tail_probability": pa.array(tail),
                    "kept": pa.array(kept),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORED)


def accepted(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """The documents that ``scored`` keeps, with all their columns."""
    small_batches(docs.sparkSession)
    shared = _shared(docs, model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = hashing_of(BUCKETS)
        for batch in batches:
            yield batch.filter(pa.array(_score(shared, hashing, batch.column(place).to_pylist())[2]))

    return docs.mapInArrow(keep, docs.schema)

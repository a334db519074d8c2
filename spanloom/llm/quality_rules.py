"""Quality rules: base limits, then boosted trees over document statistics.

Statistics of whole texts feed a gradient-boosted classifier fitted on a bounded
sample of labelled documents. Its trees are complete binary trees in numpy node
arrays, so a batch of documents walks all trees by array indexing. Chosen
statistics are held monotonic: more symbols or repeats never raise a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Name and monotonic direction of each feature: -1 means more of it never raises the score.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbols_per_word", -1),
    ("dup_lines_share", -1),
    ("repeat_share", -1),
    ("upper_share", -1),
    ("digit_share", 0),
    ("shout_per_word", -1),
    ("marks_per_word", 0),
    ("distinct_share", 0),
    ("words_per_line", 0),
    ("non_ascii_share", 0),
)

#: Labelled documents the trees are fitted on, at most.
SAMPLE = 20_000
#: Share of held-out good documents the threshold must keep.
KEEP_GOOD = 0.998


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, all occurrences counted."""
    if len(words) <= window:
        return 0
    runs = list(zip(*(words[i:] for i in range(window))))
    if len(set(runs)) == len(runs):
        return 0
    often = Counter(runs)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.fromiter((often[r] > 1 for r in runs), dtype=bool, count=len(runs)).nonzero()[0]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of a text; null is an empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    points = len(data) - int(seen[0x80:0xC0].sum())
    spaces = int(seen[list(SPACES)].sum())
    symbols = int(seen[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    n, chars = len(words), points - spaces
    repeats = repeated_words(words)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    per_word, per_char = max(n, 1), max(chars, 1)
    features = [
        float(np.log1p(n)),
        chars / per_word,
        symbols / per_word,
        dup_lines / max(len(lines), 1),
        repeats / per_word,
        upper / max(upper + lower, 1),
        int(seen[48:58].sum()) / per_char,
        int(seen[33]) / per_word,
        int(seen[list(b".,;:?-")].sum()) / per_word,
        len(set(words)) / per_word,
        n / max(len(lines), 1),
        int(seen[0xC0:].sum()) / per_char,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray  # (trees, inner nodes)
    above: np.ndarray  # go right if the value is larger; infinite where a node isn't split
    leaf: np.ndarray  # (trees, leaves)
    start: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values of all rows, tree by tree, without a loop over rows."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    direction: np.ndarray,
    *,
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 2.0,
    least: float = 2.0,
) -> Trees:
    """Boost log loss on histograms; splits against a direction are not taken.

    Below a split on a monotonic feature both sides are bounded by the middle of
    the two values, so no deeper split can break the order.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    out_feature = np.zeros((trees, inner), dtype=np.int64)
    out_above = np.full((trees, inner), np.inf)
    out_leaf = np.zeros((trees, leaves))
    column = np.arange(width)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            flat = (((node - first)[:, None] * width + column) * bins + code).ravel()
            size = count * width * bins
            sums = [
                np.bincount(flat, np.repeat(v, width), size).reshape(count, width, bins) for v in (g, h)
            ]
            gl, hl = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            ga, ha = (s.sum(axis=2, keepdims=True) for s in sums)
            gr, hr = ga - gl, ha - hl
            bound = (low[:, None, None], high[:, None, None])
            left = np.clip(-gl / (hl + ridge), *bound)
            right = np.clip(-gr / (hr + ridge), *bound)
            gain = -(gl * left + (hl + ridge) * left**2 / 2) - (gr * right + (hr + ridge) * right**2 / 2)
            whole = np.clip(-ga / (ha + ridge), *bound)
            gain = gain + ga * whole + (ha + ridge) * whole**2 / 2
            allowed = (hl >= least) & (hr >= least) & (direction[None, :, None] * (right - left) >= 0)
            gain = np.where(allowed, gain, -np.inf).reshape(count, -1)
            best = gain.argmax(axis=1)
            new_low, new_high = np.repeat(low, 2), np.repeat(high, 2)
            for k in range(count):
                f, b = divmod(int(best[k]), bins - 1)
                if not gain[k, best[k]] > 1e-6 or b >= len(cuts[f]):
                    continue
                out_feature[t, first + k], out_above[t, first + k] = f, cuts[f][b]
                if direction[f]:
                    middle = (left[k, f, b] + right[k, f, b]) / 2
                    lower, upper = (2 * k, 2 * k + 1) if direction[f] > 0 else (2 * k + 1, 2 * k)
                    new_high[lower] = min(new_high[lower], middle)
                    new_low[upper] = max(new_low[upper], middle)
            low, high = new_low, new_high
            chosen = out_feature[t][node]
            node = 2 * node + 1 + (x[np.arange(n), chosen] > out_above[t][node])
        place = node - inner
        value = np.clip(
            -np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + ridge), low, high
        )
        out_leaf[t] = rate * value
        margin += out_leaf[t][place]
    return Trees(out_feature, out_above, out_leaf, start, 0.0)


def fitted(
    x: np.ndarray, y: np.ndarray, *, keep_good: float = KEEP_GOOD, folds: int = 5
) -> Trees | None:
    """Trees whose threshold keeps ``keep_good`` of the good documents held out.

    The threshold is never above even odds. None without documents of both kinds,
    however many there are; where those left after holding some out are of one
    kind, none is held out and the threshold is even odds.
    """
    if not len(y) or y.min() == y.max():
        return None
    direction = np.array([d for _, d in FEATURES])
    held = np.arange(len(y)) % folds == 0
    if held.all() or y[~held].min() == y[~held].max():
        held[:] = False
    trees = fit_trees(x[~held], y[~held], direction)
    good = trees.probability(x[held & (y == 1)])
    edge = float(np.quantile(good, 1 - keep_good)) if len(good) else 0.5
    return Trees(trees.feature, trees.above, trees.leaf, trees.start, min(0.5, edge))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents, by a hash of the id.

    Labels that are null are left out and of several the largest counts. The
    sample's ids are few enough to broadcast: ``most`` is the proven bound. Of rows
    that repeat an id the text with the least hash counts, so rows are bounded, too.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("_hash"), "text")).alias("_one")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "_one.text", "label")


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Trees | None:
    """Fit on the statistics of at most ``sample`` documents of ``labels`` (``doc_id, quality``)."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [statistics(x)[1] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "label": batch.column("label").cast(pa.float64()),
                    "features": pa.array(features, pa.list_(pa.float64())),
                }
            )

    got = rows.mapInArrow(measure, "doc_id long, label double, features array<double>").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    x = np.array(got.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fitted(x, (got.column("label").to_numpy() > 0).astype(float))


def verdicts(texts: list[str | None], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base failures, scores and verdicts of a batch."""
    both = [statistics(x) for x in texts]
    counts = np.array([c for c, _ in both], dtype=np.int64).reshape(-1, len(COUNTS))
    failed = np.fromiter((base_failed(c[0], c[4]) for c, _ in both), dtype=bool, count=len(both))
    if trees is None:
        return counts, failed, np.ones(len(both)), ~failed
    x = np.array([f for _, f in both], dtype=float).reshape(-1, len(FEATURES))
    score = trees.probability(x)
    return counts, failed, score, ~failed & (score >= trees.threshold)


JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, score double, kept boolean"
)


def judged(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row per document: counts, ``base_failed``, the trees' ``score`` and ``kept``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null or
    empty text has no words and fails the base rules; repeated rows are judged
    alike; null ids are kept. Without trees the base rules decide alone. A text
    is judged whole inside its batch; nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score, kept = verdicts(batch.column("text").to_pylist(), trees)
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {name: pa.array(counts[:, i]) for i, name in enumerate(COUNTS)}
            columns |= {"base_failed": pa.array(failed), "score": pa.array(score), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, JUDGED)


def accepted(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(place).to_pylist(), trees)[3]))

    return docs.mapInArrow(keep, docs.schema)

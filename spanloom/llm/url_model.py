"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides teach two variable-order Markov models, one of accepted
and one of rejected URLs. Contexts of up to three characters are smoothed into
shorter ones by Witten-Bell weights. A URL without a rule is judged by the
difference of the two log-likelihoods per character against a limit calibrated
on URLs held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, small_batches

#: Host, path prefix and verdict; the longest that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Characters a model tells apart, lower-cased; all others are one more. 0 is the border.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&#%:"
SYMBOLS = len(ALPHABET) + 2
ORDER = 3
#: One of so many labelled URLs is held out to calibrate.
FOLDS = 5
#: Share of held-out accepted URLs that the limit must keep.
KEEP_ACCEPTED = 0.99
#: Scores are counted in so many bins to find the limit.
BINS = 2048
SPAN = 8.0


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.

    A rule fits its host, all subdomains, and paths that begin with its own.
    """
    ordered = sorted(rules, key=lambda r: len(r[0] + r[1]))

    def fits(rule) -> Column:
        name, start, _ = rule
        return ((host == name) | host.endswith("." + name)) & path.startswith(start)

    def longest(value) -> Column:
        return reduce(
            lambda found, rule: F.when(fits(rule), F.lit(value(rule))).otherwise(found),
            ordered,
            F.lit(None).cast("string"),
        )

    return longest(lambda r: r[0] + r[1]), longest(lambda r: r[2])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each character with its ``ORDER`` predecessors, and the URL it is in."""
    texts = [t or "" for t in texts]
    table = {c: i + 1 for i, c in enumerate(ALPHABET)}
    rows, owner = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        line = np.array([0] * ORDER + [table.get(c, SYMBOLS - 1) for c in map(str.lower, text)], dtype=np.int64)
        number = np.zeros(len(text), dtype=np.int64)
        for k in range(ORDER + 1):
            number = number * SYMBOLS + line[k : k + len(text)]
        rows.append(number)
        owner.append(np.full(len(text), i))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([*rows, empty]), np.concatenate([*owner, empty])


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the last character after each context, all orders mixed.

    ``counts`` has one axis per character. Witten-Bell: a context seen ``n``
    times with ``t`` different characters gives ``t / (n + t)`` of its weight to
    the context without its first character, the empty one to equal odds.
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS, dtype=np.float32)
    for order in range(ORDER + 1):
        own = counts.sum(axis=tuple(range(ORDER - order))) if order < ORDER else counts
        n = own.sum(axis=-1, keepdims=True)
        t = (own > 0).sum(axis=-1, keepdims=True, dtype=np.float32)
        p = np.where(n > 0, (own + t * p) / np.maximum(n + t, 1), p)
    return np.log(p)


@dataclass(frozen=True)
class UrlModel:
    """Log ratio of each character in context, and the limit a URL's mean must reach."""

    ratio: np.ndarray
    limit: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Mean log ratio per character; 0 for null and empty URLs."""
        number, owner = grams(texts)
        total = np.bincount(owner, self.ratio[number], len(texts))
        return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


GRAMS = "gram int, accepted boolean, held boolean, n long"


def _counts(labelled: DataFrame) -> pa.Table:
    """Counts of each gram among accepted and rejected URLs, inside and outside the held fold.

    Tasks count first, Spark adds up. The rows that reach the driver are bounded
    by the alphabet: at most ``4 * SYMBOLS ** (ORDER + 1)`` whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            number, owner = grams(batch.column("url").to_pylist())
            kind = 2 * np.array(batch.column("accepted").to_pylist(), dtype=np.int64)
            kind += np.array(batch.column("held").to_pylist(), dtype=np.int64)
            found, n = np.unique(number * 4 + kind[owner], return_counts=True)
            seen.update(dict(zip(found.tolist(), n.tolist())))
        if seen:
            key = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((key // 4).astype(np.int32)),
                    pa.array(key % 4 >= 2),
                    pa.array(key % 2 == 1),
                    pa.array(np.fromiter(seen.values(), dtype=np.int64, count=len(seen))),
                ],
                ["gram", "accepted", "held", "n"],
            )

    made = labelled.select("url", "accepted", "held").mapInArrow(count, GRAMS)
    return made.groupBy("gram", "accepted", "held").agg(F.sum("n").alias("n")).toArrow()


def _ratio(counts: pa.Table, *, held: bool) -> np.ndarray:
    """Log ratios from the counts, with or without the held fold."""
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    accepted = counts.column("accepted").to_numpy(zero_copy_only=False)
    used = np.full(len(gram), True) if held else ~counts.column("held").to_numpy(zero_copy_only=False)
    logs = []
    for kind in (True, False):
        chosen = used & (accepted == kind)
        full = np.zeros(SYMBOLS ** (ORDER + 1), dtype=np.float32)
        np.add.at(full, gram[chosen], n[chosen])
        logs.append(smoothed(full.reshape((SYMBOLS,) * (ORDER + 1))).ravel())
    return logs[0] - logs[1]


def _limit(held: DataFrame, ratio: np.ndarray, keep: float) -> float:
    """The largest limit that keeps ``keep`` of the held accepted URLs, 0 at most."""
    shared = held.sparkSession.sparkContext.broadcast(ratio)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            score = UrlModel(shared.value).scores(batch.column("url").to_pylist())
            at = np.clip((score + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)
            seen += np.bincount(at, minlength=BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["bin", "n"])

    made = held.where("accepted").select("url").mapInArrow(bins, "bin int, n long")
    got = made.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most BINS rows
    full = np.zeros(BINS, dtype=np.int64)
    full[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    if not full.sum():
        return 0.0
    lost = np.concatenate([[0], np.cumsum(full)]) / full.sum()
    edge = int(np.flatnonzero(lost <= 1 - keep)[-1])
    return min(0.0, edge / BINS * 2 * SPAN - SPAN)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, url, host, path, rule, ruled``: parts of the URL and what the rules say."""
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled"))


def train(ruled: DataFrame, *, keep: float = KEEP_ACCEPTED) -> UrlModel | None:
    """Models from the URLs that rules decide; None without both kinds.

    The fold held out is chosen by a hash of the URL. The limit is found with
    models that have not seen the fold; the models returned have.
    """
    small_batches(ruled.sparkSession)
    labelled = ruled.where("ruled is not null and url is not null").select(
        "url",
        (F.col("ruled") == "allow").alias("accepted"),
        (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("held"),
    )
    counts = _counts(labelled)
    if len(set(counts.column("accepted").to_pylist())) < 2:
        return None
    limit = _limit(labelled.where("held"), _ratio(counts, held=False), keep)
    return UrlModel(_ratio(counts, held=True), limit)


JUDGED = "page_id long, host string, path string, rule string, score double, verdict string"


def judged(ruled: DataFrame, model: UrlModel | None) -> DataFrame:
    """One row per page: ``host``, ``path``, ``rule``, the models' ``score`` and ``verdict``.

    A rule's verdict holds where there is one. Without a rule a URL is allowed if
    its score reaches the limit; null and empty URLs score 0, which does; without
    a model all are allowed. Repeated rows are judged alike; a null id stays.
    """
    spark = ruled.sparkSession
    small_batches(spark)
    # of fixed size: SYMBOLS ** (ORDER + 1) numbers
    shared = spark.sparkContext.broadcast(None if model is None else (model.ratio, model.limit))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, said = batch.column("url").to_pylist(), batch.column("ruled").to_pylist()
            score, limit = np.zeros(len(urls)), 0.0
            if shared.value is not None:
                score, limit = UrlModel(*shared.value).scores(urls), shared.value[1]
            verdict = [x or ("allow" if s >= limit else "block") for x, s in zip(said, score)]
            kept = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(score), pa.array(verdict)], ["page_id", "host", "path", "rule", "score", "verdict"]
            )

    page = F.col("page_id").cast("long").alias("page_id")
    return ruled.select(page, "url", "host", "path", "rule", "ruled").mapInArrow(judge, JUDGED)


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rules, models and verdicts over ``pages`` (``page_id, url``; other columns are ignored)."""
    ruled = with_rules(pages, rules)
    return judged(ruled, train(ruled))

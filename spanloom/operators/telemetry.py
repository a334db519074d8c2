"""Resource telemetry: resampling, alignment, aggregates and interval joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .ordered import fill_forward, percentiles, with_previous
from .stacks import _runs
from .storage import written

METRICS = ("cpu", "mem", "disk")

RESOURCE_FEATURES = (
    "cpu_mean",
    "cpu_std",
    "cpu_max",
    "memory_growth",
    "memory_mean",
    "memory_volatility",
    "io_intensity",
    "io_burstiness",
    "io_peak",
)


def bucket(ts: Column, width: int) -> Column:
    """Start of the fixed-width bucket an integer time falls in."""
    return ts - F.pmod(ts, F.lit(width))


def without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def select_metrics(series: DataFrame, keywords: list[str], column: str = "metric") -> DataFrame:
    """Keep series whose name contains any keyword, ignoring case."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(F.lower(column), F.lit(word.lower()))
    return series.where(hit)


def resample(series: DataFrame, by: list[str], width: int, values: list[str]) -> DataFrame:
    """Mean of each value per group and fixed-width time bucket."""
    return series.groupBy(*by, bucket(F.col("ts"), width).alias("ts")).agg(
        *[F.avg(without_nan(F.col(v))).alias(v) for v in values]
    )


def combine_series(
    long_series: DataFrame,
    by: list[str],
    width: int,
    *,
    metrics: tuple[str, ...] = METRICS,
    carry: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Rows ``(ts, metric, value)`` to one row per bucket with a column per metric.

    ``carry`` fills a gap with the last earlier value of the same metric.
    """
    wide = (
        long_series.groupBy(*by, bucket(F.col("ts"), width).alias("ts"))
        .pivot("metric", list(metrics))
        .agg(F.avg(without_nan(F.col("value"))))
    )
    if not carry:
        return wide
    return fill_forward(wide, by, ["ts"], metrics, slices=slices)


def telemetry_aggregates(
    series: DataFrame,
    by: list[str],
    *,
    metrics: tuple[str, ...] = METRICS,
    slices: int | None = None,
) -> DataFrame:
    """Peak, average and exact median of the positive samples; -1 without any."""
    names = F.array(*[F.lit(m) for m in metrics])
    values = F.array(*[F.col(m) for m in metrics])
    samples = series.select(*by, F.inline(F.arrays_zip(names.alias("metric"), values.alias("value"))))
    positive = samples.withColumn(
        "value", F.when(~F.isnan("value") & (F.col("value") > 0), F.col("value"))
    )
    keys = [*by, "metric"]
    basic = positive.groupBy(*keys).agg(F.max("value").alias("peak"), F.avg("value").alias("average"))
    middle = percentiles(positive, keys, "value", {"median": 0.5}, slices=slices)
    return basic.join(middle, keys, "left").select(
        *keys, *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("peak", "average", "median")]
    )


def trace_span(series: DataFrame, by: list[str]) -> DataFrame:
    return series.groupBy(*by).agg(
        F.min("ts").alias("trace_start_ns"), F.max("ts").alias("trace_end_ns")
    )


def _spans(series: DataFrame, run: list[str], width: int) -> DataFrame:
    """First and last leaf of each run's samples, and the levels above them.

    A leaf is a stretch of ``width``; a node of level ``l`` covers ``2**l`` leaves.
    """
    leaf = F.floor(F.col("ts") / F.lit(width)).cast("long")
    spans = series.select(*run, leaf.alias("_leaf"))
    ends = spans.groupBy(*run).agg(F.min("_leaf").alias("_low"), F.max("_leaf").alias("_high"))
    return ends.withColumn("_levels", F.length(F.bin(F.col("_high") - F.col("_low") + 1)))


_NODES = "array<struct<level:int,bin:bigint>>"


def _cover(first: Column, last: Column, levels: Column) -> Column:
    """The fewest nodes that cover the leaves ``first..last``: two a level at most."""
    none = F.array().cast(_NODES)

    def node(taken: Column, level: Column, number: Column) -> Column:
        here = F.struct(level.cast("int").alias("level"), number.cast("long").alias("bin"))
        return F.when(taken, F.array(here)).otherwise(none)

    def climb(acc: Column, level: Column) -> Column:
        low, high = acc["low"], acc["high"]
        left = (low < high) & (F.pmod(low, F.lit(2)) == 1)
        right = (low < high) & (F.pmod(high, F.lit(2)) == 1)
        return F.struct(
            F.shiftright(low + left.cast("long"), 1).alias("low"),
            F.shiftright(high - right.cast("long"), 1).alias("high"),
            F.concat(acc["nodes"], node(left, level, low), node(right, level, high - 1)).alias("nodes"),
        )

    start = F.struct(first.alias("low"), (last + 1).alias("high"), none.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), levels), start, climb)["nodes"]


def _pieces(
    intervals: DataFrame, spans: DataFrame, run: list[str], width: int, start: str, end: str
) -> DataFrame:
    """``intervals`` with ``_edges``, the leaves they begin and end in, and ``_inner``, nodes in between.

    Intervals are clipped to their run's samples, so neither holds more than two
    entries a level of the run.
    """
    low, high = (F.floor(F.col(c) / F.lit(width)).cast("long") for c in (start, end))
    joined = intervals.where(F.col(start) <= F.col(end)).join(
        spans.select(*run, "_low", "_high", "_levels"), run
    )
    placed = joined.withColumn("_from", low).withColumn("_to", high)
    first = F.greatest(F.col("_from") + 1, F.col("_low"))
    last = F.least(F.col("_to") - 1, F.col("_high"))
    inner = F.when(first <= last, _cover(first, last, F.col("_levels"))).otherwise(F.array().cast(_NODES))
    edges = F.array_distinct(F.array("_from", "_to"))
    return placed.withColumn("_inner", inner).withColumn("_edges", edges).drop("_low", "_high", "_levels", "_from", "_to")


def interval_join(
    intervals: DataFrame,
    series: DataFrame,
    run: list[str],
    *,
    width: int,
    start: str = "start_ns",
    end: str = "end_ns",
) -> DataFrame:
    """Samples with ``start <= ts <= end`` in the interval's run.

    An interval is cut into dyadic stretches of its run's time, two a level at
    most, and meets the samples of each there: a long run spreads over many tasks
    and a long interval over few rows.
    """
    spans = _spans(series.select(*run, "ts"), run, width)
    edge = F.transform("_edges", lambda b: F.struct(F.lit(0).alias("level"), b.alias("bin")))
    cut = _pieces(intervals, spans, run, width, start, end)
    cut = cut.withColumn("_node", F.explode(F.concat(edge, F.col("_inner")))).drop("_edges", "_inner")
    cut = cut.select("*", F.col("_node.level").alias("_level"), F.col("_node.bin").alias("_bin")).drop("_node")
    leaf = F.floor(F.col("ts") / F.lit(width)).cast("long")
    placed = series.join(spans.select(*run, "_levels"), run)
    placed = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), "_levels"))).drop("_levels")
    placed = placed.withColumn("_bin", F.call_function("shiftright", leaf, F.col("_level")))
    return (
        cut.join(placed, [*run, "_level", "_bin"])
        .where((F.col("ts") >= F.col(start)) & (F.col("ts") <= F.col(end)))
        .drop("_level", "_bin")
    )


#: What a stretch of samples is folded to. Three values have a count, a mean and the sum
#: of squares about that mean; steps are those whose sample before is in the stretch.
_SPREAD = ("cpu", "disk", "step")
_STATE = (
    "samples", "mem_n", "mem_sum", "cpu_max", "disk_max", "mem_first", "mem_last", "first", "last",
    *(f"{value}_{part}" for value in _SPREAD for part in ("n", "mean", "square")),
)


def _sample_states(stepped: DataFrame, run: list[str]) -> DataFrame:
    """Each sample as the state of a stretch of its own."""
    cpu, disk, mem = (without_nan(F.col(c)) for c in ("cpu", "disk", "mem"))
    step = mem - without_nan(F.col("_before.mem"))
    timed = F.when(mem.isNotNull(), F.struct(F.col("ts").alias("ts"), mem.alias("mem")))
    none = F.lit(None).cast("double")
    single = []
    for name, value in (("cpu", cpu), ("disk", disk), ("step", none)):
        known = value.isNotNull()
        square = F.when(known, F.lit(0.0)).alias(f"{name}_square")
        single += [known.cast("long").alias(f"{name}_n"), value.alias(f"{name}_mean"), square]
    return stepped.select(
        *run,
        "ts",
        F.lit(1).cast("long").alias("samples"),
        mem.isNotNull().cast("long").alias("mem_n"),
        mem.alias("mem_sum"),
        cpu.alias("cpu_max"),
        disk.alias("disk_max"),
        timed.alias("mem_first"),
        timed.alias("mem_last"),
        F.struct(F.col("ts").alias("ts"), F.col("_before.ts").alias("before"), step.alias("step"), mem.alias("mem")).alias("first"),
        F.struct(F.col("ts").alias("ts"), mem.alias("mem")).alias("last"),
        *single,
    )


def _plain() -> list[Column]:
    """The parts of a state that merge in one pass."""
    return [
        *[F.sum(c).alias(c) for c in ("samples", "mem_n", "mem_sum")],
        *[F.max(c).alias(c) for c in ("cpu_max", "disk_max", "mem_last", "last")],
        *[F.min(c).alias(c) for c in ("mem_first", "first")],
    ]


def _joined_step(bound: Column | None) -> Column:
    """The step to a stretch's first sample, if the sample before lies behind ``bound``, too."""
    step = F.col("first.step")
    return step if bound is None else F.when(F.col("first.before") >= bound, step)


def _merged(states: DataFrame, by: list[str], bound: Column | None) -> DataFrame:
    """One state per group of states that follow each other from ``bound`` on.

    Means are merged first and come back to the states of their group, so squares
    are taken about the group's own mean: differences of large sums would lose the
    digits of small spreads. The step to a state's first sample is a value more if
    the sample before it is inside the merged stretch.
    """
    states = states.withColumn("_joined", _joined_step(bound))
    joined = F.col("_joined").isNotNull().cast("long")

    def weighted(name: str) -> tuple[Column, Column]:
        n, mean = F.col(f"{name}_n"), F.coalesce(F.col(f"{name}_mean"), F.lit(0.0))
        if name != "step":
            return F.sum(n), F.sum(n * mean)
        return F.sum(n + joined), F.sum(n * mean + F.coalesce("_joined", F.lit(0.0)))

    means = []
    for name in _SPREAD:
        n, total = weighted(name)
        means.append(F.when(n > 0, total / n).alias(f"_mean_{name}"))
    # One struct as key: equal structs hold nulls in the same places, and join and
    # both sums share one shuffle.
    states = states.select(F.struct(*by).alias("_key"), *[c for c in states.columns if c not in by])
    back = states.groupBy("_key").agg(*means)
    spread = []
    for name in _SPREAD:
        n, mean, square = (F.col(f"{name}_{part}") for part in ("n", "mean", "square"))
        off = mean - F.col(f"_mean_{name}")
        apart = F.when(n > 0, square + n * off * off).otherwise(F.lit(0.0))
        if name == "step":
            own = F.col("_joined") - F.col("_mean_step")
            apart = apart + F.coalesce(own * own, F.lit(0.0))
        spread += [weighted(name)[0].alias(f"{name}_n"), F.max(f"_mean_{name}").alias(f"{name}_mean"), F.sum(apart).alias(f"{name}_square")]
    merged = states.join(back, "_key").groupBy("_key").agg(*_plain(), *spread)
    return merged.select(*[F.col("_key").getField(k).alias(k) for k in by], *[c for c in merged.columns if c != "_key"])


#: Points (samples and both ends of intervals) a task folds at a time: bounds its memory.
BLOCK = 1 << 17
#: Blocks of a partition are numbered from its number times this.
BLOCKS = 1 << 20
#: Levels of nodes over numbers of blocks.
LEVELS = 40

START, SAMPLE, END = range(3)
INSIDE, OPENED, CLOSED, PART = range(4)

# What a block says of an interval or run; all values of a state are plain columns.
_FOUND = T.StructType(
    [T.StructField("_sort", T.IntegerType()), T.StructField("_id", T.LongType()), T.StructField("_bin", T.LongType()), T.StructField("_alone", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("samples", "cpu_n", "disk_n", "mem_n", "step_n", "first_ts", "last_ts", "mem_first_ts", "mem_last_ts")]
    + [T.StructField(n, T.DoubleType()) for n in ("cpu_mean", "cpu_square", "cpu_max", "disk_mean", "disk_square", "disk_max")]
    + [T.StructField(n, T.DoubleType()) for n in ("mem_sum", "mem_first", "mem_last", "first_mem", "last_mem", "step_mean", "step_square")]
)


def _merged_levels(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Count, sum, squares about the mean and maximum of two stretches as one."""
    n = a[0] + b[0]
    off = b[1] * a[0] - a[1] * b[0]
    apart = np.divide(off * off, a[0] * b[0] * n, out=np.zeros_like(off), where=a[0] * b[0] > 0)
    return [n, a[1] + b[1], a[2] + b[2] + apart, np.fmax(a[3], b[3])]


def _folded(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Count, sum, squares about the mean and maximum of ``values[:, low:high]``, NaN left out.

    Stretches are halves of stretches above them; a range takes two a level at most.
    """
    known = ~np.isnan(values)
    level = [known.astype(float), np.where(known, values, 0.0), np.zeros(values.shape), values]
    out = [np.zeros((len(values), len(low))) for _ in range(3)] + [np.full((len(values), len(low)), np.nan)]
    low, high = low.copy(), high.copy()
    ahead = np.flatnonzero(low < high)

    def take(rows: np.ndarray, at: np.ndarray) -> None:
        for part, merged in zip(out, _merged_levels([o[:, rows] for o in out], [v[:, at] for v in level])):
            part[:, rows] = merged

    while len(ahead):
        odd = ahead[low[ahead] % 2 == 1]
        take(odd, low[odd])
        low[odd] += 1
        odd = ahead[(low[ahead] < high[ahead]) & (high[ahead] % 2 == 1)]
        high[odd] -= 1
        take(odd, high[odd])
        low[ahead] >>= 1
        high[ahead] >>= 1
        ahead = ahead[low[ahead] < high[ahead]]
        if len(ahead):
            pairs = level[0].shape[1] // 2 * 2
            level = _merged_levels([v[:, 0:pairs:2] for v in level], [v[:, 1:pairs:2] for v in level])
    return out


def _fold_block(points: pa.Table, run: list[str], number: int) -> pa.RecordBatch:
    """States of the intervals and runs of one block of sorted points."""

    def values(name: str) -> np.ndarray:
        return points[name].combine_chunks().to_numpy(zero_copy_only=False)

    seg = _runs(points, run)
    kind, ids, at = (values(n) for n in ("_kind", "_id", "_at"))
    sample = kind == SAMPLE
    upto = np.concatenate([[0], np.cumsum(sample)])
    starts, ends = np.flatnonzero(kind == START), np.flatnonzero(kind == END)
    _, both, closing = np.intersect1d(ids[starts], ids[ends], assume_unique=True, return_indices=True)
    opened, closed = np.delete(starts, both), np.delete(ends, closing)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    behind = np.r_[first[1:], len(seg)]
    some = upto[behind] > upto[first]
    # an interval that ends later goes on to the end of the block, one that began earlier from its beginning
    rows = np.concatenate([ends[closing], opened, closed, first[some]])
    low = upto[np.concatenate([starts[both], opened, np.zeros(len(closed), int), first[some]])]
    high = np.concatenate([upto[ends[closing]], np.full(len(opened), upto[-1]), upto[closed], upto[behind[some]]])
    sort = np.repeat([INSIDE, OPENED, CLOSED, PART], [len(closing), len(opened), len(closed), some.sum()])
    kept = (low < high) | (sort == OPENED) | (sort == CLOSED)
    rows, low, high, sort = rows[kept], low[kept], high[kept], sort[kept]

    at, seg = at[sample], seg[sample]
    cpu, mem, disk = (values(n)[sample].astype(float) for n in METRICS)
    step = np.full(len(mem), np.nan)
    step[1:] = np.where(seg[1:] == seg[:-1], mem[1:] - mem[:-1], np.nan)
    n, total, square, most = _folded(np.stack([cpu, mem, disk]), low, high)
    steps, climbed, apart, _ = (v[0] for v in _folded(step[None], np.minimum(low + 1, high), high))

    def mean(count: np.ndarray, added: np.ndarray) -> np.ndarray:
        return np.divide(added, count, out=np.full(len(count), np.nan), where=count > 0)

    known = np.flatnonzero(~np.isnan(mem))
    held = low < high
    ahead, back = np.searchsorted(known, low), np.searchsorted(known, high) - 1
    timed = ahead <= back

    def picked(column: np.ndarray, places: np.ndarray, where: np.ndarray) -> pa.Array:
        out = np.zeros(len(where), column.dtype)
        out[where] = column[places[where]]
        nan = np.isnan(out) if out.dtype.kind == "f" else False
        return pa.array(out, mask=~where | nan)

    # places beyond an empty range are never read
    known = np.r_[known, 0]
    lead, last = known[np.minimum(ahead, len(known) - 1)], known[back]
    got = {
        "_sort": sort.astype(np.int32),
        "_id": pa.array(ids[rows], mask=sort == PART),
        "_bin": np.full(len(rows), number),
        "_alone": np.full(len(rows), len(first) == 1),
        "samples": high - low,
        **{f"{name}_n": n[i].astype(np.int64) for i, name in enumerate(METRICS)},
        "step_n": steps.astype(np.int64),
        "first_ts": picked(at, low, held),
        "last_ts": picked(at, high - 1, held),
        "mem_first_ts": picked(at, lead, timed),
        "mem_last_ts": picked(at, last, timed),
        "mem_sum": np.where(n[1] > 0, total[1], np.nan),
        "mem_first": picked(mem, lead, timed),
        "mem_last": picked(mem, last, timed),
        "first_mem": picked(mem, low, held),
        "last_mem": picked(mem, high - 1, held),
        "step_mean": mean(steps, climbed),
        "step_square": apart,
    }
    for i, name in ((0, "cpu"), (2, "disk")):
        got |= {f"{name}_mean": mean(n[i], total[i]), f"{name}_square": square[i], f"{name}_max": most[i]}
    columns = [points[name].combine_chunks().take(pa.array(rows)) for name in run]
    for name in _FOUND.names:
        column = got[name]
        columns.append(column if isinstance(column, pa.Array) else pa.array(column, from_pandas=True))
    return pa.RecordBatch.from_arrays(columns, [*run, *_FOUND.names])


def _folds(series: DataFrame, asked: DataFrame, run: list[str], slices: int | None, block: int) -> DataFrame:
    """What blocks of points say of the intervals ``asked`` and of all runs.

    Samples and both ends of all intervals are dealt once by range of run and time.
    An interval that begins and ends in one block is finished there; of the others
    each end leaves what its block holds of them, and the blocks between follow
    from the states of runs, one per block.
    """
    blank = [F.lit(None).cast("double").alias(m) for m in METRICS]
    known = reduce(and_, [F.col(c).isNotNull() for c in run])

    def ends(column: str, kind: int) -> DataFrame:
        held = asked.where(known & (F.col("_start") <= F.col("_end")))
        return held.select(*run, F.col(column).cast("long").alias("_at"), F.lit(kind).alias("_kind"), "_id", *blank)

    samples = series.where(known & F.col("ts").isNotNull()).select(
        *run, F.col("ts").cast("long").alias("_at"), F.lit(SAMPLE).alias("_kind"), F.lit(-1).cast("long").alias("_id"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
    )
    points = samples.unionByName(ends("_start", START)).unionByName(ends("_end", END))
    order = [*run, "_at", "_kind"]
    dealt = points.repartitionByRange(*order) if slices is None else points.repartitionByRange(slices, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, waiting = TaskContext.get().partitionId() * BLOCKS, 0, []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held == block:
                    yield _fold_block(pa.Table.from_batches(waiting), run, number)
                    number, held, waiting = number + 1, 0, []
        if held:
            yield _fold_block(pa.Table.from_batches(waiting), run, number)

    schema = T.StructType([*points.select(*run).schema.fields, *_FOUND.fields])
    return dealt.sortWithinPartitions(*order).mapInArrow(fold, schema)


def _states(found: DataFrame, *keys: str) -> DataFrame:
    """States of ``_folds``, as ``_merged`` takes them."""
    timed = [
        F.when(F.col("mem_n") > 0, F.struct(F.col(f"{name}_ts").alias("ts"), F.col(name).alias("mem"))).alias(name)
        for name in ("mem_first", "mem_last")
    ]
    unknown = [F.lit(None).cast(kind).alias(name) for name, kind in (("before", "long"), ("step", "double"))]
    first = F.struct(F.col("first_ts").alias("ts"), *unknown, F.col("first_mem").alias("mem")).alias("first")
    last = F.struct(F.col("last_ts").alias("ts"), F.col("last_mem").alias("mem")).alias("last")
    whole = found.select(*keys, *[c for c in _STATE if c not in ("mem_first", "mem_last", "first", "last")], *timed, first, last)
    return whole.select(*keys, *_STATE)


def _following(states: DataFrame, by: list[str], order: str) -> DataFrame:
    """``states`` with the steps to their first samples from the states before them."""
    before = F.lag("last").over(Window.partitionBy(*by).orderBy(order))
    step = F.col("first.mem") - before["mem"]
    first = F.struct(F.col("first.ts").alias("ts"), before["ts"].alias("before"), step.alias("step"), F.col("first.mem").alias("mem"))
    return states.withColumn("first", first)


def _node_states(parts: DataFrame, run: list[str]) -> DataFrame:
    """States of dyadic stretches of blocks, from those of blocks that hold nothing but their run."""
    above = parts.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    above = above.withColumn("_node", F.call_function("shiftright", F.col("_bin"), F.col("_level")))
    by = [*run, "_level", "_node"]
    return _merged(_following(above, by, "_bin"), by, None)


@dataclass
class FoldedTelemetry:
    """Samples of runs folded once, with the intervals ``asked``: ``_id``, ``_start`` and ``_end``."""

    series: DataFrame
    run: list[str]
    width: int
    slices: int | None = None
    asked: DataFrame | None = None
    block: int = BLOCK

    @cached_property
    def samples(self) -> DataFrame:
        """Each sample as the state of a stretch of its own."""
        series = self.series.select(*self.run, "ts", *METRICS)
        stepped = with_previous(series, self.run, ["ts"], ["ts", "mem"], "_before", slices=self.slices)
        return _sample_states(stepped, self.run)

    @cached_property
    def folds(self) -> DataFrame:
        return written(_folds(self.series, self.asked, self.run, self.slices, self.block), "folds")

    @cached_property
    def whole(self) -> DataFrame:
        """The features of each run."""
        parts = _states(self.folds.where(F.col("_sort") == PART), *self.run, "_bin")
        merged = _merged(_following(parts, self.run, "_bin"), self.run, None)
        return merged.select(*self.run, *_features())

    @cached_property
    def inside(self) -> DataFrame:
        """States of the intervals that hold samples, by ``_id``."""
        folds, run = self.folds, self.run
        done = _states(folds.where(F.col("_sort") == INSIDE), "_id")
        parts = folds.where((F.col("_sort") == PART) & F.col("_alone"))
        nodes = _node_states(_states(parts, *run, "_bin"), run)
        sides = folds.where(F.col("_sort").isin(OPENED, CLOSED))
        bins = [F.max(F.when(F.col("_sort") == sort, F.col("_bin"))).alias(name) for sort, name in ((OPENED, "_from"), (CLOSED, "_to"))]
        between = sides.groupBy(*run, "_id").agg(*bins).where(F.col("_from") + 1 < F.col("_to"))
        cover = _cover(F.col("_from") + 1, F.col("_to") - 1, F.lit(LEVELS))
        met = between.select(*run, "_id", F.inline(cover).alias("_level", "_node")).join(nodes, [*run, "_level", "_node"])
        place = F.call_function("shiftleft", F.col("_node"), F.col("_level")).alias("_bin")
        edges = _states(sides.where("samples > 0"), "_id", "_bin")
        pieces = edges.unionByName(met.select("_id", place, *_STATE))
        crossing = _merged(_following(pieces, ["_id"], "_bin"), ["_id"], None)
        return done.select("_id", *_features()).unionByName(crossing.select("_id", *_features()))


def samples_or_run(
    intervals: DataFrame,
    series: DataFrame,
    run: list[str],
    key: list[str],
    *,
    width: int,
    start: str = "start_ns",
    end: str = "end_ns",
) -> DataFrame:
    """Number of samples each interval uses, and whether it fell back to its run.

    An interval that catches no sample uses all samples of its run. Samples are
    counted per node; an interval adds up its nodes and the samples of its edges.
    """
    spans = _spans(series.select(*run, "ts"), run, width)
    leaf = F.floor(F.col("ts") / F.lit(width)).cast("long")
    placed = series.select(*run, "ts", leaf.alias("_bin"))
    leaves = placed.groupBy(*run, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    nodes = (
        leaves.join(spans.select(*run, "_levels"), run)
        .withColumn("_level", F.explode(F.sequence(F.lit(0), "_levels")))
        .groupBy(*run, "_level", F.call_function("shiftright", F.col("_bin"), F.col("_level")).alias("_bin"))
        .agg(F.sum("_n").alias("_n"))
    )
    columns = list(dict.fromkeys([*run, *key]))
    cut = _pieces(intervals.select(*columns, start, end), spans, run, width, start, end)
    inner = cut.select(*columns, F.inline("_inner").alias("_level", "_bin")).join(nodes, [*run, "_level", "_bin"])
    edges = cut.select(*columns, start, end, F.explode("_edges").alias("_bin")).join(placed, [*run, "_bin"])
    edges = edges.where((F.col("ts") >= F.col(start)) & (F.col("ts") <= F.col(end))).withColumn("_n", F.lit(1).cast("long"))
    both = inner.select(*key, "_n").unionByName(edges.select(*key, "_n"))
    inside = both.groupBy(*key).agg(F.sum("_n").alias("_inside"))
    whole = leaves.groupBy(*run).agg(F.sum("_n").alias("_whole"))
    return (
        intervals.select(*columns)
        .join(inside, key, "left")
        .join(whole, run, "left")
        .select(
            *key,
            F.coalesce("_inside", "_whole", F.lit(0).cast("long")).alias("samples"),
            F.col("_inside").isNull().alias("whole_run"),
        )
    )


def _features() -> list[Column]:
    """The nine resource features of a merged state."""
    zero, mb = F.lit(0.0), F.lit(1e6)

    def deviation(name: str) -> Column:
        return F.sqrt(F.col(f"{name}_square") / F.col(f"{name}_n"))

    io = F.col("disk_mean")
    return [
        F.col("cpu_mean"),
        F.when(F.col("cpu_n") > 0, deviation("cpu")).alias("cpu_std"),
        F.col("cpu_max"),
        ((F.col("mem_last.mem") - F.col("mem_first.mem")) / mb).alias("memory_growth"),
        (F.col("mem_sum") / F.col("mem_n") / mb).alias("memory_mean"),
        (F.when(F.col("step_n") > 0, deviation("step")).otherwise(zero) / mb).alias("memory_volatility"),
        (io / mb).alias("io_intensity"),
        F.when(io > 0, deviation("disk") / mb).otherwise(zero).alias("io_burstiness"),
        (F.col("disk_max") / mb).alias("io_peak"),
    ]


def resource_features(
    intervals: DataFrame,
    series: DataFrame,
    run: list[str],
    key: list[str],
    *,
    width: int,
    start: str = "start_ns",
    end: str = "end_ns",
    slices: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Nine resource features per interval, keyed by ``key``.

    Samples and the ends of all intervals are dealt once by run and time and folded
    in blocks (``_folds``) into counts, means, squares about them, extremes, first
    and last sample, and steps, which merge. A step between consecutive samples
    counts for an interval when both are inside. Intervals without samples take the
    run's features, runs without telemetry zeros.
    """
    columns = list(dict.fromkeys([*run, *key]))
    bounds = intervals.select(*columns, F.col(start).alias("_start"), F.col(end).alias("_end"))
    asked = written(bounds.withColumn("_id", F.monotonically_increasing_id()), "intervals")
    folded = FoldedTelemetry(series, run, width, slices, asked, block)
    found = folded.inside.withColumn("_found", F.lit(True))
    names = RESOURCE_FEATURES
    whole = folded.whole.select(*run, *[F.col(n).alias(f"_run_{n}") for n in names])
    return (
        asked.join(found, "_id", "left")
        .join(whole, run, "left")
        .select(
            *columns,
            *[
                F.coalesce(
                    F.when(F.col("_found"), F.col(n)).otherwise(F.col(f"_run_{n}")), F.lit(0.0)
                ).alias(n)
                for n in names
            ],
        )
    )

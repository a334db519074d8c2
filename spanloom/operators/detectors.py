"""Comparison detectors: one flag per run.

Each returns ``run columns, detector, flagged`` for the runs to judge, given the
baseline runs or their models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.units import unit_interval
from .baseline import RESOURCES, RUN
from .ordered import percentiles, ranked
from .scoring import widen_resource_model
from .stacks import _runs
from .storage import written

# Feature sets of the learned detectors.
PATH_FEATURES = ["path_duration_ns", "path_length", "cpu_avg", "memory_avg", "io_avg"]
RESOURCE_ONLY = ["cpu_avg", "cpu_peak", "memory_avg", "memory_peak", "io_avg", "io_peak"]

EULER_GAMMA = 0.5772156649015329


def _flag(judged: DataFrame, name: str, flagged: Column) -> DataFrame:
    return judged.select(
        *RUN, F.lit(name).alias("detector"), F.coalesce(flagged, F.lit(False)).alias("flagged")
    )


def duration_threshold(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Duration above the baseline's 95th percentile."""
    judged = runs.join(bounds, "program", "left")
    return _flag(judged, "threshold", F.col("path_duration_ns") > F.col("duration_p95"))


def control_chart(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Duration outside mean +- 3 population deviations."""
    judged = runs.join(bounds, "program", "left")
    distance = F.abs(F.col("path_duration_ns") - F.col("duration_mean"))
    return _flag(judged, "statistical_control", distance > 3 * F.col("duration_std"))


def resource_threshold(runs: DataFrame, model: DataFrame) -> DataFrame:
    """Any resource average above its 95th percentile."""
    judged = runs.join(widen_resource_model(model), "program", "left")
    over = F.lit(False)
    for r in RESOURCES:
        over = over | F.coalesce(F.col(f"{r}_avg") > F.col(f"_{r}_p95"), F.lit(False))
    return _flag(judged, "resource_only_threshold", over)


def _numeric(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Feature vectors; fractions to ten decimals, so that no order of summing moves a cut."""
    types = dict(runs.dtypes)
    values = [
        F.round(c, 10) if types[c] in ("double", "float") else F.col(c).cast("double")
        for c in columns
    ]
    return runs.select(*RUN, F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]).alias("x"))


def _key() -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in RUN])


def _average_depth(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary tree of n items."""
    large = 2 * (F.log(n - 1) + F.lit(EULER_GAMMA)) - 2 * (n - 1) / n
    return F.when(n > 2, large).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def _draw(seed: int, purpose: str) -> Column:
    """Number in [0, 1) fixed by program, tree and node."""
    return unit_interval(F.concat_ws("|", F.lit(seed), "program", "tree", "node", F.lit(purpose)))


def grow_trees(samples: DataFrame, dim: int, *, levels: int, seed: int = 42) -> DataFrame:
    """Isolation trees from ``(program, tree, rows, x)``, one row per tree node.

    All trees grow a level at a time: a window over the rows of a node finds the
    span of every feature, and hashes of program, tree and node pick one that
    varies and a cut inside its span. Nodes are numbered as in a heap (root 1,
    children 2n and 2n + 1); a level splits while its width is below the tree's
    ``rows``. Rows are dealt by tree once and every window keeps that, so a
    forest takes one shuffle. Inner nodes have ``feature`` and ``cut``; leaves
    have feature -1 and their depth in millionths as ``cut``.
    """
    node = Window.partitionBy("program", "tree", "node")
    grown = samples.repartition("program", "tree").withColumn("node", F.lit(1))
    passed = []
    for level in range(levels):
        spans = F.array(
            *[
                F.struct(
                    F.lit(i).alias("feature"),
                    F.min(F.get("x", F.lit(i))).over(node).alias("low"),
                    F.max(F.get("x", F.lit(i))).over(node).alias("high"),
                )
                for i in range(dim)
            ]
        )
        grown = grown.withColumn("_varied", F.filter(spans, lambda s: s["high"] > s["low"]))
        place = F.floor(_draw(seed, "feature") * F.size("_varied")).cast("int")
        inside = F.when(F.lit(2**level) < F.col("rows"), F.get("_varied", place))
        grown = grown.withColumn("_span", inside)
        low, high = F.col("_span.low"), F.col("_span.high")
        cut = low + (high - low) * _draw(seed, "cut")
        # between neighbouring doubles a cut may round up to the higher one
        cut = F.when(cut < high, cut).otherwise(low)
        split = F.struct(F.col("node"), F.col("_span.feature").alias("feature"), cut.alias("cut"))
        passed.append(f"_split{level}")
        grown = grown.withColumn(passed[-1], F.when(F.col("_span").isNotNull(), split))
        above = F.get("x", F.col(f"{passed[-1]}.feature")) > F.col(f"{passed[-1]}.cut")
        child = F.col("node") * 2 + above.cast("int")
        grown = grown.withColumn("node", F.coalesce(child, "node")).drop("_varied", "_span")
    depth = F.floor(F.log2("node") + 1e-9) + _average_depth(F.count(F.lit(1)).over(node))
    leaf = F.struct(F.col("node"), F.lit(-1).alias("feature"), F.round(depth * 1e6).alias("cut"))
    grown = grown.withColumn("_leaf", leaf)
    return (
        grown.select("program", "tree", "rows", F.inline(F.array_compact(F.array(*passed, "_leaf"))))
        .groupBy("program", "tree", "node")
        .agg(*[F.first(c).alias(c) for c in ("rows", "feature", "cut")])
    )


def _fall(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Summed leaf depths, in millionths, of rows in trees ``feature`` and ``cut``, by tree and heap number."""
    tree, row = np.arange(len(feature)), np.arange(len(x))[:, None]
    node = np.ones((len(x), len(feature)), np.int64)
    for _ in range(levels):
        split = feature[tree, node]
        above = ~(x[row, np.maximum(split, 0)] <= cut[tree, node])
        node = np.where(split < 0, node, node * 2 + above)
    return cut[tree, node].sum(axis=1)


def _fallen(everything: DataFrame, forest: DataFrame, levels: int, block: int) -> DataFrame:
    """Runs with ``rows`` of their program's trees and ``_depth``, summed over its trees.

    Runs are dealt by program and a share of its runs, each share behind its
    program's trees, and stream past them: a task holds one forest and ``block`` runs at a time.
    """
    shares = everything.sparkSession.sparkContext.defaultParallelism
    share = F.pmod(F.xxhash64(*RUN), F.lit(shares)).cast("int").alias("_share")
    trees = forest.select("program", "rows", "_feature", "_cut", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    both = trees.withColumn("_kind", F.lit(0)).unionByName(
        everything.select("*", share, F.lit(1).alias("_kind")), allowMissingColumns=True
    )
    order = ["program", "_share", "_kind"]
    dealt = both.where(F.col("program").isNotNull()).repartition("program", "_share").sortWithinPartitions(*order)

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grown, model = None, [], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            change = _runs(part, order)
            first = np.flatnonzero(np.r_[True, change[1:] != change[:-1]])
            for low, high in zip(first, np.r_[first[1:], len(change)]):
                some = batch.slice(low, high - low)
                here = some["program"][0].as_py(), some["_share"][0].as_py()
                if here != at:
                    at, grown, model = here, [], None
                if some["_kind"][0].as_py() == 0:
                    grown.append(some)
                    continue
                if not grown:  # a program without a forest
                    continue
                if model is None:
                    trees = pa.Table.from_batches(grown).combine_chunks()
                    shape = trees.num_rows, -1
                    split, cut = (
                        trees[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(shape) for c in ("_feature", "_cut")
                    )
                    # a place without a node is never reached
                    model = np.where(np.isnan(split), -1, split).astype(np.int64), cut, trees["rows"][0].as_py()
                for begin in range(0, some.num_rows, block):
                    own = some.slice(begin, block)
                    x = own["x"].flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                    depth = _fall(x, model[0], model[1], levels)
                    columns = [own[c] for c in (*RUN, "_base")]
                    sizes = pa.array(np.full(own.num_rows, model[2]), kind)
                    yield pa.RecordBatch.from_arrays([*columns, sizes, pa.array(depth)], [*RUN, "_base", "rows", "_depth"])

    kind = pa.int64() if dict(forest.dtypes)["rows"] == "bigint" else pa.int32()
    fields = [*dealt.select(*RUN, "_base", "rows").schema.fields, T.StructField("_depth", T.DoubleType())]
    return dealt.mapInArrow(fall, T.StructType(fields))


def isolation_forest(
    baseline: DataFrame,
    runs: DataFrame,
    columns: list[str],
    name: str,
    *,
    contamination: float = 0.1,
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
    at_least: int = 10,
    block: int = 4096,
    slices: int | None = None,
) -> DataFrame:
    """Isolation forest per program, flagging the top share of baseline scores.

    Trees are grown on samples of ``sample`` runs: a hash of the run picks a
    pool of about ``trees * sample`` and tree t takes its own stretch of it
    (wrapping round a small pool). A tree is two arrays over its heap numbers,
    at most four times ``sample`` long. A program's runs are dealt in as many
    shares as there are cores and stream past its trees (``_fallen``), so a program
    with most of the runs is spread and no row holds a whole forest; depths are
    whole millionths, whose sums do not depend on order. Nulls count as 0; programs
    with fewer than ``at_least`` baseline runs have no forest and no flags.
    """
    levels = math.ceil(math.log2(max(sample, 2)))
    sizes = baseline.groupBy("program").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= at_least
    )
    # About trees * sample runs of each program, fewer only if it has no more.
    drawn = F.concat_ws("|", F.lit(seed), _key())
    pool = (
        _numeric(baseline, columns)
        .join(sizes, "program")
        .where(unit_interval(drawn) < F.lit(float(trees * sample)) / F.col("_n"))
        .select(*RUN, "x", F.md5(drawn).alias("_hash"))
    )
    pool_sizes = pool.groupBy("program").agg(F.count(F.lit(1)).alias("_pool"))
    pool = ranked(pool, ["program"], ["_hash"], "_place", slices=slices)
    pool = pool.withColumn("_r", F.col("_place") - 1)
    stretch = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.col("_r") - t * sample, F.col("_pool")) < sample,
    )
    samples = pool.join(pool_sizes, "program").select(
        "program",
        "x",
        F.least(F.col("_pool"), F.lit(sample)).alias("rows"),
        F.explode(stretch).alias("tree"),
    )
    nodes = grow_trees(samples, len(columns), levels=levels, seed=seed)
    entries = F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut"))))
    numbers = F.sequence(F.lit(0), F.lit(2 ** (levels + 1) - 1))
    forest = (
        nodes.groupBy("program", "tree")
        .agg(F.first("rows").alias("rows"), entries.alias("_nodes"))
        .withColumn("_dense", F.transform(numbers, lambda n: F.try_element_at("_nodes", n)))
        .select("program", "rows", F.col("_dense.feature").alias("_feature"), F.col("_dense.cut").alias("_cut"))
    )

    everything = (
        _numeric(baseline, columns)
        .withColumn("_base", F.lit(True))
        .unionByName(_numeric(runs, columns).withColumn("_base", F.lit(False)))
    )
    mean = F.col("_depth") / F.lit(trees * 1e6)
    score = F.pow(F.lit(2.0), -mean / _average_depth(F.col("rows")))
    # Read by the cut and by the flags; growing and scoring should happen once.
    scored = written(
        _fallen(everything, forest, levels, block).select(*RUN, "_base", F.round(score, 9).alias("score")), "isolation-scores"
    )
    cut = percentiles(
        scored.where("_base").select("program", "score"),
        ["program"],
        "score",
        {"_cut": 1 - contamination},
        slices=slices,
    )
    mine = scored.where(~F.col("_base")).select(*RUN, "score")
    judged = runs.select(*RUN).join(mine, RUN, "left").join(cut, "program", "left")
    return _flag(judged, name, F.col("score") > F.round("_cut", 9))


def kernel_frequencies(dim: int, count: int, seed: int = 42) -> list[list[float]]:
    """Random frequencies whose cosines average to an RBF kernel with gamma 1/dim."""
    rng = np.random.default_rng(seed)
    drawn = rng.normal(0.0, math.sqrt(2.0 / dim), (count, dim))
    return [[round(float(v), 6) for v in row] for row in drawn]


def one_class_kernel(
    baseline: DataFrame,
    runs: DataFrame,
    columns: list[str],
    name: str,
    *,
    nu: float = 0.1,
    frequencies: int = 32,
    seed: int = 42,
    at_least: int = 10,
    slices: int | None = None,
) -> DataFrame:
    """One-class detector: mean RBF kernel to the whole baseline, cut at ``nu``.

    Features are scaled by the program's baseline. The kernel mean is expanded
    in random Fourier features, so the model is one short row per program that
    uses every baseline run, and scoring is linear. It is a kernel density
    score, not the solution of a support vector problem.
    """
    dim = len(columns)
    moments = (
        baseline.groupBy("program")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_m{i}") for i, c in enumerate(columns)],
            *[
                F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_s{i}")
                for i, c in enumerate(columns)
            ],
        )
        .where(F.col("_n") >= at_least)
    )
    waves = kernel_frequencies(dim, frequencies, seed)

    def projected(df: DataFrame) -> DataFrame:
        scaled = [
            F.when(
                F.col(f"_s{i}") > 0,
                (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_m{i}")) / F.col(f"_s{i}"),
            ).otherwise(F.lit(0.0))
            for i, c in enumerate(columns)
        ]
        return df.join(moments, "program").select(*RUN, F.array(*scaled).alias("_x"))

    weights = [F.array(*[F.lit(w[i]) for w in waves]) for i in range(dim)]

    def angle(wave: Column) -> Column:
        return sum(F.get("_x", F.lit(i)) * F.get(weights[i], wave) for i in range(dim))

    # A row for each run and wave: two short sums, where a column for each wave makes code too long to compile.
    base = projected(baseline)
    angles = base.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(frequencies - 1)))).select(
        "program", "_j", angle(F.col("_j")).alias("_a")
    )
    means = angles.groupBy("program", "_j").agg(
        F.avg(F.cos("_a")).alias("_c"), F.avg(F.sin("_a")).alias("_d")
    )
    # Read by the cut and by the flags; the pass over the baseline should happen once.
    model = written(
        means.groupBy("program").agg(F.array_sort(F.collect_list(F.struct("_j", "_c", "_d"))).alias("_waves")),
        "kernel-model",
    )

    def scored(rows: DataFrame) -> DataFrame:
        turned = F.transform("_waves", lambda w: angle(w["_j"]))
        terms = F.zip_with(turned, "_waves", lambda a, w: F.cos(a) * w["_c"] + F.sin(a) * w["_d"])
        total = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)
        return rows.join(model, "program").select(*RUN, F.round(total / frequencies, 9).alias("score"))

    cut = percentiles(
        written(scored(base).select("program", "score"), "kernel-scores"),
        ["program"],
        "score",
        {"_cut": nu},
        slices=slices,
    )
    judged = (
        runs.select(*RUN).join(scored(projected(runs)), RUN, "left").join(cut, "program", "left")
    )
    return _flag(judged, name, F.col("score") < F.round("_cut", 9))

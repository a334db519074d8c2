"""Run features and the per-program baseline models, as tables.

A run is ``program, input_id, iteration, is_regression``. Paths carry a
``path_rank`` (1 is the most critical) and a ``path_id`` that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.units import unit_interval
from .ordered import percentiles, ranked, with_following, with_previous

# Sorts compare the first column fastest: the one that tells most runs apart.
RUN = ["input_id", "iteration", "program", "is_regression"]
RESOURCES = ("cpu", "memory", "io")


def _first(column: str) -> Column:
    return F.min_by(column, F.struct("path_rank", "path_id"))


def weighted_path_duration(paths: DataFrame, *, jitter: float = 0.0) -> DataFrame:
    """Mean duration per run, weighted by a path's place in the run's list.

    The list is ordered by ``path_rank, path_id``. The first path counts fully;
    the one in place p counts 1/p unless its duration is not positive or equals
    the first. Injected runs keep the raw first duration. ``jitter`` scales
    normal runs by up to that fraction, from a hash of the run. A run has few
    paths (the top k), so its window is small.
    """
    listed = Window.partitionBy(*RUN).orderBy("path_rank", "path_id")
    duration = F.col("critical_duration_ns")
    placed = paths.withColumns(
        {
            "_place": F.row_number().over(listed),
            "_lead": F.first("critical_duration_ns").over(listed),
        }
    )
    weight = F.lit(1.0) / F.col("_place")
    other = (F.col("_place") > 1) & (duration > 0) & (duration != F.col("_lead"))
    sums = placed.groupBy(*RUN).agg(
        F.max("_lead").alias("_lead"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(other, duration * weight).otherwise(F.lit(0.0))).alias("_sum"),
        F.sum(F.when(other, weight).otherwise(F.lit(0.0))).alias("_weights"),
    )
    lead = F.col("_lead")
    mean = (lead + F.col("_sum")) / (1 + F.col("_weights"))
    if jitter:
        key = F.concat_ws("_", "program", "input_id", "iteration", F.lit("duration"))
        mean = mean * (1 - jitter + 2 * jitter * unit_interval(key))
    plain = F.col("is_regression") | (lead <= 0) | (F.col("_n") == 1)
    weighted = F.when(plain, lead.cast("double")).otherwise(mean)
    # The sum has no fixed order, so its last bits must not decide the whole part.
    return sums.select(
        *RUN,
        F.round(weighted, 3).alias("weighted_duration_ns"),
        F.floor(F.round(weighted, 3)).alias("path_duration_ns"),
    )


def first_paths(paths: DataFrame) -> DataFrame:
    """The first path of each run."""
    return paths.groupBy(*RUN).agg(_first("path_id").alias("path_id"))


def with_first_marked(paths: DataFrame) -> DataFrame:
    """Add ``is_first``: whether a path is the one ``first_paths`` names. A run has few paths."""
    listed = Window.partitionBy(*RUN).orderBy("path_rank", "path_id")
    return paths.withColumn("is_first", F.row_number().over(listed) == 1)


def run_features(
    paths: DataFrame,
    functions: DataFrame,
    bottlenecks: DataFrame | None,
    telemetry: DataFrame,
    *,
    jitter: float = 0.0,
    firsts: bool = False,
) -> DataFrame:
    """One row per run: first path, its bottleneck, duration and resources.

    ``functions`` and ``bottlenecks`` are keyed by run and ``path_id``; with
    ``firsts`` the functions are those of first paths already. A run whose weighted duration is not positive takes its longest function. Without
    recorded ``bottlenecks`` the first one is the longest non-root function, in
    the same pass over the functions.
    """
    durations = weighted_path_duration(paths, jitter=jitter)
    heads = first_paths(paths)
    on_head = [*RUN, "path_id"]
    inner = F.when(F.col("pos") > 0, F.col("duration_ns"))
    place = F.when(F.col("pos") > 0, F.struct("duration_ns", -F.col("pos")))
    slowest = [
        F.max_by("function_name", place).alias("bottleneck_function"),
        (F.lit(100.0) * F.max(inner) / F.nullif(F.sum(inner), F.lit(0))).alias(
            "bottleneck_percentage"
        ),
    ]
    about = (
        (functions if firsts else functions.join(heads, on_head))
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("path_length"),
            F.max("duration_ns").alias("_longest"),
            *([] if bottlenecks is not None else slowest),
        )
    )
    joined = durations.join(about, RUN, "left")
    if bottlenecks is not None:
        worst = (
            bottlenecks.join(heads, on_head)
            .groupBy(*RUN)
            .agg(
                F.min_by("function_name", "bottleneck_rank").alias("bottleneck_function"),
                F.min_by("percentage_of_path", "bottleneck_rank").alias("bottleneck_percentage"),
            )
        )
        joined = joined.join(worst, RUN, "left")
    zero = F.lit(0).cast("long")
    return (
        joined.join(telemetry, RUN, "left")
        .withColumn(
            "path_duration_ns",
            F.when(F.col("path_duration_ns") > 0, F.col("path_duration_ns")).otherwise(
                F.coalesce("_longest", zero)
            ),
        )
        .withColumn("path_length", F.coalesce("path_length", zero))
        .withColumn("bottleneck_percentage", F.coalesce("bottleneck_percentage", F.lit(0.0)))
        .drop("_longest", "weighted_duration_ns")
    )


def run_telemetry(aggregates: DataFrame) -> DataFrame:
    """Long telemetry aggregates per run to peak/average columns, in MB.

    The -1 sentinel means "no positive sample" and becomes null, so it is never
    scored as data.
    """
    sources = {"cpu": 1.0, "mem": 1e6, "disk": 1e6}
    names = dict(zip(sources, RESOURCES))
    cells = []
    for metric, scale in sources.items():
        for source, suffix in (("peak", "peak"), ("average", "avg")):
            cell = F.max(F.when((F.col("metric") == metric) & (F.col(source) >= 0), F.col(source)))
            cells.append((cell / scale).alias(f"{names[metric]}_{suffix}"))
    return aggregates.groupBy(*RUN).agg(*cells)


def attach_archetype(runs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Archetype of the run's input and iteration, 0 if unknown.

    A run that already carries ``own_archetype`` (an injected one) keeps it.
    """
    known = assignments.select(
        "program", "input_id", "iteration", F.col("archetype").alias("_assigned")
    )
    joined = runs.join(known, ["program", "input_id", "iteration"], "left")
    choices = [F.col("_assigned"), F.lit(0)]
    if "own_archetype" in runs.columns:
        own = F.when(F.col("is_regression"), F.col("own_archetype"))
        choices.insert(0, own)
    return joined.withColumn("archetype", F.coalesce(*choices)).drop("_assigned", "own_archetype")


def label_union(tests: DataFrame, regressions: DataFrame) -> DataFrame:
    """Test runs as normal, injected runs (iteration 0) with their type."""
    normal = tests.withColumns(
        {"is_regression": F.lit(False), "regression_type": F.lit(None).cast("string")}
    )
    injected = regressions.where(F.col("iteration") == 0).withColumns(
        {
            "is_regression": F.lit(True),
            "regression_type": F.coalesce("regression_type", F.lit("unknown")),
        }
    )
    return normal.unionByName(injected)


def split_by_input(
    runs: DataFrame,
    share: float = 0.7,
    *,
    at_least: int = 10,
    slices: int | None = None,
) -> DataFrame:
    """Add ``is_baseline``: true for the first share of each program's inputs.

    A program with fewer than ``at_least`` runs is all baseline.
    """
    inputs = runs.select("program", "input_id").distinct()
    sizes = (
        runs.groupBy("program")
        .agg(F.count(F.lit(1)).alias("_runs"))
        .join(inputs.groupBy("program").agg(F.count(F.lit(1)).alias("_inputs")), "program")
    )
    placed = ranked(inputs, ["program"], ["input_id"], "_place", slices=slices)
    chosen = placed.join(sizes, "program").select(
        "program",
        "input_id",
        (
            (F.col("_runs") < at_least) | (F.col("_place") <= F.floor(F.col("_inputs") * F.lit(share)))
        ).alias("is_baseline"),
    )
    return runs.join(chosen, ["program", "input_id"])


def function_frequency_model(functions: DataFrame) -> DataFrame:
    """Baseline count and mean relative position per program and function."""
    lengths = functions.groupBy(*RUN).agg(F.count(F.lit(1)).alias("_n"))
    return (
        functions.join(lengths, RUN)
        .groupBy("program", "function_name")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.avg(F.col("pos") / F.col("_n")).alias("mean_position"),
        )
    )


def length_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("program").agg(
        F.avg("path_length").alias("path_length_mean"),
        F.stddev_pop("path_length").alias("path_length_std"),
        F.count(F.lit(1)).alias("total_paths"),
    )


def ngrams(functions: DataFrame, key: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Consecutive function names joined by ``->``, one row per occurrence."""
    longest = max(sizes)
    chained = with_following(
        functions.select(*dict.fromkeys([*key, "pos", "function_name"])),
        key,
        "pos",
        ["function_name"],
        steps=longest - 1,
    )
    parts = ["function_name", *[f"next{i}_function_name" for i in range(1, longest)]]
    grams = [
        F.when(F.col(parts[size - 1]).isNotNull(), F.concat_ws("->", *parts[:size]))
        for size in sizes
    ]
    return chained.select(*key, F.explode(F.array_compact(F.array(*grams))).alias("ngram"))


def ngram_model(functions: DataFrame, key: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Counts of 2- and 3-grams per program."""
    return (
        ngrams(functions, key, sizes)
        .groupBy("program", "ngram")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def bottleneck_model(runs: DataFrame) -> DataFrame:
    return (
        runs.where(F.col("bottleneck_function").isNotNull())
        .groupBy("program", "bottleneck_function")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def resource_model(runs: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Mean, population deviation, p95 and p99 per program and resource."""
    long = runs.select(
        "program",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("resource"), F.col(f"{r}_avg").cast("double").alias("_v"))
                    for r in RESOURCES
                ]
            )
        ),
    ).where(F.col("_v").isNotNull())
    keys = ["program", "resource"]
    basic = long.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    tails = percentiles(long, keys, "_v", {"p95": 0.95, "p99": 0.99}, slices=slices)
    return basic.join(tails, keys)


def archetype_model(runs: DataFrame) -> DataFrame:
    """Count and share of each archetype per program, with what scoring needs."""
    counts = runs.groupBy("program", "archetype").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("program").agg(
        F.sum("count").alias("_total"),
        F.count(F.lit(1)).alias("archetypes"),
        F.max("count").alias("_most"),
    )
    return counts.join(totals, "program").select(
        "program",
        "archetype",
        "count",
        (F.col("count") / F.col("_total")).alias("frequency"),
        "archetypes",
        (F.col("_most") / F.col("_total")).alias("max_frequency"),
    )


def archetype_transitions(runs: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Counts of archetype changes between successive iterations of an input."""
    stepped = with_previous(
        runs.select("program", "input_id", "iteration", "archetype"),
        ["program", "input_id"],
        ["iteration"],
        ["archetype"],
        "_before",
        slices=slices,
    ).where(F.col("_before").isNotNull())
    move = F.concat_ws("->", F.col("_before.archetype"), F.col("archetype"))
    return stepped.groupBy("program", move.alias("transition")).agg(F.count(F.lit(1)).alias("count"))


def bounds_model(runs: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Duration and length statistics per program."""
    basic = runs.groupBy("program").agg(
        F.avg("path_duration_ns").alias("duration_mean"),
        F.stddev_pop("path_duration_ns").alias("duration_std"),
        F.avg("path_length").alias("length_mean"),
        F.stddev_pop("path_length").alias("length_std"),
        F.max("path_length").alias("length_max"),
        F.min("path_length").alias("length_min"),
    )
    levels = percentiles(
        runs,
        ["program"],
        "path_duration_ns",
        {
            "duration_p25": 0.25,
            "duration_median": 0.5,
            "duration_p75": 0.75,
            "duration_p95": 0.95,
            "duration_p99": 0.99,
        },
        slices=slices,
    )
    return (
        basic.join(levels, "program")
        .withColumn("duration_iqr", F.col("duration_p75") - F.col("duration_p25"))
        .drop("duration_p25", "duration_p75")
    )

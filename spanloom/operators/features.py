"""The 33-column feature vector of a path.

Inputs are rows per path function: the path key, a gap-free 0-based ``pos`` and
the columns each extractor names. Everything is a grouped aggregate; the two
extractors that need order use the sliced scans, so one huge path is spread
over many tasks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import name_prefix
from .ordered import percentiles, running_sum, with_following
from .telemetry import RESOURCE_FEATURES, resource_features

# Names and order of the feature vector.
STRUCTURAL = (
    "path_depth",
    "log_depth",
    "unique_prefixes",
    "complexity_mean",
    "complexity_std",
    "complexity_gradient",
)
TEMPORAL = (
    "log_total_duration",
    "time_gini",
    "max_duration_ratio",
    "top3_duration_ratio",
    "self_time_ratio",
    "peak_position",
)
TRANSITION = (
    "transition_entropy",
    "cpu_ratio",
    "memory_ratio",
    "io_ratio",
    "io_to_cpu",
    "cpu_to_mem",
    "mem_to_io",
)
PHASE = (
    "cpu_phases",
    "memory_monotonic",
    "io_concentrated",
    "resource_volatility",
    "phase_distance",
)
FEATURES = STRUCTURAL + TEMPORAL + RESOURCE_FEATURES + TRANSITION + PHASE

CPU_TYPE, MEMORY_TYPE, IO_TYPE = "CPU-bound", "Memory-bound", "I/O-bound"


def with_static(
    functions: DataFrame, static: DataFrame, on: list[str], columns: dict[str, Column]
) -> DataFrame:
    """Left-join static metrics and fill what an unknown function lacks."""
    joined = functions.join(static, on, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), default) for n, default in columns.items()})


def function_complexity() -> Column:
    """Linear per-function complexity; zero for a function without metrics."""
    weighted = (
        F.col("loc") * 0.3
        + F.col("loops") * 0.3
        + F.col("nested_loops") * 0.2
        + F.col("calls") * 0.2
    )
    return F.coalesce(weighted, F.lit(0.0))


def structural_features(functions: DataFrame, key: list[str], static: DataFrame, on: list[str]) -> DataFrame:
    """Depth, name prefixes, and complexity level, spread and slope."""
    known = static.select(*on, "loc", "loops", "nested_loops", "calls")
    joined = functions.select(*dict.fromkeys([*key, *on, "pos", "function_name"])).join(known, on, "left")
    scored = joined.withColumn("_cx", function_complexity())
    position = F.col("pos").cast("double")
    return scored.groupBy(*key).agg(
        F.count(F.lit(1)).alias("path_depth"),
        F.log1p(F.count(F.lit(1))).alias("log_depth"),
        F.count_distinct(name_prefix(F.col("function_name"))).alias("unique_prefixes"),
        F.avg("_cx").alias("complexity_mean"),
        F.stddev_pop("_cx").alias("complexity_std"),
        F.coalesce(F.regr_slope("_cx", position), F.lit(0.0)).alias("complexity_gradient"),
    )


def temporal_features(
    functions: DataFrame, key: list[str], *, slices: int | None = None
) -> DataFrame:
    """Total, Gini, top-1 and top-3 share, self share, place of the peak."""
    negated = functions.select(*key, "pos", "duration_ns", "self_time_ns").withColumn(
        "_neg", -F.col("duration_ns")
    )
    # Rank 1 is the longest function; the ascending rank is n + 1 - rank.
    placed = running_sum(
        negated, key, ["_neg", "pos"], F.lit(1).cast("long"), "_rank", slices=slices
    )
    duration = F.col("duration_ns")
    sums = placed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(duration.cast("decimal(20,0)")).alias("_total"),
        F.sum(F.col("self_time_ns").cast("decimal(20,0)")).cast("double").alias("_self"),
        F.sum(F.col("_rank") * duration.cast("double")).alias("_ranked"),
        F.max(duration).alias("_max"),
        F.sum(F.when(F.col("_rank") <= 3, duration)).alias("_top3"),
        F.min(F.when(F.col("_rank") == 1, F.col("pos"))).alias("_peak"),
    )
    # products of counts and nanoseconds exceed 64 bits
    n, total = F.col("_n").cast("double"), F.col("_total").cast("double")
    some = total > 0
    ascending = (n + 1) * total - F.col("_ranked")
    gini = 2 * ascending / (n * total) - (n + 1) / n
    top3 = F.when(n >= 3, F.col("_top3")).otherwise(F.col("_max"))
    zero = F.lit(0.0)
    return sums.select(
        *key,
        F.log1p(total).alias("log_total_duration"),
        F.when((n >= 2) & (total != 0), gini).otherwise(zero).alias("time_gini"),
        F.when(some, F.col("_max") / total).otherwise(zero).alias("max_duration_ratio"),
        F.when(some, top3 / total).otherwise(zero).alias("top3_duration_ratio"),
        F.when(some, F.col("_self") / total).otherwise(zero).alias("self_time_ratio"),
        (F.col("_peak") / n).alias("peak_position"),
    )


def transition_features(functions: DataFrame, key: list[str], type_column: str = "function_type") -> DataFrame:
    """Entropy of consecutive type pairs, type shares, three named transitions."""
    typed = functions.select(
        *key, "pos", F.coalesce(F.col(type_column), F.lit("Unknown")).alias("_type")
    )
    paired = with_following(typed, key, "pos", ["_type"])
    pairs = paired.groupBy(*key, "_type", "next1__type").agg(F.count(F.lit(1)).alias("_c"))
    here, following, count = F.col("_type"), F.col("next1__type"), F.col("_c")

    def of_type(kind: str) -> Column:
        return F.sum(F.when(here == kind, count).otherwise(F.lit(0)))

    def moving(first: str, second: str) -> Column:
        return F.sum(F.when((here == first) & (following == second), count).otherwise(F.lit(0)))

    step = F.when(following.isNotNull(), count)
    sums = pairs.groupBy(*key).agg(
        F.sum(count).alias("_n"),
        F.sum(step).alias("_steps"),
        F.sum(step * F.log2(step)).alias("_weighted"),
        of_type(CPU_TYPE).alias("_cpu"),
        of_type(MEMORY_TYPE).alias("_mem"),
        of_type(IO_TYPE).alias("_io"),
        moving(IO_TYPE, CPU_TYPE).alias("io_to_cpu"),
        moving(CPU_TYPE, MEMORY_TYPE).alias("cpu_to_mem"),
        moving(MEMORY_TYPE, IO_TYPE).alias("mem_to_io"),
    )
    entropy = F.log2(F.col("_steps")) - F.col("_weighted") / F.col("_steps")
    return sums.select(
        *key,
        F.coalesce(entropy, F.lit(0.0)).alias("transition_entropy"),
        (F.col("_cpu") / F.col("_n")).alias("cpu_ratio"),
        (F.col("_mem") / F.col("_n")).alias("memory_ratio"),
        (F.col("_io") / F.col("_n")).alias("io_ratio"),
        "io_to_cpu",
        "cpu_to_mem",
        "mem_to_io",
    )


def path_intervals(functions: DataFrame, key: list[str]) -> DataFrame:
    """Start of the first and end of the last function, per path."""
    return functions.groupBy(*key).agg(
        F.min_by("start_ns", "pos").alias("start_ns"), F.max_by("end_ns", "pos").alias("end_ns")
    )


def phase_intervals(functions: DataFrame, key: list[str]) -> DataFrame:
    """Up to four phases per path, cut at n//4, n//2 and 3n//4; empty ones drop out."""
    lengths = functions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    cuts = [F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)]
    phase = sum((F.col("pos") >= cut).cast("int") for cut in cuts)
    placed = functions.join(lengths, key).withColumn("phase", phase)
    return path_intervals(placed, [*key, "phase"])


def phase_features(
    functions: DataFrame,
    series: DataFrame,
    run: list[str],
    key: list[str],
    *,
    width: int,
    slices: int | None = None,
    measured: DataFrame | None = None,
) -> DataFrame:
    """How resources change across the phases of a path.

    ``phase_distance`` is the mean Euclidean distance between phases; a path
    has at most four, so its phases are folded into one small array. ``measured``
    are the resource features of these very phases, if they are made already.
    """
    names = RESOURCE_FEATURES
    if measured is None:
        intervals = phase_intervals(functions, key)
        measured = resource_features(intervals, series, run, [*key, "phase"], width=width, slices=slices)
    vector = F.array(*[F.col(n) for n in names])
    folded = measured.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("phase", vector.alias("v")))), lambda p: p["v"]
        ).alias("_p"),
        *[F.stddev_pop(n).alias(f"_std_{n}") for n in names],
    )
    phases = F.size("_p")

    def value(index: int, feature: str) -> Column:
        return F.get(F.get("_p", F.lit(index)), F.lit(names.index(feature)))

    def present(index: int) -> Column:
        return phases > index

    changes = sum(
        F.when(
            present(i + 1) & (F.abs(value(i + 1, "cpu_mean") - value(i, "cpu_mean")) > 20), 1
        ).otherwise(0)
        for i in range(3)
    )
    falls = [
        present(i + 1) & (value(i + 1, "memory_mean") < value(i, "memory_mean")) for i in range(3)
    ]
    falling = F.coalesce(falls[0] | falls[1] | falls[2], F.lit(False))
    io = F.transform("_p", lambda p: F.get(p, F.lit(names.index("io_intensity"))))
    io_mean = F.aggregate(io, F.lit(0.0), lambda a, x: a + x) / phases
    volatility = sum(F.col(f"_std_{n}") for n in names) / len(names)
    distances = [
        F.when(
            present(j),
            F.sqrt(
                F.aggregate(
                    F.zip_with(
                        F.get("_p", F.lit(i)), F.get("_p", F.lit(j)), lambda a, b: (a - b) * (a - b)
                    ),
                    F.lit(0.0),
                    lambda a, x: a + x,
                )
            ),
        ).otherwise(F.lit(0.0))
        for i, j in combinations(range(4), 2)
    ]
    pair_count = phases * (phases - 1) / 2
    several = phases >= 2
    zero = F.lit(0.0)
    return folded.select(
        *key,
        F.when(several, changes).otherwise(F.lit(0)).alias("cpu_phases"),
        F.when(several & ~falling, 1).otherwise(0).alias("memory_monotonic"),
        F.when(several & (F.array_max(io) > 2 * io_mean), 1).otherwise(0).alias("io_concentrated"),
        F.when(several, volatility).otherwise(zero).alias("resource_volatility"),
        F.when(several, sum(distances) / pair_count).otherwise(zero).alias("phase_distance"),
    )


def assemble_features(parts: list[DataFrame], key: list[str], metadata: DataFrame) -> DataFrame:
    """Join feature groups on the path key; add the vector as an array.

    Inner joins: a path without functions has no features and drops out.
    """
    wide = metadata
    for part in parts:
        wide = wide.join(part, key)
    return wide.withColumn("features", F.array(*[F.col(n).cast("double") for n in FEATURES]))


def path_metadata(functions: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """Duration and length per path beside columns constant along the path."""
    return functions.groupBy(*key).agg(
        (F.max_by("end_ns", "pos") - F.min_by("start_ns", "pos")).alias("path_duration_ns"),
        F.count(F.lit(1)).alias("path_length"),
        *[F.min_by(source, "pos").alias(name) for name, source in columns.items()],
    )


def resource_thresholds(
    features: DataFrame, *, compat: bool = False, slices: int | None = None
) -> DataFrame:
    """Largest depth and the 80th/40th percentiles of three resource features.

    ``compat`` reads vector positions 6, 9 and 12 instead of the columns the
    threshold names stand for.
    """
    cpu, memory, io = (
        (FEATURES[6], FEATURES[9], FEATURES[12])
        if compat
        else ("cpu_mean", "memory_growth", "io_intensity")
    )
    sources = {"cpu": F.col(cpu), "memory": F.abs(F.col(memory)), "io": F.col(io)}
    long = features.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("resource"), source.cast("double").alias("_v"))
                    for name, source in sources.items()
                ]
            )
        )
    )
    levels = percentiles(
        long, ["resource"], "_v", {"high": 0.8, "medium": 0.4}, slices=slices
    )

    def level(resource: str, name: str) -> Column:
        return F.max(F.when(F.col("resource") == resource, F.col(name))).alias(f"{resource}_{name}")

    wide = levels.agg(*[level(r, n) for r in sources for n in ("high", "medium")])
    depth = features.agg(F.max("path_depth")).scalar()
    return wide.withColumn("max_path_depth", depth)

"""Which runs exist, which are missing, how executions went."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .grouping import chunked_lists
from .ordered import ranked

INPUT_RUN = ["program", "input_id", "iteration"]


def complete_runs(paths: DataFrame, telemetry: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Runs that have both files and a path list that is not missing."""
    key = key or INPUT_RUN
    present = paths.where(F.col("top_k_critical_paths").isNotNull())
    return present.join(telemetry.select(*key).distinct(), key, "left_semi")


def missing_iterations(inputs: DataFrame, runs: DataFrame, iterations: int = 3) -> DataFrame:
    """Expected iterations of each known input that have no run."""
    expected = inputs.select("program", "input_id").distinct().withColumn(
        "iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))
    )
    return expected.join(runs.select(*INPUT_RUN).distinct(), INPUT_RUN, "left_anti")


def pending_work(runs: DataFrame, outputs: DataFrame, *, last_iteration: int = 2) -> DataFrame:
    """Runs still to do.

    ``outputs`` lists ``program, input_id, iteration, kind, size`` with kinds
    ``paths`` and ``telemetry``. A run is done if both are there and not empty;
    a whole input is done once the paths of its last iteration are.
    """
    filled = outputs.where(F.col("size") > 0)
    done = (
        filled.groupBy(*INPUT_RUN)
        .agg(F.count_distinct("kind").alias("_kinds"))
        .where(F.col("_kinds") >= 2)
    )
    finished = filled.where(
        (F.col("kind") == "paths") & (F.col("iteration") == last_iteration)
    ).select("program", "input_id").distinct()
    return runs.join(done, INPUT_RUN, "left_anti").join(finished, ["program", "input_id"], "left_anti")


def size_gate(files: DataFrame, by: list[str], max_bytes: int = 2 * 1024**3) -> DataFrame:
    """Groups of files ``(.., length)`` that are together no larger than the limit."""
    return (
        files.groupBy(*by)
        .agg(F.sum("length").alias("total_bytes"))
        .where(F.col("total_bytes") <= max_bytes)
    )


def execution_summary(executions: DataFrame) -> DataFrame:
    """Times per (type, range) with the overall success rate on every row.

    ``executions`` has ``type, range, seconds, success``; failures carry no time.
    """
    overall = executions.agg(
        F.struct(
            F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("bad")
        )
    ).scalar()
    good, bad = overall.getField("good"), overall.getField("bad")
    time = F.when(F.col("success"), F.col("seconds"))
    rate = F.when(good + bad > 0, good / (good + bad)).otherwise(F.lit(0.0))
    return executions.groupBy("type", "range").agg(
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
        F.avg(time).alias("avg_time"),
    ).select(
        "*",
        good.alias("total_success"),
        bad.alias("total_failure"),
        rate.alias("success_rate"),
    )


def slice_inputs(
    inputs: DataFrame,
    order: list[str],
    size: int,
    range_index: int | Column = 0,
    *,
    slices: int | None = None,
) -> DataFrame:
    """Inputs ``range * size`` to ``(range + 1) * size`` in the given order."""
    placed = ranked(inputs, [], order, "position", slices=slices)
    first = F.lit(range_index) * size if isinstance(range_index, int) else range_index * size
    return placed.where((F.col("position") > first) & (F.col("position") <= first + size))


def failure_table(executions: DataFrame, *, per_row: int = 1000) -> DataFrame:
    """Failed inputs listed per (type, range), in parts of bounded length."""
    failed = executions.where(~F.col("success"))
    return chunked_lists(failed, ["type", "range"], "input", "inputs", per_row=per_row)


def parameter_grid(options: dict[str, Column], source: DataFrame) -> DataFrame:
    """All combinations of option lists, one array column per parameter.

    ``source`` has one row holding the lists; each is exploded in turn.
    """
    grid = source.select(*[c.alias(n) for n, c in options.items()])
    for name in options:
        grid = grid.withColumn(name, F.explode(name))
    return grid.dropDuplicates()


def sample_grid(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` combinations without replacement, in the order of a seeded hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in grid.columns]))
    return grid.withColumn("_key", key).orderBy("_key").limit(n).drop("_key")


#: Rounds of the permutation of combination numbers.
ROUNDS = 4


def _keyed(seed: int, turn: int, x: Column) -> Column:
    """A number below 2**60 from the seed, the round and ``x``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(turn)), x.cast("string")).cast("binary"))
    return F.conv(F.right(digest, F.lit(15)), 16, 10).cast("long")


def sample_combinations(options: dict[str, DataFrame], n: int, seed: int = 42) -> DataFrame:
    """``n`` different combinations of one value from each option list, drawn by a seeded permutation.

    Each frame of ``options`` has one column of values; repeats and nulls don't
    count. A combination is a number in mixed radix, one digit per list. The
    numbers ``0..n-1`` go through a keyed permutation of all of them (two halves
    that add a hash of the other in turn, each modulo its own size, which is one to
    one for any sizes), and are decoded by division: ``n`` rows are made, never the
    product. ``draw`` numbers them. All combinations are returned if there are
    fewer than ``n``; none if a list is empty. The product must be below 2**62.
    """
    names = list(options)
    lists = {}
    for name, values in options.items():
        distinct = values.select(F.col(values.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
        lists[name] = ranked(distinct, [], [name], "_digit").withColumn("_digit", F.col("_digit") - 1)
    sizes = [lists[name].count() for name in names]
    total = math.prod(sizes)
    if total >= 1 << 62:
        raise ValueError("more than 2**62 combinations")
    high, low = math.prod(sizes[: len(sizes) // 2]), math.prod(sizes[len(sizes) // 2 :])
    drawn = options[names[0]].sparkSession.range(min(n, total)).withColumnRenamed("id", "draw")
    # one row per number; its halves below high and low
    halves = drawn.select("draw", F.expr(f"draw div {max(low, 1)}").alias("_a"), F.expr(f"draw % {max(low, 1)}").alias("_b"))
    for turn in range(ROUNDS):
        half, other, size = ("_a", "_b", high) if turn % 2 == 0 else ("_b", "_a", low)
        moved = F.col(half) + F.pmod(_keyed(seed, turn, F.col(other)), F.lit(max(size, 1)))
        halves = halves.withColumn(half, F.pmod(moved, F.lit(max(size, 1))))
    out = halves.withColumn("_left", F.col("_a") * low + F.col("_b"))
    for name, size in reversed(list(zip(names, sizes))):
        radix = max(size, 1)
        out = out.withColumn("_digit", F.pmod("_left", F.lit(radix))).withColumn("_left", F.expr(f"_left div {radix}"))
        out = out.join(lists[name], "_digit").drop("_digit")
    return out.select("draw", *names)

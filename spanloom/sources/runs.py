"""Run directories: one folder per program, input and iteration.

``<root>/<program>/<mode>/<program>_<mode>_itself_input<N>/iter-<I>/<file>``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import clean_name, id_from_path
from ..functions.units import iso_to_ns
from . import schemas

# One program keeps its paths under another file name.
PATHS_FILE = "critical_paths.json"
PATHS_FILE_BY_PROGRAM = {"sqlite": "critical_paths_with_functions.json"}
TELEMETRY_FILE = "kernel_data.json"
CALLS_FILE = "function_stats.csv"

RUN_KEY = ["program", "input_id", "iteration"]


def run_key(path: Column) -> list[Column]:
    """Program, input and iteration out of a file path."""
    return [
        F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+/iter-\d+/[^/]+$", 1).alias("program"),
        id_from_path(F.regexp_extract(path, r"/([^/]+)/iter-\d+/[^/]+$", 1)).alias("input_id"),
        id_from_path(F.regexp_extract(path, r"/(iter-\d+)/[^/]+$", 1)).alias("iteration"),
    ]


def _located(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*run_key(F.col("_metadata.file_path")), *columns)


def _parsed() -> Column:
    """Rows of files that parse.

    Spark refuses to read the column of corrupt records alone, as counting rows
    would; the second term, true of every row, keeps another column in the scan.
    """
    return F.col("_corrupt_record").isNull() & (F.xxhash64("summary") >= F.lit(-(2**63)))


def _glob(root: str, mode: str, pattern: str, name: str) -> str:
    return f"{root.rstrip('/')}/*/{mode}/{pattern}/iter-*/{name}"


def read_critical_paths(spark: SparkSession, root: str, mode: str = "analysis") -> DataFrame:
    """One row per run: key, summary, path list and executed function names.

    Files that do not parse are dropped, as are folders without a number.
    """
    raw = (
        spark.read.schema(schemas.CRITICAL_PATHS + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(_glob(root, mode, "*_itself_input*", "critical_paths*.json"))
    )
    file_name = F.substring_index("_metadata.file_path", "/", -1)
    expected = F.lit(PATHS_FILE)
    for program, name in PATHS_FILE_BY_PROGRAM.items():
        expected = F.when(run_key(F.col("_metadata.file_path"))[0] == program, name).otherwise(expected)
    kept = raw.where(_parsed() & (file_name == expected))
    runs = _located(kept, "summary", "top_k_critical_paths", "executed_functions")
    return runs.where(F.col("input_id").isNotNull() & F.col("iteration").isNotNull())


def read_regressions(spark: SparkSession, root: str, mode: str = "analysis") -> DataFrame:
    """Injected runs: iteration 0 only, type from the summary, else ``unknown``."""
    raw = (
        spark.read.schema(schemas.CRITICAL_PATHS + ", _corrupt_record string")
        .option("multiLine", True)
        .json(f"{root.rstrip('/')}/*/{mode}/*_itself_regression_*/iter-0/critical_paths*.json")
    )
    kept = _located(
        raw.where(_parsed()),
        "summary",
        "top_k_critical_paths",
        "executed_functions",
        F.coalesce("summary._regression_type", F.lit("unknown")).alias("regression_type"),
        F.col("summary._archetype").alias("own_archetype"),
    )
    return kept.where(F.col("input_id").isNotNull())


def read_telemetry(spark: SparkSession, root: str, mode: str = "analysis") -> DataFrame:
    """One row per run with its parallel arrays and stored aggregates."""
    raw = (
        spark.read.schema(schemas.TELEMETRY)
        .option("multiLine", True)
        .json(_glob(root, mode, "*_itself_*", TELEMETRY_FILE))
    )
    return _located(raw, *raw.columns)


def read_call_stats(spark: SparkSession, root: str, mode: str = "analysis") -> DataFrame:
    """One row per call."""
    raw = (
        spark.read.schema(schemas.CALL_STATS)
        .option("header", True)
        .csv(_glob(root, mode, "*_itself_*", CALLS_FILE))
    )
    return _located(raw, *raw.columns)


def telemetry_rows(documents: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Parallel arrays to one row per sample."""
    series = F.col("time_series")
    zipped = F.arrays_zip(
        series["timestamps_ns"].alias("ts"),
        series["cpu_usage"].alias("cpu"),
        series["memory_usage"].alias("mem"),
        series["disk_usage"].alias("disk"),
    )
    return documents.select(*(key or RUN_KEY), F.inline(zipped)).toDF(
        *(key or RUN_KEY), "ts", "cpu", "mem", "disk"
    )


def path_rows(documents: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per path, in document order (``path_id`` is the place in the list)."""
    key = key or RUN_KEY
    exploded = documents.select(*key, F.posexplode("top_k_critical_paths").alias("path_id", "_p"))
    return exploded.select(
        *key,
        "path_id",
        F.col("_p.rank").alias("path_rank"),
        "_p.thread_id",
        "_p.critical_duration_ns",
        "_p.total_duration_ns",
        "_p.path_length",
        "_p.functions",
        "_p.bottlenecks",
    )


def path_function_rows(
    paths: DataFrame, key: list[str] | None = None, *, lower: bool = False
) -> DataFrame:
    """One row per path function, root first, with times in nanoseconds."""
    key = key or RUN_KEY
    exploded = paths.select(*key, "path_id", "path_rank", F.posexplode("functions").alias("pos", "_f"))
    return exploded.select(
        *key,
        "path_id",
        "path_rank",
        "pos",
        clean_name(F.col("_f.function_name"), lower=lower).alias("function_name"),
        "_f.duration_ns",
        "_f.self_time_ns",
        iso_to_ns(F.col("_f.start_time")).alias("start_ns"),
        iso_to_ns(F.col("_f.end_time")).alias("end_ns"),
    )


def path_bottleneck_rows(paths: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or RUN_KEY
    exploded = paths.select(*key, "path_id", F.posexplode("bottlenecks").alias("_pos", "_b"))
    return exploded.select(
        *key,
        "path_id",
        (F.col("_pos") + 1).alias("bottleneck_rank"),
        clean_name(F.col("_b.function")).alias("function_name"),
        "_b.percentage_of_path",
    )


def executed_rows(documents: DataFrame, key: list[str] | None = None) -> DataFrame:
    return documents.select(
        *(key or RUN_KEY), F.explode("executed_functions").alias("function_name")
    ).withColumn("function_name", clean_name(F.col("function_name")))


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and length of files; their contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")

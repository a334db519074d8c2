"""Static metrics, trace events, parameters, assignments and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import clean_name
from . import schemas
from .committed import write_csv_parts, write_files


def read_static_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files, with ``file_pos``: the path of the file and an entry's place in it."""
    raw = spark.read.schema(schemas.STATIC_METRICS).option("multiLine", True).json(path)
    # A multi-line file is read by one task, so ids grow in document order.
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("id"))
    return raw.select("*", place.alias("file_pos"))


def flatten_static_metrics(documents: DataFrame, by: list[str] | None = None, *, lower: bool = False) -> DataFrame:
    """One row per function name; of several entries the last one counts."""
    by = by or []
    functions = documents.select(*by, "file", "file_pos", F.posexplode("functions").alias("pos", "_f"))
    branches = F.col("_f.number_of_branches")
    named = functions.select(
        *by,
        clean_name(F.col("_f.name"), lower=lower).alias("function_name"),
        F.struct("file_pos", "pos").alias("_order"),
        F.struct(
            F.col("_f.line_of_codes").alias("loc"),
            F.col("_f.number_of_loops").alias("loops"),
            F.col("_f.number_of_nested_loops").alias("nested_loops"),
            F.col("_f.number_of_calls").alias("calls"),
            branches["number_of_if"].alias("ifs"),
            branches["number_of_switch"].alias("switches"),
            F.coalesce(F.col("_f.has_io"), F.lit(False)).alias("has_io"),
            F.coalesce(F.col("_f.function_type"), F.lit("Unknown")).alias("function_type"),
        ).alias("_metrics"),
    )
    last = named.groupBy(*by, "function_name").agg(F.max_by("_metrics", "_order").alias("_metrics"))
    flat = last.select(*by, "function_name", "_metrics.*")
    return flat.fillna(0, ["loc", "loops", "nested_loops", "calls", "ifs", "switches"])


def read_trace_events(spark: SparkSession, path: str) -> DataFrame:
    """Begin/end events from JSON; the schema leaves out ``args``."""
    raw = spark.read.schema(schemas.TRACE_EVENT).json(path)
    return raw.withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def read_parameters(
    spark: SparkSession, path: str, schema: str = schemas.PARAMETERS, condition: dict | None = None,
    *, whole: bool = False,
) -> DataFrame:
    """Documents equal to ``condition`` in each named field; their parameters.

    ``whole`` returns the documents themselves.
    """
    documents = spark.read.schema(schema).json(path)
    for field, value in (condition or {}).items():
        documents = documents.where(F.col(field) == F.lit(value))
    return documents if whole else documents.select("parameters")


def append_documents(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.ASSIGNMENTS)
        .option("header", True)
        .csv(path)
        .withColumnRenamed("input", "input_id")
    )


def archetype_lookup(assignments: DataFrame, choose: str = "last") -> DataFrame:
    """One archetype per run: of its last listed path, or of rank 1.

    Paths are listed in rank order, so the highest rank is the last row.
    """
    key = ["program", "input_id", "iteration"]
    if choose == "rank1":
        assignments = assignments.where(F.col("path_rank") == 1)
    return assignments.groupBy(*key).agg(F.max_by("archetype", "path_rank").alias("archetype"))


def write_assignments(df: DataFrame, path: str) -> None:
    columns = ["program", F.col("input_id").alias("input"), "iteration", "path_rank", "archetype"]
    df.select(*columns).write.option("header", True).csv(path)


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result table as JSON lines or as CSV with a header."""
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(path)


def summary_document(most: int = 10_000, **tables: DataFrame) -> Column:
    """Small result tables folded into one struct of arrays, for a JSON summary.

    A table of more than ``most`` rows is an error: it belongs in files of its own.
    """

    def folded(name: str, table: DataFrame) -> Column:
        rows = table.limit(most + 1).agg(F.collect_list(F.struct(*table.columns))).scalar()
        too_many = F.raise_error(F.lit(f"{name} has more than {most} rows"))
        return F.when(F.size(rows) <= most, rows).otherwise(too_many).alias(name)

    return F.struct(*[folded(name, table) for name, table in tables.items()])


def write_summary(spark: SparkSession, root: str, file: str, **tables: DataFrame) -> None:
    """The summary of ``tables`` as one JSON document under its exact name."""
    document = F.to_json(summary_document(**tables), {"ignoreNullFields": "false"})
    write_files(spark.range(1).select(F.lit(file).alias("path"), document.alias("content")), root)


def write_detections(detections: DataFrame, root: str) -> None:
    """Scored runs as ``detection_results-<part>.csv``, with the key of each run."""
    names = [column.split()[0] for column in schemas.DETECTIONS.split(", ")]
    truth = F.initcap(F.col("is_regression").cast("string"))
    key = F.concat_ws("_", "program", "input_id", "iteration", truth)
    rows = detections.withColumn("exec_key", key).withColumnRenamed("input_id", "input")
    write_csv_parts(rows.select(*names), root, "detection_results")


def read_detections(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.schema(schemas.DETECTIONS)
        .option("header", True)
        .csv(f"{root}/detection_results-*.csv")
        .withColumnRenamed("input", "input_id")
    )

"""Registered queries that write run folders and read them with the native readers.

Runs are programs, inputs and iterations out of the orders; a document lists
several paths of several functions. One input's documents are cut off in the
middle and another's folder has no number: readers leave both out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import baseline
from ..operators.storage import scratch_path
from ..sources import runs as run_files, tables
from ..sources.committed import write_files
from .bindings import Tables, cents, function_name
from .registry import query
from .views import VIEWS

RUN = "program #input_id #iteration"
BROKEN, UNNUMBERED, INPUTS = 13, 14, 97

VIEWS["n_paths"] = f"""
SELECT *, row_number() OVER (PARTITION BY program, input_id, iteration ORDER BY duration_ns DESC, path_id) AS place
FROM (SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'sqlite' ELSE lower(c_mktsegment) END AS program, o_custkey % {INPUTS} AS input_id,
             o_orderkey % 3 AS iteration, o_orderkey AS path_id, CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ns, o_orderstatus AS status
      FROM orders JOIN customer ON o_custkey = c_custkey) t"""
VIEWS["n_functions"] = """
SELECT p.*, concat(replace(q.p_name, ' ', '_'), '_', replace(q.p_brand, 'Brand#', '')) AS function_name,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS own_ns, CAST(l.l_quantity AS BIGINT) AS children,
       row_number() OVER (PARTITION BY p.path_id ORDER BY l.l_extendedprice, l.l_partkey, l.l_linenumber, l.l_quantity) - 1 AS pos
FROM n_paths p JOIN lineitem l ON l.l_orderkey = p.path_id JOIN part q ON q.p_partkey = l.l_partkey"""
_READ = f"input_id NOT IN ({BROKEN}, {UNNUMBERED})"


def paths(t: Tables) -> DataFrame:
    """Paths with their functions in order."""
    orders, customer = t.table("orders"), t.table("customer")
    segment = F.col("c_mktsegment")
    program = F.when(segment == "HOUSEHOLD", "sqlite").otherwise(F.lower(segment))
    runs = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        program.alias("program"),
        (F.col("o_custkey") % INPUTS).alias("input_id"),
        (F.col("o_orderkey") % 3).alias("iteration"),
        F.col("o_orderkey").alias("path_id"),
        cents(F.col("o_totalprice")).alias("duration_ns"),
        F.col("o_orderstatus").alias("status"),
    )
    part = t.table("part").select("p_partkey", function_name().alias("function_name"))
    line = t.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    functions = line.groupBy(F.col("l_orderkey").alias("path_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "l_extendedprice", "l_partkey", "l_linenumber", "l_quantity", "function_name",
                    cents(F.col("l_extendedprice")).alias("own_ns"),
                )
            )
        ).alias("functions")
    )
    return runs.join(functions, "path_id", "left").withColumn(
        "functions", F.coalesce("functions", F.array())
    )


def file_path(name: Column, kind: str = "input") -> Column:
    """Where a run's file belongs; one input's folder has no number."""
    number = F.when(F.col("input_id") == UNNUMBERED, F.lit("x")).otherwise(F.col("input_id").cast("string"))
    folder = F.concat("program", F.lit(f"_analysis_itself_{kind}"), number)
    return F.concat_ws("/", "program", F.lit("analysis"), folder, F.concat(F.lit("iter-"), "iteration"), name)


def cut_off(content: Column) -> Column:
    """Whole documents but for one input's."""
    half = F.substr(content, F.lit(1), F.floor(F.length(content) / 2).cast("int"))
    return F.when(F.col("input_id") == BROKEN, half).otherwise(content)


def recorded(functions: Column) -> Column:
    """Recorded bottlenecks of a path: every other line item, in path order."""
    total = F.aggregate(functions, F.lit(0).cast("long"), lambda t, f: t + f["own_ns"])
    return F.transform(
        F.filter(functions, lambda f: f["l_linenumber"] % 2 == 0),
        lambda f: F.struct(
            f["function_name"].alias("function"),
            (F.lit(100.0) * f["own_ns"] / total).alias("percentage_of_path"),
        ),
    )


def documents(runs: DataFrame, *, bottlenecks: bool = False, **summary: Column) -> Column:
    def function(f: Column) -> Column:
        return F.struct(
            F.concat(F.lit(" "), f["function_name"]).alias("function_name"),
            f["own_ns"].alias("duration_ns"),
            (f["own_ns"] - f["l_linenumber"]).alias("self_time_ns"),
        )

    def path(p: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("rank"),
            (-p["down"]).alias("critical_duration_ns"),
            F.size(p["functions"]).alias("path_length"),
            F.transform(p["functions"], function).alias("functions"),
            *([recorded(p["functions"]).alias("bottlenecks")] if bottlenecks else []),
        )

    return F.to_json(
        F.struct(
            F.struct(F.size("paths").alias("num_paths_found"), *[c.alias(n) for n, c in summary.items()]).alias("summary"),
            F.transform("paths", path).alias("top_k_critical_paths"),
        )
    )


def grouped(t: Tables, rows: DataFrame) -> DataFrame:
    """One row per run with its paths, longest first."""
    listed = F.struct((-F.col("duration_ns")).alias("down"), "path_id", "functions", "status")
    return rows.groupBy("program", "input_id", "iteration").agg(F.array_sort(F.collect_list(listed)).alias("paths"))


def path_folders(t: Tables, **options: bool) -> str:
    root = scratch_path(t.spark, "runs")
    runs = grouped(t, paths(t))
    name = F.when(F.col("program") == "sqlite", F.lit("critical_paths_with_functions.json")).otherwise(
        F.lit("critical_paths.json")
    )
    write_files(runs.select(file_path(name).alias("path"), cut_off(documents(runs, **options)).alias("content")), root)
    return root


@query(
    "a01_native_path_functions",
    f"{RUN} #path_id #path_rank #pos function_name #duration_ns #self_time_ns",
    f"""SELECT program, input_id, iteration, place - 1 AS path_id, place AS path_rank, f.pos, function_name, own_ns AS duration_ns, self AS self_time_ns
    FROM (SELECT n.*, own_ns - l_linenumber AS self FROM
      (SELECT p.*, concat(replace(q.p_name, ' ', '_'), '_', replace(q.p_brand, 'Brand#', '')) AS function_name, l.l_linenumber,
              CAST(round(l.l_extendedprice * 100) AS BIGINT) AS own_ns,
              row_number() OVER (PARTITION BY p.path_id ORDER BY l.l_extendedprice, l.l_partkey, l.l_linenumber, l.l_quantity) - 1 AS pos
       FROM n_paths p JOIN lineitem l ON l.l_orderkey = p.path_id JOIN part q ON q.p_partkey = l.l_partkey) n) f WHERE {_READ}""",
)
def native_path_functions(t: Tables) -> DataFrame:
    documents_read = run_files.read_critical_paths(t.spark, path_folders(t))
    return run_files.path_function_rows(run_files.path_rows(documents_read))


@query(
    "a11_native_runs_read",
    f"{RUN} #paths",
    f"SELECT program, input_id, iteration, count(*) AS paths FROM n_paths WHERE {_READ} GROUP BY ALL",
)
def native_runs_read(t: Tables) -> DataFrame:
    read = run_files.read_critical_paths(t.spark, path_folders(t))
    return read.withColumn("paths", F.col("summary.num_paths_found"))


@query(
    "a14_native_listing",
    "program #files",
    "SELECT program, count(DISTINCT (input_id, iteration)) AS files FROM n_paths GROUP BY 1",
)
def native_listing(t: Tables) -> DataFrame:
    files = run_files.list_files(t.spark, f"{path_folders(t)}/*/analysis/*/*/critical_paths*.json")
    program = run_files.run_key(F.col("path"))[0]
    return files.where("length > 0").groupBy(program.alias("program")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "h01_native_weighted_duration",
    f"{RUN} ~weighted_duration_ns",
    f"""SELECT program, input_id, iteration, round(CASE WHEN count(*) = 1 OR max(lead) <= 0 THEN max(lead)
      ELSE (max(lead) + coalesce(sum(duration_ns * (1.0::DOUBLE / place)) FILTER (place > 1 AND duration_ns > 0 AND duration_ns <> lead), 0))
        / (1 + coalesce(sum(1.0::DOUBLE / place) FILTER (place > 1 AND duration_ns > 0 AND duration_ns <> lead), 0)) END, 3) AS weighted_duration_ns
    FROM (SELECT *, first(duration_ns) OVER (PARTITION BY program, input_id, iteration ORDER BY place) AS lead FROM n_paths) p
    WHERE {_READ} GROUP BY ALL""",
)
def native_weighted_duration(t: Tables) -> DataFrame:
    read = run_files.read_critical_paths(t.spark, path_folders(t))
    return baseline.weighted_path_duration(
        run_files.path_rows(read).withColumn("is_regression", F.lit(False))
    )


_LINES = """(SELECT p.*, concat(replace(q.p_name, ' ', '_'), '_', replace(q.p_brand, 'Brand#', '')) AS function_name, l.l_linenumber % 2 = 0 AS noted,
      CAST(round(l.l_extendedprice * 100) AS BIGINT) AS own_ns, row_number() OVER (PARTITION BY p.path_id ORDER BY l.l_extendedprice, l.l_partkey, l.l_linenumber, l.l_quantity) AS pos
      FROM n_paths p JOIN lineitem l ON l.l_orderkey = p.path_id JOIN part q ON q.p_partkey = l.l_partkey WHERE place = 1)"""


@query(
    "h02_native_recorded_bottlenecks",
    f"{RUN} #path_length #path_duration_ns bottleneck_function ~bottleneck_percentage",
    f"""SELECT program, input_id, iteration, coalesce(path_length, 0) AS path_length, CASE WHEN floor(weighted) > 0 THEN floor(weighted) ELSE coalesce(longest, 0) END AS path_duration_ns,
      bottleneck_function, coalesce(percentage, 0) AS bottleneck_percentage FROM
    (SELECT program, input_id, iteration, round(CASE WHEN count(*) = 1 OR max(lead) <= 0 THEN max(lead)
      ELSE (max(lead) + coalesce(sum(duration_ns * (1.0::DOUBLE / place)) FILTER (place > 1 AND duration_ns > 0 AND duration_ns <> lead), 0))
        / (1 + coalesce(sum(1.0::DOUBLE / place) FILTER (place > 1 AND duration_ns > 0 AND duration_ns <> lead), 0)) END, 3) AS weighted
      FROM (SELECT *, first(duration_ns) OVER (PARTITION BY program, input_id, iteration ORDER BY place) AS lead FROM n_paths) p WHERE {_READ} GROUP BY ALL) d
    LEFT JOIN (SELECT program, input_id, iteration, count(*) AS path_length, max(own_ns) AS longest, arg_min(function_name, pos) FILTER (noted) AS bottleneck_function,
      100.0::DOUBLE * arg_min(own_ns, pos) FILTER (noted) / sum(own_ns) AS percentage FROM {_LINES} x GROUP BY ALL) f USING (program, input_id, iteration)""",
)
def native_recorded_bottlenecks(t: Tables) -> DataFrame:
    read = run_files.read_critical_paths(t.spark, path_folders(t, bottlenecks=True))
    normal = F.lit(False).alias("is_regression")
    listed = run_files.path_rows(read)
    return baseline.run_features(
        listed.select("*", normal),
        run_files.path_function_rows(listed).select("*", normal),
        run_files.path_bottleneck_rows(listed).select("*", normal),
        listed.select("program", "input_id", "iteration", normal).distinct(),
    )


@query(
    "h11_native_regressions",
    f"{RUN} regression_type #paths",
    f"""SELECT program, input_id, iteration, coalesce(max(CASE WHEN place = 1 AND status <> 'O' THEN status END), 'unknown') AS regression_type, count(*) AS paths
    FROM n_paths WHERE iteration = 0 AND {_READ} GROUP BY program, input_id, iteration""",
)
def native_regressions(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "runs")
    runs = grouped(t, paths(t))
    status = F.col("paths")[0]["status"]
    content = documents(runs, _regression_type=F.when(status != "O", status))
    path = file_path(F.lit("critical_paths.json"), "regression_")
    write_files(runs.select(path.alias("path"), cut_off(content).alias("content")), root)
    read = run_files.read_regressions(t.spark, root)
    return read.withColumn("paths", F.col("summary.num_paths_found"))


@query(
    "a03_native_telemetry",
    f"{RUN} #ts ~cpu ~mem ~disk",
    f"""SELECT program, input_id, iteration, path_id AS ts, duration_ns % 1000 / 10.0 AS cpu, duration_ns AS mem, place AS disk
    FROM n_paths WHERE input_id <> {UNNUMBERED}""",
)
def native_telemetry(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "runs")
    runs = grouped(t, paths(t))
    duration = F.transform("paths", lambda p: -p["down"])
    series = F.struct(
        F.col("paths.path_id").alias("timestamps_ns"),
        F.transform(duration, lambda d: d % 1000 / 10).alias("cpu_usage"),
        F.transform(duration, lambda d: d.cast("double")).alias("memory_usage"),
        F.transform(duration, lambda d, i: (i + 1).cast("double")).alias("disk_usage"),
    )
    content = F.to_json(F.struct(series.alias("time_series")))
    write_files(runs.select(file_path(F.lit("kernel_data.json")).alias("path"), content.alias("content")), root)
    return run_files.telemetry_rows(run_files.read_telemetry(t.spark, root)).where(F.col("input_id").isNotNull())


@query(
    "a04_native_call_stats",
    f"{RUN} function_name #duration_ns #num_children",
    f"SELECT program, input_id, iteration, function_name, own_ns AS duration_ns, children AS num_children FROM n_functions WHERE input_id <> {UNNUMBERED}",
)
def native_call_stats(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "runs")
    calls = paths(t).select("program", "input_id", "iteration", F.explode("functions").alias("f"))
    line = F.concat_ws(",", "f.function_name", F.lit("1"), "f.own_ns", F.lit("0"), F.col("f.l_quantity").cast("long"))
    runs = calls.groupBy("program", "input_id", "iteration").agg(F.collect_list(line).alias("lines"))
    head = "function_name,thread_id,duration_ns,self_time_ns,num_children"
    content = F.concat_ws("\n", F.lit(head), F.array_join("lines", "\n"))
    write_files(runs.select(file_path(F.lit("function_stats.csv")).alias("path"), content.alias("content")), root)
    return run_files.read_call_stats(t.spark, root).where(F.col("input_id").isNotNull())


@query(
    "a02_native_static_metrics",
    "function_name #loc #loops",
    """SELECT function_name, loc, loops FROM (SELECT *, row_number() OVER (PARTITION BY function_name ORDER BY file DESC, p_partkey DESC) AS place
    FROM (SELECT concat(replace(p_name, ' ', '_'), '_', replace(p_brand, 'Brand#', '')) AS function_name, concat('f', CAST(p_partkey % 7 AS VARCHAR), '.json') AS file,
                 p_partkey, p_size AS loc, p_size % 5 AS loops FROM part) f) p WHERE place = 1""",
)
def native_static_metrics(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "static")
    own = F.struct(
        "p_partkey", function_name().alias("name"), F.col("p_size").alias("line_of_codes"),
        (F.col("p_size") % 5).alias("number_of_loops"),
    )
    files = t.table("part").groupBy((F.col("p_partkey") % 7).alias("file")).agg(F.array_sort(F.collect_list(own)).alias("own"))
    content = F.to_json(F.array(F.struct(F.col("file").cast("string").alias("file"), F.col("own").alias("functions"))))
    write_files(files.select(F.concat(F.lit("f"), "file", F.lit(".json")).alias("path"), content.alias("content")), root)
    return tables.flatten_static_metrics(tables.read_static_metrics(t.spark, root))

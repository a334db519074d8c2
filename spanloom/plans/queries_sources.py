"""Registered queries: sources and sinks (A) and scalar expressions (B).

Native files are written from the tables into the shared folder and read back
with the declared schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import names, units
from ..functions.names import IO_CALLS
from ..operators import bookkeeping, calls as call_ops
from ..operators.storage import scratch_path
from ..sources import runs as run_files, schemas, tables
from .bindings import EVENT_KEY, EVENT_RUN, HOUR_NS, Tables
from .queries_ranking import analysis as ranking_analysis
from .registry import query

KEY = "program #input_id #iteration"


def stored(t: Tables, df: DataFrame, kind: str = "json", name: str = "native") -> str:
    """Write a frame as native files and return the folder."""
    path = scratch_path(t.spark, name)
    tables.write_table(df, path, kind)
    return path


def path_documents(t: Tables) -> DataFrame:
    """Critical-path documents, one per timed function so that none can grow."""
    function = F.struct(
        "function_name",
        "duration_ns",
        "self_time_ns",
        F.lit("1").alias("thread_id"),
        F.concat(F.lit("0_"), F.col("start_ns").cast("string")).alias("entry_id"),
        units.iso_format(F.col("start_ns")).alias("start_time"),
        units.iso_format(F.col("end_ns")).alias("end_time"),
    )
    path = F.struct(
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.lit("1").alias("thread_id"),
        F.col("duration_ns").alias("critical_duration_ns"),
        F.col("duration_ns").alias("total_duration_ns"),
        F.lit(1).alias("path_length"),
        F.array(function).alias("functions"),
        F.array(
            F.struct(
                F.col("function_name").alias("function"),
                F.col("duration_ns").alias("total_duration_ns"),
                F.col("self_time_ns"),
                F.lit(100.0).alias("percentage_of_path"),
            )
        ).alias("bottlenecks"),
    )
    return t.event_functions.select(
        *EVENT_KEY,
        F.struct(F.lit(1).alias("num_paths_requested")).alias("summary"),
        F.array(path).alias("top_k_critical_paths"),
        F.array("function_name").alias("executed_functions"),
    )


def read_documents(t: Tables, path: str) -> DataFrame:
    schema = f"program string, input_id long, iteration int, {schemas.CRITICAL_PATHS}"
    return t.spark.read.schema(schema).json(path)


@query(
    "a01_read_critical_paths",
    f"{KEY} #path_rank function_name #duration_ns #self_time_ns #start_ns #end_ns",
    "SELECT *, pos + 1 AS path_rank FROM b_event_functions",
)
def read_critical_paths(t: Tables) -> DataFrame:
    documents = read_documents(t, stored(t, path_documents(t)))
    return run_files.path_function_rows(run_files.path_rows(documents))


@query(
    "a01_path_bottlenecks_and_executed",
    "program #input_id function_name #bottlenecks #executed",
    """SELECT program, input_id, function_name, count(*) AS bottlenecks, count(*) AS executed FROM b_event_functions GROUP BY 1, 2, 3""",
)
def path_bottlenecks_and_executed(t: Tables) -> DataFrame:
    documents = read_documents(t, stored(t, path_documents(t)))
    key = [*EVENT_RUN, "function_name"]
    slow = run_files.path_bottleneck_rows(run_files.path_rows(documents))
    ran = run_files.executed_rows(documents)
    return (
        slow.groupBy(*key).agg(F.count(F.lit(1)).alias("bottlenecks"))
        .join(ran.groupBy(*key).agg(F.count(F.lit(1)).alias("executed")), key, "full")
    )


def static_documents(t: Tables) -> DataFrame:
    part = t.table("part")
    function = F.struct(
        F.concat(
            F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
            F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(" "),
        ).alias("name"),
        F.col("p_size").alias("line_of_codes"),
        (F.col("p_type") == "PROMO").alias("has_io"),
        (F.col("p_size") % 5).alias("number_of_loops"),
        (F.col("p_size") % 3).alias("number_of_nested_loops"),
        (F.col("p_partkey") % 20).cast("int").alias("number_of_calls"),
        F.struct(
            (F.col("p_partkey") % 7).cast("int").alias("number_of_if"),
            (F.col("p_partkey") % 2).cast("int").alias("number_of_switch"),
        ).alias("number_of_branches"),
    )
    return part.select(
        F.col("p_partkey").alias("file_pos"),
        F.col("p_brand").alias("file"),
        F.array(function).alias("functions"),
    )


@query(
    "a02_read_static_metrics",
    "function_name #loc #loops #nested_loops #calls #ifs #switches has_io",
    "SELECT * FROM b_static WHERE program = 'BUILDING'",
)
def read_static_metrics(t: Tables) -> DataFrame:
    path = stored(t, static_documents(t))
    documents = t.spark.read.schema(f"file_pos long, {schemas.STATIC_METRICS}").json(path)
    return tables.flatten_static_metrics(documents)


def telemetry_documents(t: Tables) -> DataFrame:
    """Parallel arrays of a run's day: at most 24 hourly samples."""
    day = F.col("ts") - F.col("ts") % (24 * HOUR_NS)
    samples = F.array_sort(F.collect_list(F.struct("ts", "cpu", "mem", "disk")))
    series = F.struct(
        F.col("_s.ts").alias("timestamps_ns"),
        F.col("_s.cpu").alias("cpu_usage"),
        F.col("_s.mem").alias("memory_usage"),
        F.col("_s.disk").alias("disk_usage"),
    )
    return (
        t.telemetry.groupBy(*EVENT_RUN, day.alias("day"))
        .agg(samples.alias("_s"))
        .select(*EVENT_RUN, series.alias("time_series"))
    )


@query("a03_read_telemetry", "program #input_id #ts ~cpu ~mem ~disk", "b_telemetry")
def read_telemetry(t: Tables) -> DataFrame:
    path = stored(t, telemetry_documents(t))
    documents = t.spark.read.schema(f"program string, input_id long, {schemas.TELEMETRY}").json(path)
    return run_files.telemetry_rows(documents, EVENT_RUN)


@query(
    "a04_read_call_stats",
    "function_name #calls #duration_ns #self_time_ns #children",
    """SELECT function_name, count(*) AS calls, sum(duration_ns) AS duration_ns, sum(self_time_ns) AS self_time_ns, sum(io) AS children
    FROM b_calls GROUP BY 1""",
)
def read_call_stats(t: Tables) -> DataFrame:
    rows = t.calls.select(
        "function_name",
        F.col("input_id").cast("string").alias("thread_id"),
        "duration_ns",
        "self_time_ns",
        F.col("io").alias("num_children"),
    )
    path = stored(t, rows, "csv")
    read = t.spark.read.schema(schemas.CALL_STATS).option("header", True).csv(path)
    return read.groupBy("function_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("duration_ns").alias("duration_ns"),
        F.sum("self_time_ns").alias("self_time_ns"),
        F.sum("num_children").alias("children"),
    )


@query(
    "a05_clean_trace_events",
    "#run ph #ts #tid name",
    "SELECT run, ph, ts, CASE WHEN tid % 2 = 0 THEN tid ELSE pid END AS tid, name FROM b_trace_events",
)
def clean_trace_events(t: Tables) -> DataFrame:
    events = t.trace_events.select(
        "run",
        "ph",
        "ts",
        "pid",
        F.when(F.col("tid") % 2 == 0, F.col("tid")).alias("tid"),
        "name",
        F.struct(F.col("seq").alias("x")).alias("args"),
    )
    marks = events.where(F.col("ph") == "B").withColumn("ph", F.lit("M"))
    path = stored(t, events.unionByName(marks))
    raw = t.spark.read.schema(f"run int, {schemas.TRACE_EVENT}").json(path)
    return call_ops.clean_events(raw)


@query(
    "a06_read_parameters",
    "status priority #order_key",
    """SELECT o_orderstatus AS status, o_orderpriority AS priority, o_orderkey AS order_key FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'P'""",
)
def read_parameters(t: Tables) -> DataFrame:
    orders, customer = t.table("orders"), t.table("customer")
    documents = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("program"),
        F.when(F.col("o_orderstatus") == "P", "regression").otherwise("analysis").alias("build"),
        F.create_map(
            F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority",
            F.lit("order_key"), F.col("o_orderkey").cast("string"),
        ).alias("parameters"),
    )
    found = tables.read_parameters(
        t.spark, stored(t, documents), condition={"program": "BUILDING", "build": "analysis"}
    )
    return found.select(
        *[F.col("parameters")[k].alias(k) for k in ("status", "priority", "order_key")]
    )


@query(
    "a07_append_documents",
    "#o_orderkey o_orderstatus #copies",
    "SELECT o_orderkey, o_orderstatus, 2 AS copies FROM orders",
)
def append_documents(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "documents")
    documents = t.table("orders").select("o_orderkey", "o_orderstatus")
    for _ in range(2):
        tables.append_documents(documents, path)
    read = t.spark.read.schema(documents.schema).json(path)
    return read.groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("copies"))


def assignments(t: Tables) -> DataFrame:
    return t.vectors.select(*EVENT_KEY, "path_rank", F.col("label").alias("archetype"))


def stored_assignments(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "assignments")
    tables.write_assignments(assignments(t), path)
    return tables.read_assignments(t.spark, path)


_LOOKUP = "SELECT program, input_id, iteration, {f}(label, path_rank) AS archetype FROM g_rows GROUP BY 1, 2, 3"


@query("a08_archetype_lookup_last", f"{KEY} #archetype", _LOOKUP.format(f="max_by"))
def archetype_lookup_last(t: Tables) -> DataFrame:
    return tables.archetype_lookup(stored_assignments(t))


@query("a08_archetype_lookup_rank1", f"{KEY} #archetype", _LOOKUP.format(f="min_by") + " HAVING min(path_rank) = 1")
def archetype_lookup_rank1(t: Tables) -> DataFrame:
    return tables.archetype_lookup(stored_assignments(t), "rank1")


@query(
    "a09_write_assignments",
    f"{KEY} #path_rank #archetype",
    "SELECT *, label AS archetype FROM g_rows",
)
def write_assignments(t: Tables) -> DataFrame:
    return stored_assignments(t)


@query(
    "a10_write_result_tables",
    "program #simple_but_critical #complex_but_irrelevant #matched #total_functions",
    """SELECT program, count(*) FILTER (category = 'simple_but_critical') AS simple_but_critical,
    count(*) FILTER (category = 'complex_but_irrelevant') AS complex_but_irrelevant,
    count(*) FILTER (category = 'matched') AS matched, count(*) AS total_functions FROM f_classified GROUP BY 1""",
)
def write_result_tables(t: Tables) -> DataFrame:
    counts = ranking_analysis(t).counts
    path = stored(t, counts, "csv")
    return t.spark.read.schema(counts.schema).option("header", True).csv(path)


@query(
    "a11_complete_runs",
    KEY,
    """SELECT DISTINCT program, input_id, iteration FROM b_event_functions WHERE input_id % 13 <> 0
    INTERSECT SELECT program, input_id, iteration FROM b_event_functions WHERE function_name = 'purchase'""",
)
def complete_runs(t: Tables) -> DataFrame:
    functions = t.event_functions
    paths = functions.select(*EVENT_KEY).distinct().withColumn(
        "top_k_critical_paths", F.when(F.col("input_id") % 13 != 0, F.array("program"))
    )
    return bookkeeping.complete_runs(paths, functions.where(F.col("function_name") == "purchase"))


@query(
    "a12_missing_iterations",
    KEY,
    """SELECT program, input_id, i AS iteration FROM (SELECT DISTINCT program, input_id FROM b_paths) p, (VALUES (0), (1), (2)) v(i)
    EXCEPT SELECT program, input_id, iteration FROM b_paths WHERE NOT is_regression""",
)
def missing_iterations(t: Tables) -> DataFrame:
    return bookkeeping.missing_iterations(t.paths, t.paths.where(~F.col("is_regression")))


@query(
    "a13_pending_work",
    KEY,
    """WITH o AS (SELECT program, input_id, iteration, CASE WHEN path_rank <= 2 THEN 'paths' ELSE 'telemetry' END AS kind
                 FROM b_paths WHERE critical_duration_ns % 3 > 0)
    SELECT DISTINCT program, input_id, iteration FROM b_paths r
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT program, input_id, iteration FROM o GROUP BY ALL HAVING count(DISTINCT kind) = 2) d
                      WHERE d.program = r.program AND d.input_id = r.input_id AND d.iteration = r.iteration)
      AND NOT EXISTS (SELECT 1 FROM o WHERE kind = 'paths' AND iteration = 2 AND o.program = r.program AND o.input_id = r.input_id)""",
)
def pending_work(t: Tables) -> DataFrame:
    outputs = t.paths.select(
        *EVENT_KEY,
        F.when(F.col("path_rank") <= 2, "paths").otherwise("telemetry").alias("kind"),
        (F.col("critical_duration_ns") % 3).alias("size"),
    )
    return bookkeeping.pending_work(t.paths.select(*EVENT_KEY).distinct(), outputs)


@query(
    "a14_size_gate",
    "source lang #total_bytes",
    "SELECT source, lang, sum(n_chars) AS total_bytes FROM documents GROUP BY 1, 2 HAVING sum(n_chars) <= 20000",
)
def size_gate(t: Tables) -> DataFrame:
    files = t.table("documents").withColumnRenamed("n_chars", "length")
    return bookkeeping.size_gate(files, ["source", "lang"], 20_000)


# --- scalar expressions --------------------------------------------------------------

_SPACE = names.SPACE_CLASS
_STRIP_SQL = rf"regexp_replace(text, '\A{_SPACE}+|{_SPACE}+\z', '', 'g')"


@query(
    "b01_clean_name",
    "#doc_id stripped lowered #kept",
    f"""SELECT doc_id, md5({_STRIP_SQL}) AS stripped, md5(lower({_STRIP_SQL})) AS lowered, length({_STRIP_SQL}) AS kept FROM documents""",
)
def clean_name(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.table("documents").select(
        "doc_id",
        F.md5(names.clean_name(text)).alias("stripped"),
        F.md5(names.clean_name(text, lower=True)).alias("lowered"),
        F.length(names.clean_name(text)).alias("kept"),
    )


@query(
    "b02_canonical_suffix",
    "#p_partkey name",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat(p_name, '_noDict_', p_type, '_noDict_generic')
    WHEN p_size % 3 = 1 THEN concat(p_brand, '_noDict_generic') ELSE concat(p_name, '_noDict') END AS name FROM part""",
)
def canonical_suffix(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 3
    name = (
        F.when(kind == 0, F.concat_ws("_noDict_", "p_name", "p_type", "p_brand"))
        .when(kind == 1, F.concat_ws("_noDict_", "p_brand", "p_type"))
        .otherwise(F.concat("p_name", F.lit("_noDict")))
    )
    return t.table("part").select("p_partkey", names.canonical_suffix(name).alias("name"))


@query("b03_iso_to_ns", "#event_id #ns", "SELECT event_id, epoch_us(ts) * 1000 AS ns FROM events")
def iso_to_ns(t: Tables) -> DataFrame:
    # The cast drops trailing zeros, so fractions have any length up to six digits.
    stamp = F.translate(F.col("ts").cast("string"), " ", "T")
    return t.table("events").select("event_id", units.iso_to_ns(stamp).alias("ns"))


@query(
    "b04_simple_function_name",
    "#p_partkey name",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_type ELSE split_part(p_name, ' ', 1) END AS name FROM part""",
)
def simple_function_name(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 3
    scoped = F.concat(F.replace("p_name", F.lit(" "), F.lit("::")), F.lit("(int a, std::string b)"))
    pointer = F.concat(F.lit("static const char **"), "p_type", F.lit("(void)"))
    first = F.concat(F.lit("unsigned  "), F.substring_index("p_name", " ", 1), F.lit(" "))
    signature = F.when(kind == 0, scoped).when(kind == 1, pointer).otherwise(first)
    return t.table("part").select("p_partkey", names.simple_function_name(signature).alias("name"))


@query(
    "b05_squash_whitespace",
    "#doc_id squashed #kept",
    rf"""SELECT doc_id, md5(s) AS squashed, length(s) AS kept FROM
    (SELECT doc_id, regexp_replace(regexp_replace({_STRIP_SQL}, '[\n\t]', '', 'g'), ' +', ' ', 'g') AS s FROM documents) d""",
)
def squash_whitespace(t: Tables) -> DataFrame:
    squashed = names.squash_whitespace(F.col("text"))
    return t.table("documents").select(
        "doc_id", F.md5(squashed).alias("squashed"), F.length(squashed).alias("kept")
    )


@query(
    "b06_name_prefix",
    "#p_partkey short long",
    """SELECT p_partkey, substr(p_type, 1, 5) AS short, split_part(replace(p_name, ' ', '_'), '_', 1) AS long FROM part""",
)
def name_prefix(t: Tables) -> DataFrame:
    return t.table("part").select(
        "p_partkey",
        names.name_prefix(F.col("p_type")).alias("short"),
        names.name_prefix(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("long"),
    )


@query(
    "b07_id_from_path",
    "#page_id #id #sort_key",
    r"""SELECT page_id, TRY_CAST(regexp_extract(url, '(\d+)/*$', 1) AS INTEGER) AS id,
    coalesce(TRY_CAST(regexp_extract(url, '(\d+)/*$', 1) AS INTEGER), 999999) AS sort_key FROM pages""",
)
def id_from_path(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.table("pages").select(
        "page_id", names.id_from_path(url).alias("id"), names.path_sort_key(url).alias("sort_key")
    )


_IO_LIST = ", ".join(f"'{n}'" for n in IO_CALLS)


@query(
    "b08_is_io_call",
    "callee is_io #elements",
    f"SELECT callee, callee IN ({_IO_LIST}) AS is_io, count(*) AS elements FROM b_elements GROUP BY 1, 2",
)
def is_io_call(t: Tables) -> DataFrame:
    flagged = t.elements.select("callee", names.is_io_call(F.col("callee")).alias("is_io"))
    return flagged.groupBy("callee", "is_io").agg(F.count(F.lit(1)).alias("elements"))


@query(
    "b09_unit_scale",
    "#path_id ^mb ^ms",
    "SELECT path_id, critical_duration_ns / 1e6 AS mb, abs(-critical_duration_ns / 1e6) AS ms FROM b_paths",
)
def unit_scale(t: Tables) -> DataFrame:
    size = F.col("critical_duration_ns")
    return t.paths.select(
        "path_id", units.bytes_to_mb(size).alias("mb"), units.ns_to_ms(-size, absolute=True).alias("ms")
    )


@query(
    "b10_human_size",
    "#doc_id size",
    """SELECT doc_id, CASE WHEN n >= 1099511627776 THEN concat(round_even(n / 1099511627776.0::DOUBLE, 2), ' TB')
      WHEN n >= 1073741824 THEN concat(round_even(n / 1073741824.0::DOUBLE, 2), ' GB') WHEN n >= 1048576 THEN concat(round_even(n / 1048576.0::DOUBLE, 2), ' MB')
      WHEN n >= 1024 THEN concat(round_even(n / 1024.0::DOUBLE, 2), ' KB') WHEN n >= 1 THEN concat(round_even(n / 1.0::DOUBLE, 2), ' B') ELSE '0B' END AS size
    FROM (SELECT doc_id, (n_chars ** (doc_id % 4))::BIGINT * (doc_id % 50) AS n FROM documents) d""",
)
def human_size(t: Tables) -> DataFrame:
    power = F.pow("n_chars", F.col("doc_id") % 4).cast("long")
    size = power * (F.col("doc_id") % 50)
    return t.table("documents").select("doc_id", units.human_size(size).alias("size"))


@query(
    "b11_md5_bucket",
    "#doc_id #bucket",
    "SELECT doc_id, CAST('0x' || right(md5(text), 8) AS BIGINT) AS bucket FROM documents",
)
def md5_bucket(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", units.md5_bucket(F.col("text")).alias("bucket"))


@query(
    "b12_function_filter",
    "function_name #calls",
    """SELECT function_name, count(*) AS calls FROM b_calls
    WHERE lower(function_name) IN (SELECT lower(function_name) FROM b_static WHERE has_io) GROUP BY 1""",
)
def function_filter(t: Tables) -> DataFrame:
    wanted = t.static.where("has_io").select(F.upper("function_name").alias("name"))
    kept = names.function_filter(t.calls, "function_name", wanted)
    return kept.groupBy("function_name").agg(F.count(F.lit(1)).alias("calls"))


@query(
    "b13_iso_format",
    "#event_id stamp",
    """SELECT event_id, concat(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S'),
       CASE WHEN event_id % 3 = 0 THEN strftime(ts, '.%f') WHEN event_id % 3 = 1 THEN concat(strftime(ts, '.%f'), '001') ELSE '' END) AS stamp FROM events""",
)
def iso_format(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    ns = (
        F.when(kind == 0, F.col("ts_ns"))
        .when(kind == 1, F.col("ts_ns") + 1)
        .otherwise(F.col("ts_ns") - F.pmod("ts_ns", F.lit(units.NANOS)))
    )
    return t.events.select("event_id", units.iso_format(ns).alias("stamp"))

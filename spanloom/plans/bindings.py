"""The driver's star-schema and event tables seen as execution traces.

Orders are critical paths, line items the functions on them, customers the
inputs and market segments the programs; parts carry static metrics. Events are
timed path functions, and hourly sums of them are telemetry. Nothing is
filtered: every row of the tables takes part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.units import epoch_ns
from ..operators.ordered import numbered
from ..operators.storage import written_counted

# The market segments, used as program names.
PROGRAMS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGRESSION_TYPES = (
    "duration_increase",
    "new_function",
    "archetype_shift",
    "resource_spike",
    "path_elongation",
)
HOUR_NS = 3_600_000_000_000
WEEK_NS = 7 * 24 * HOUR_NS
EVENT_KEY = ["program", "input_id", "iteration"]
EVENT_RUN = ["program", "input_id"]
# Thread time unit that separates the customers of a nation on its time line.
SPAN = 10_000_000_000


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def function_name() -> Column:
    return F.concat(
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.lit("_"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")),
    )


class Tables:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def paths(self) -> DataFrame:
        """One critical path per order."""
        orders, customer = self.table("orders"), self.table("customer")
        injected = F.col("o_orderstatus") == "P"
        types = F.array(*[F.lit(t) for t in REGRESSION_TYPES])
        return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            F.col("c_mktsegment").alias("program"),
            F.col("o_custkey").alias("input_id"),
            (F.col("o_orderkey") % 3).cast("int").alias("iteration"),
            injected.alias("is_regression"),
            F.when(injected, F.get(types, (F.col("o_custkey") % 5).cast("int"))).alias(
                "regression_type"
            ),
            F.col("o_orderkey").alias("path_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("path_rank"),
            cents(F.col("o_totalprice")).alias("critical_duration_ns"),
            (F.col("o_custkey") % 7).cast("int").alias("archetype"),
        )

    def _functions(self, items: DataFrame) -> DataFrame:
        # Names are built once per part, not once per line item.
        part = self.table("part").select("p_partkey", function_name().alias("function_name"))
        duration = cents(F.col("l_extendedprice"))
        position = [F.col("pos")] if "pos" in items.columns else []
        return (
            items.join(part, items.l_partkey == part.p_partkey)
            .join(self.paths, items.l_orderkey == F.col("path_id"))
            .select(
                "program",
                "input_id",
                "iteration",
                "is_regression",
                "path_id",
                "path_rank",
                *position,
                "function_name",
                duration.alias("duration_ns"),
                (duration - 10 * cents(F.col("l_tax"))).alias("self_time_ns"),
                F.col("l_quantity").cast("long").alias("cpu"),
                cents(F.col("l_discount")).alias("io"),
                (F.col("l_returnflag") == "R").alias("on_path"),
                (cents(F.col("l_discount")) >= 9).alias("is_bottleneck"),
            )
        )

    @cached_property
    def calls(self) -> DataFrame:
        """One function per line item, without its place on the path."""
        return self._functions(self.table("lineitem"))

    @cached_property
    def _placed_items(self) -> DataFrame:
        """Line items with ``pos``, their place on the path."""
        order = [
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
            "l_quantity",
            "l_shipdate",
        ]
        items = self.table("lineitem").select(
            "l_orderkey", *order, "l_discount", "l_tax", "l_returnflag"
        )
        placed = numbered(items, ["l_orderkey"], order, "_place")
        return placed.withColumn("pos", F.col("_place") - 1)

    @cached_property
    def path_functions(self) -> DataFrame:
        """One function per line item with ``pos``, its place on the path."""
        return self._functions(self._placed_items)

    def path_items(self, paths: DataFrame) -> DataFrame:
        """``path_functions`` by ``function_key``, without names, with all columns of ``paths``.

        Line items meet paths where they are numbered, by order, and no name moves
        with them. Those of an unknown part have no function: their keys are looked
        for first, and nothing is joined if there are none.
        """
        keys = self.table("lineitem").select(F.col("l_partkey").alias("function_key")).distinct()
        known = self.named_parts.select("function_key")
        unknown, some = written_counted(
            keys.where(F.col("function_key").isNotNull()).join(known, "function_key", "left_anti"), "unknown-parts"
        )
        duration = cents(F.col("l_extendedprice"))
        items = self._placed_items.where(F.col("l_partkey").isNotNull()).select(
            F.col("l_orderkey").alias("path_id"),
            "pos",
            F.col("l_partkey").alias("function_key"),
            duration.alias("duration_ns"),
            (duration - 10 * cents(F.col("l_tax"))).alias("self_time_ns"),
            F.col("l_quantity").cast("long").alias("cpu"),
            cents(F.col("l_discount")).alias("io"),
        )
        joined = items.join(paths, "path_id")
        return joined.join(unknown, "function_key", "left_anti") if some else joined

    @cached_property
    def named_parts(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("function_key"), function_name().alias("function_name"))

    @cached_property
    def static(self) -> DataFrame:
        """Static metrics per program and function; the last part of a name counts."""
        part = self.table("part")
        kind = F.col("p_type")
        metrics = F.struct(
            F.col("p_size").alias("loc"),
            (F.col("p_size") % 5).alias("loops"),
            (F.col("p_size") % 3).alias("nested_loops"),
            (F.col("p_partkey") % 20).cast("int").alias("calls"),
            (F.col("p_partkey") % 7).cast("int").alias("ifs"),
            (F.col("p_partkey") % 2).cast("int").alias("switches"),
            (kind == "PROMO").alias("has_io"),
            F.when(kind.isin("STANDARD", "ECONOMY"), "CPU-bound")
            .when(kind.isin("MEDIUM", "SMALL"), "Memory-bound")
            .when(kind == "LARGE", "I/O-bound")
            .otherwise("Unknown")
            .alias("function_type"),
        )
        last = part.groupBy(function_name().alias("function_name")).agg(
            F.max_by(metrics, "p_partkey").alias("_m")
        )
        programs = F.array(*[F.lit(p) for p in PROGRAMS])
        return last.select(F.explode(programs).alias("program"), "function_name", "_m.*")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts_ns", epoch_ns(F.col("ts")))

    @cached_property
    def event_functions(self) -> DataFrame:
        """Timed path functions: a path per user and week."""
        week = F.call_function("div", F.col("ts_ns"), F.lit(WEEK_NS)).cast("int")
        keyed = self.events.select(
            F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("program"),
            F.col("user_id").alias("input_id"),
            week.alias("iteration"),
            "ts_ns",
            "event_id",
            "event_type",
            (cents(F.col("value")) * 10_000_000).alias("duration_ns"),
        )
        placed = numbered(keyed, EVENT_KEY, ["ts_ns", "event_id"], "_place")
        kind = F.col("event_type")
        return placed.select(
            *EVENT_KEY,
            (F.col("_place") - 1).alias("pos"),
            kind.alias("function_name"),
            "duration_ns",
            (F.col("duration_ns") - F.call_function("div", F.col("duration_ns"), F.lit(4))).alias(
                "self_time_ns"
            ),
            F.col("ts_ns").alias("start_ns"),
            (F.col("ts_ns") + F.col("duration_ns")).alias("end_ns"),
            F.when(kind == "click", "CPU-bound")
            .when(kind == "view", "Memory-bound")
            .when(kind == "purchase", "I/O-bound")
            .otherwise("Unknown")
            .alias("function_type"),
        )

    @cached_property
    def event_static(self) -> DataFrame:
        """Static metrics of event types, one entry per program."""
        kinds = self.events.groupBy(
            F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("program"),
            F.col("event_type").alias("function_name"),
        ).agg(F.count(F.lit(1)).alias("_n"))
        size = F.length("function_name")
        return kinds.where(F.col("function_name") != "error").select(
            "program",
            "function_name",
            (size * 10 + F.col("_n") % 10).alias("loc"),
            (size % 4).alias("loops"),
            (size % 3).alias("nested_loops"),
            (F.col("_n") % 5).alias("calls"),
        )

    @cached_property
    def telemetry(self) -> DataFrame:
        """Hourly samples per run (a user): cpu, memory and disk."""
        hour = F.col("ts_ns") - F.col("ts_ns") % HOUR_NS
        amount = cents(F.col("value"))
        busy = F.max(F.when(F.col("event_type").isin("click", "view"), amount))
        written = F.sum(F.when(F.col("event_type") == "purchase", amount).otherwise(F.lit(0)))
        return self.events.groupBy(
            F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("program"),
            F.col("user_id").alias("input_id"),
            hour.alias("ts"),
        ).agg(
            (F.coalesce(busy, F.lit(0)) / 100).alias("cpu"),
            (F.sum(amount) * 10_000).cast("double").alias("mem"),
            (written * 10_000).cast("double").alias("disk"),
        )

    @cached_property
    def long_series(self) -> DataFrame:
        """One row per event as a named metric of its program."""
        kind = F.col("event_type")
        return self.events.select(
            F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("program"),
            F.col("ts_ns").alias("ts"),
            F.when(kind.isin("click", "view"), "cpu")
            .when(kind == "purchase", "disk")
            .otherwise("mem")
            .alias("metric"),
            cents(F.col("value")).cast("double").alias("value"),
        )

    @cached_property
    def trace_events(self) -> DataFrame:
        """Begin/end events of nation -> customer -> order, one thread per nation."""
        orders, customer = self.table("orders"), self.table("customer")
        joined = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            (F.col("c_nationkey") % 5).cast("int").alias("run"),
            F.col("c_nationkey").cast("long").alias("tid"),
            "c_custkey",
            "o_orderkey",
        )
        thread = ["run", "tid"]

        def edges(df: DataFrame, begin: Column, end: Column, name: Column) -> DataFrame:
            pair = F.array(
                F.struct(F.lit("B").alias("ph"), begin.cast("long").alias("ts")),
                F.struct(F.lit("E").alias("ph"), end.cast("long").alias("ts")),
            )
            return df.select(*thread, name.alias("name"), F.inline(pair))

        base = F.col("c_custkey") * SPAN
        first = base + 10 * F.col("o_orderkey")
        leaves = edges(
            joined,
            first + 2,
            first + 3 + F.col("o_orderkey") % 6,
            F.concat(F.lit("order_"), (F.col("o_orderkey") % 50).cast("string")),
        )
        per_customer = joined.groupBy(*thread, "c_custkey").agg(
            F.min("o_orderkey").alias("_lo"), F.max("o_orderkey").alias("_hi")
        )
        middle = edges(
            per_customer,
            base + 10 * F.col("_lo") + 1,
            base + 10 * F.col("_hi") + 9,
            F.concat(F.lit("cust_"), (F.col("c_custkey") % 20).cast("string")),
        )
        per_thread = per_customer.groupBy(*thread).agg(
            F.min(base + 10 * F.col("_lo")).alias("_lo"),
            F.max(base + 10 * F.col("_hi")).alias("_hi"),
        )
        roots = edges(per_thread, F.col("_lo"), F.col("_hi") + 10, F.lit("main"))
        return (
            leaves.unionByName(middle)
            .unionByName(roots)
            .withColumns({"seq": F.col("ts"), "pid": F.lit(1).cast("long")})
        )

    @cached_property
    def elements(self) -> DataFrame:
        """Parsed elements: a function per path, parents as in a binary heap."""
        tags = ("for", "while", "if", "else", "call", "block", "expr_stmt", "switch")
        tag = F.get(F.array(*[F.lit(t) for t in tags]), (F.col("duration_ns") % 8).cast("int"))
        own = F.concat(F.lit("fn_"), (F.col("path_id") % 400).cast("string"))
        io_names = F.array(F.lit("printf"), F.lit("fopen"), F.lit("helper"))
        callee = F.when(
            F.col("duration_ns") % 5 == 0, F.get(io_names, (F.col("self_time_ns") % 3).cast("int"))
        ).otherwise(F.concat(F.lit("fn_"), (F.col("duration_ns") % 400).cast("string")))
        extensions = F.array(F.lit(".c"), F.lit(".h"), F.lit(".cpp"), F.lit(".txt"))
        file = F.concat(
            F.lit("src/f"),
            F.col("input_id").cast("string"),
            F.get(extensions, (F.col("input_id") % 4).cast("int")),
        )
        return self.path_functions.select(
            file.alias("file"),
            F.col("path_id").alias("function_id"),
            own.alias("function_name"),
            F.col("pos").alias("element_id"),
            F.when(F.col("pos") > 0, F.floor((F.col("pos") - 1) / 2)).alias("parent_id"),
            tag.alias("tag"),
            callee.alias("callee"),
            F.when(F.col("duration_ns") % 3 == 0, ";").otherwise("").alias("text"),
            (F.col("self_time_ns") % 4 == 0).alias("in_control"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings as path vectors with run columns."""
        v = F.col("vec_id")
        return self.table("embeddings").select(
            "vec_id",
            F.concat(F.lit("p"), (v % 4).cast("string")).alias("program"),
            F.floor(v / 24).alias("input_id"),
            (F.floor(v / 8) % 3).cast("int").alias("iteration"),
            (F.floor(v / 4) % 2 + 1).cast("int").alias("path_rank"),
            (F.floor(v / 4) % 2).cast("int").alias("path_idx"),
            F.col("label"),
            (v * 1_000_000 + F.col("label") * 7).alias("path_duration_ns"),
            (F.col("label") + 5).alias("path_length"),
            F.col("embedding").cast("array<double>").alias("features"),
        )

    @cached_property
    def executions(self) -> DataFrame:
        """Orders as program executions that may fail."""
        return self.table("orders").select(
            F.when(F.col("o_orderstatus") == "P", "regression").otherwise("analysis").alias("type"),
            F.concat(
                F.lit("range-"), F.substring("o_orderpriority", 1, 1)
            ).alias("range"),
            F.col("o_orderkey").alias("input"),
            (cents(F.col("o_totalprice")) / 100).alias("seconds"),
            (F.col("o_orderkey") % 11 != 0).alias("success"),
        )

"""Static metrics from a table of parsed source elements.

Rows are ``file, function_id, function_name, element_id, parent_id, tag, callee,
text, in_control``; ids are unique within a function, ``callee`` is the name a
call refers to, ``text`` the element's own text and ``in_control`` marks the
contents of a loop's control part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import is_io_call, simple_function_name
from .grouping import chunked_lists
from .storage import written

# Tags that open a loop, and source file endings.
LOOPS = ("for", "while", "do")
EXTENSIONS = (".cpp", ".cxx", ".cc", ".c", ".h", ".hpp", ".hxx")

#: Pointer doublings; they reach 2 ** 40 ancestors, so more of them mean a cycle.
MAX_ROUNDS = 40


def element_counts(elements: DataFrame) -> DataFrame:
    """Parameters, loops, statements and branches per function.

    ``else`` counts as a branch, and the last count adds ``elif`` to both.
    """

    def tagged(*tags: str):
        return F.count_if(F.col("tag").isin(*tags))

    return elements.groupBy("function_id").agg(
        tagged("parameter").alias("parameters"),
        tagged(*LOOPS).alias("loops"),
        tagged("expr_stmt").alias("expression_statements"),
        tagged("decl_stmt").alias("declaration_statements"),
        tagged("empty_stmt").alias("empty_statements"),
        tagged("if", "else").alias("ifs"),
        tagged("switch").alias("switches"),
        tagged("if", "else", "elif").alias("all_branches"),
    )


def nested_loop_pairs(elements: DataFrame) -> DataFrame:
    """Number of (outer, inner) loop pairs at any distance, per function.

    Every element holds a pointer to an ancestor and the number of loops passed
    on the way. Joining each pointer with the pointer it leads to doubles the
    distance, so the rounds grow with the logarithm of the depth and no list of
    ancestors is formed. Each round is written out, which keeps lineage short;
    elements whose pointer has passed the root are looked up from the round that
    finished them and neither moved nor written again.
    """
    is_loop = F.col("tag").isin(*LOOPS).cast("long")
    moved = written(
        elements.select(
            "function_id",
            "element_id",
            is_loop.alias("loop"),
            F.col("parent_id").alias("jump"),
            F.lit(0).cast("long").alias("passed"),
        ),
        "loop-jumps",
    )
    jumps = moved
    finished = moved.where(F.col("jump").isNull())
    # ``passed`` counts loops among ancestors strictly below ``jump``.
    for _ in range(MAX_ROUNDS + 1):
        active = moved.where(F.col("jump").isNotNull())
        if active.isEmpty():
            break
        target = jumps.select(
            "function_id",
            F.col("element_id").alias("jump"),
            F.col("loop").alias("_loop"),
            F.col("passed").alias("_passed"),
            F.col("jump").alias("_next"),
        )
        moved = written(
            active.join(target, ["function_id", "jump"], "left").select(
                "function_id",
                "element_id",
                "loop",
                F.col("_next").alias("jump"),
                (F.col("passed") + F.coalesce(F.col("_loop") + F.col("_passed"), F.lit(0))).alias(
                    "passed"
                ),
            ),
            "loop-jumps",
        )
        jumps = finished.unionByName(moved)
        finished = finished.unionByName(moved.where(F.col("jump").isNull()))
    else:
        raise ValueError("parents of elements form a cycle")
    return jumps.groupBy("function_id").agg(
        F.sum(F.col("loop") * F.col("passed")).alias("nested_loops")
    )


def logical_loc(elements: DataFrame) -> DataFrame:
    """Semicolons outside loop controls plus blocks, less one (so -1 is possible)."""
    semicolons = F.length("text") - F.length(F.replace("text", F.lit(";"), F.lit("")))
    counted = F.when(F.col("in_control"), F.lit(0)).otherwise(semicolons)
    return elements.groupBy("function_id").agg(
        (F.sum(counted) + F.count_if(F.col("tag") == "block") - 1).alias("loc")
    )


def calls_of(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("tag") == "call")


def has_io(elements: DataFrame) -> DataFrame:
    """Does a function call anything in the fixed list of I/O names?"""
    hit = (F.col("tag") == "call") & is_io_call(F.col("callee"))
    return elements.groupBy("function_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("has_io"))


def call_counts(elements: DataFrame) -> DataFrame:
    """Calls per function, and whether it calls its own simple name."""
    is_call = F.col("tag") == "call"
    own = simple_function_name(F.col("callee")) == simple_function_name(F.col("function_name"))
    return elements.groupBy("function_id").agg(
        F.count_if(is_call).alias("calls"),
        F.bool_or(F.coalesce(is_call & own, F.lit(False))).alias("is_recursive"),
    )


def caller_counts(functions: DataFrame, elements: DataFrame) -> DataFrame:
    """Calls to each function's full name from anywhere."""
    incoming = (
        calls_of(elements)
        .groupBy(F.col("callee").alias("function_name"))
        .agg(F.count(F.lit(1)).alias("callers"))
    )
    return functions.join(incoming, "function_name", "left").withColumn(
        "callers", F.coalesce("callers", F.lit(0).cast("long"))
    )


def function_metrics(elements: DataFrame) -> DataFrame:
    """All static metrics, one row per function."""
    functions = elements.groupBy("function_id").agg(
        F.first("file").alias("file"), F.first("function_name").alias("function_name")
    )
    parts = [
        element_counts(elements),
        nested_loop_pairs(elements),
        logical_loc(elements),
        has_io(elements),
        call_counts(elements),
    ]
    metrics = caller_counts(functions, elements)
    for part in parts:
        metrics = metrics.join(part, "function_id")
    return metrics.withColumn("simple_name", simple_function_name(F.col("function_name")))


def functions_by_file(functions: DataFrame, *, per_row: int = 1000) -> DataFrame:
    """Functions nested per source file; other endings are left out.

    ``functions`` has ``file`` and a struct column ``function``. A file with
    many functions is split into parts.
    """
    ending = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    return chunked_lists(
        functions.where(ending.isin(*EXTENSIONS)), ["file"], "function", "functions", per_row=per_row
    )

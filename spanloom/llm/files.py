"""Files of raw bytes on the shared file system, written and read by tasks.

Writing goes through Spark's text writer, whose committer keeps only finished
tasks' files on any Hadoop file system. Reading goes through ``pyarrow.fs``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shuffle_width


def write_files(
    df: DataFrame, path: str, *, file: str, order: Sequence[str], content: str, end: str
) -> None:
    """One file per value of ``file``: its rows' ``content`` by ``order``, each followed by ``end``.

    ``end`` has one character per byte. All rows of a file meet in one task, so
    files must be of bounded size.
    """
    dealt = df.repartition(shuffle_width(df.sparkSession), file)
    append_files(dealt, path, file=file, order=order, content=content, end=end)


def append_files(
    df: DataFrame, path: str, *, file: str, order: Sequence[str], content: str, end: str
) -> None:
    """Like ``write_files`` without moving rows: a task writes those it has of a file to a part of its own."""
    (
        df.select(F.col(file).alias("file"), *order, F.col(content).cast("string").alias("value"))
        .sortWithinPartitions("file", *order)
        .select("file", "value")
        .write.partitionBy("file")
        .option("encoding", "ISO-8859-1")  # of the line separator; contents are written as they are
        .option("lineSep", end)
        .text(path)
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, bytes`` of what ``write_files`` wrote; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"/file=(-?\d+)/", 1).cast("long")
    return found.select(number.alias("file"), "path", F.col("length").alias("bytes"))


@contextmanager
def opened(uri: str):
    """A file for reads at offsets, wherever Spark can write."""
    from pyarrow import fs

    place, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    with place.open_input_file(inside) as f:
        yield f

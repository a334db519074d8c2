"""Expressions for timestamps, units and hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANOS = 1_000_000_000
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def iso_to_ns(stamp: Column) -> Column:
    """ISO timestamp string in UTC, up to nine fraction digits, to epoch ns.

    The whole part goes through a zone-free timestamp so the session time zone
    cannot move it; the fraction is padded on the right, never read as a count.
    """
    whole = F.to_timestamp_ntz(F.translate(F.substring_index(stamp, ".", 1), "T", " "))
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), whole)
    fraction = F.when(
        F.contains(stamp, F.lit(".")),
        F.rpad(F.substring_index(stamp, ".", -1), 9, "0").cast("long"),
    ).otherwise(F.lit(0))
    return seconds * F.lit(NANOS) + fraction


def iso_format(ns: Column) -> Column:
    """Epoch ns to an ISO string: 9 fraction digits, else 6, else none."""
    rest = F.pmod(ns, F.lit(NANOS))
    seconds = F.call_function("div", ns - rest, F.lit(NANOS))
    whole = F.date_format(
        F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")),
        "yyyy-MM-dd'T'HH:mm:ss",
    )
    digits = F.lpad(rest.cast("string"), 9, "0")
    fraction = (
        F.when(rest == 0, F.lit(""))
        .when(rest % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(whole, fraction)


def epoch_ns(stamp: Column) -> Column:
    """TIMESTAMP_NTZ (read as UTC) to epoch nanoseconds."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), stamp)
    return micros * F.lit(1000)


def bytes_to_mb(size: Column) -> Column:
    return size / F.lit(1e6)


def ns_to_ms(ns: Column, *, absolute: bool = False) -> Column:
    ms = ns / F.lit(1e6)
    return F.abs(ms) if absolute else ms


def human_size(size: Column) -> Column:
    """Bytes as text in powers of 1024, two decimals, ``0B`` for nothing."""
    text = None
    for power in range(len(SIZE_UNITS) - 1, -1, -1):
        scaled = F.concat(
            F.bround(size / F.lit(float(1024**power)), 2).cast("string"),
            F.lit(" " + SIZE_UNITS[power]),
        )
        bound = size >= F.lit(1024**power)
        text = F.when(bound, scaled) if text is None else text.when(bound, scaled)
    return text.otherwise(F.lit("0B"))


def md5_bucket(key: Column) -> Column:
    """md5 of a string as an integer modulo 2^32 (its last eight hex digits)."""
    return F.conv(F.right(F.md5(key), F.lit(8)), 16, 10).cast("long")


def unit_interval(key: Column) -> Column:
    """Deterministic pseudo-random number in [0, 1) from a key."""
    return md5_bucket(key) / F.lit(float(1 << 32))

"""WARC archives behind an index: coalesced byte-range reads of selected records.

Every record is a gzip member of its own, as in ``.warc.gz`` files. The index of
offsets, lengths, URLs and digests is computed from the members' sizes and
written before the archives. Reading selects index rows, merges close ranges of
a file into one read, and cuts members out of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.storage import scratch_path, written
from .common import joined_null_safe, shuffle_width, small_batches
from .files import list_files, opened, write_files

END = "\r\n\r\n"
#: An empty gzip member: it stands between records and decompresses to nothing.
BETWEEN = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03" + "\x00" * 9
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this many bytes are stored in full each time.
REVISIT_BYTES = 1000
#: An archive file holds about this many bytes.
FILE_BYTES = 256 << 20
#: Ranges closer than this are read together, up to one read of READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20


def record_id(page_id: Column) -> Column:
    """A URN that holds a 64-bit id; null has a pattern of its own."""
    digits = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    known = F.concat(F.lit("00000000-0000-4000-"), F.substr(digits, F.lit(1), F.lit(4)), F.lit("-"), F.substr(digits, F.lit(5)))
    return F.concat(
        F.lit("<urn:uuid:"), F.coalesce(known, F.lit("00000000-0000-5000-8000-000000000000")), F.lit(">")
    )


def id_of(urn: str) -> int | None:
    """The id in a record's URN."""
    hexed = urn.strip("<>").rpartition(":")[2].replace("-", "")
    if hexed[12] == "5":
        return None
    value = int(hexed[16:], 16)
    return value - (1 << 64) if value >> 63 else value


def _facts(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, digest, refers_to`` of pages whose payload a later page holds too."""
    thin = _facts(pages).select("page_id", "digest", "size").where(F.col("size") >= least)
    last = (
        thin.groupBy("digest", "size")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return (
        thin.join(last.drop("n"), ["digest", "size"])
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Rows with the bytes of a record each: ``page_id, url, digest, record``."""
    links = written(revisits(pages, least), "warc-revisits")
    page = joined_null_safe(_facts(pages), links, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit(END),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(
            again,
            F.concat(F.lit(f"\r\nWARC-Profile: {profile}\r\nWARC-Refers-To: "), record_id(F.col("refers_to"))),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END),
    )
    return page.select("page_id", "url", "digest", F.concat(head, block, F.lit(END)).alias("record"))


def member(record: str) -> bytes:
    """A gzip member, the same for the same record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record.encode("utf-8", "surrogatepass")) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([member(x) for x in batch.column("record").to_pylist()], pa.binary())
        keys = ["file", "page_id", "url", "digest"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), packed], [*keys, "record"])


def write_archive(
    pages: DataFrame, *, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES
) -> tuple[DataFrame, str]:
    """Write ``pages`` (``page_id, url, html``) as WARC files: their index and folder.

    The index has ``file, offset, length, page_id, url, digest``. A null html is
    an empty payload, a null URL an empty target, a null id a record without
    one; repeated rows are records of their own. Of records with equal payloads
    of at least ``least`` bytes the one with the largest id holds the payload.
    Records are dealt to files by hash, so files are even and of bounded size;
    there are at least as many as a shuffle has partitions.
    """
    spark = pages.sparkSession
    small_batches(spark)
    made = records(pages, least)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0  # one row
    files = max(shuffle_width(spark), -(-total // file_bytes))
    made = made.select(F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(files)).alias("file"), "*")
    made = written(
        made.mapInArrow(_members, "file long, page_id long, url string, digest string, record binary"),
        "warc-records",
    )
    order = ["page_id", "url", "digest"]
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    index = (
        made.select("file", *order, F.octet_length("record").cast("long").alias("length"))
        .withColumn("offset", F.coalesce(F.sum(F.col("length") + len(BETWEEN)).over(before), F.lit(0)))
        .select("file", "offset", "length", "page_id", "url", "digest")
    )
    index = written(index, "warc-index")
    path = scratch_path(spark, "warc")
    write_files(made, path, file="file", order=order, content="record", end=BETWEEN)
    return index, path


def byte_ranges(index: DataFrame, *, gap: int = GAP_BYTES, read: int = READ_BYTES) -> DataFrame:
    """Index rows merged into reads: ``file, start, end, records``.

    A read ends at a gap of more than ``gap`` bytes or where the next record
    begins in another window of ``read`` bytes.
    """
    by = Window.partitionBy("file").orderBy("offset")
    last_end = F.lag(F.col("offset") + F.col("length")).over(by)
    last_window = F.lag(F.floor(F.col("offset") / read)).over(by)
    fresh = last_end.isNull() | (F.col("offset") - last_end > gap) | (F.floor(F.col("offset") / read) != last_window)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        index.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_run", F.sum("_fresh").over(upto))
        .groupBy("file", "_run")
        .agg(
            F.min("offset").alias("start"),
            F.max(F.col("offset") + F.col("length")).alias("end"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
        .drop("_run")
    )


READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def parsed(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record and of its HTTP response, and the payload it holds."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    if len(block) != int(named["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {named['WARC-Record-ID']} is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def read_records(index: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of ``index`` rows, read back from the archives below ``path``.

    Each payload is checked against its record's digest. Without ``payloads``
    that column is null.
    """
    spark = index.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for one in batch.to_pylist():
                rows = []
                with opened(one["path"]) as f:
                    chunk = f.read_at(one["end"] - one["start"], one["start"])
                for place in one["records"]:
                    at = place["offset"] - one["start"]
                    named, http, payload = parsed(zlib.decompress(chunk[at : at + place["length"]], 31))
                    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = named["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"record {named['WARC-Record-ID']} has another digest")
                    refers = named.get("WARC-Refers-To")
                    rows.append(
                        {
                            "page_id": id_of(named["WARC-Record-ID"]),
                            "url": named["WARC-Target-URI"],
                            "payload_bytes": int(http["Content-Length"]),
                            "payload_digest": digest,
                            "record_type": kind,
                            "refers_to": id_of(refers) if refers else None,
                            "payload": payload if payloads and kind == "response" else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(READ_SCHEMA))
    ranges = byte_ranges(index).join(list_files(spark, path).select("file", "path"), "file")
    return ranges.select("path", "start", "end", "records").mapInArrow(read, READ_SCHEMA)

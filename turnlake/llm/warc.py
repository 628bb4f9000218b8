"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

The writer puts out WARC/1.1 records through Spark's text sink: the bytes between two records (CR LF CR LF)
are the sink's line separator.  Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the smallest id keeps the payload; the others are revisits that name it.

The reader takes whole archive files (their size is bounded by the writer's ``records_per_file``).  Plain
and member-wise gzipped archives are read.  Where a record fails its checks (version line, headers, length,
terminator, digest, gzip checksum), it searches for the next version line or valid member, whichever is nearer and
whatever the archive began with, goes on from there and reports the bytes between as a quarantined gap.

Null payloads are empty; null ids are allowed (one is never the smallest among others); rows with equal id
and payload are all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.session import scratch_path

from .store import join_counted

MIN_REVISIT = 100
END = "\r\n\r\n"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
MEMBER = b"\x1f\x8b\x08"
_STARTS = re.compile(b"|".join(re.escape(v) for v in (*VERSIONS, MEMBER)))
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Columns id, url, payload, n_bytes, digest, record_type and refers_to per page."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n_bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    repeats = (
        rows.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), "first")
    )
    joined = join_counted(rows, repeats, F.col("digest") == F.col("d"), "left", "warc-repeats")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id", "url", "payload", "n_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_text(row_id: Column, url: Column) -> Column:
    """One record without its final separator; columns as ``plan_records`` names them."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A")
    name = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(VERSION.decode()),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", name(row_id)),
        _header("WARC-Target-URI", clean),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(revisit, F.concat(_header("WARC-Refers-To", name(F.col("refers_to"))), _header("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write(records: DataFrame, path: str, records_per_file: int = 8192) -> None:
    """Write planned records as WARC files below ``path``."""
    records.select(record_text(F.col("id"), F.col("url")).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def parse(data: bytes) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """("record", offset, headers, block) and ("gap", offset, {"bytes": n}, b"") in file order.

    Each place is tried as what it begins with, member or version line; after a failed check the nearer of the next
    ones is tried, whatever the file began with.  A member without any record is part of a gap.
    """
    at, n, gap = 0, len(data), None
    while at < n:
        found, member = _record(data, at), None
        if not found:
            member = _member(data, at)
        if found or (member and (not member[0] or any(kind == "record" for kind, *_ in _parse_plain(member[0], 0)))):
            if gap is not None:
                yield "gap", gap, {"bytes": str(at - gap)}, b""
                gap = None
            if found:
                headers, block, to = found
                yield "record", at, headers, block
            else:
                body, to = member
                yield from ((kind, at, headers, block) for kind, _, headers, block in _parse_plain(body, 0))
            at = to
            continue
        if gap is None:
            gap = at
        ahead = _STARTS.search(data, member[1] if member else at + 1)
        at = ahead.start() if ahead else n
    if gap is not None:
        yield "gap", gap, {"bytes": str(n - gap)}, b""


def _parse_plain(data: bytes, base: int) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    at, n, gap = 0, len(data), None
    while at < n:
        found = _record(data, at)
        if found:
            if gap is not None:
                yield "gap", base + gap, {"bytes": str(at - gap)}, b""
                gap = None
            headers, block, to = found
            yield "record", base + at, headers, block
            at = to
            continue
        if gap is None:
            gap = at
        ahead = [p for p in (data.find(v, at + 1) for v in VERSIONS) if p >= 0]
        at = min(ahead, default=n)
    if gap is not None:
        yield "gap", base + gap, {"bytes": str(n - gap)}, b""


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record at a version line, or None where any check fails."""
    if not data.startswith(VERSIONS, at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[start:end]
    if headers.get("warc-type") == "response":
        method, _, digest = headers.get("warc-payload-digest", "").partition(":")
        if method == "sha256" and hashlib.sha256(block).hexdigest() != digest:
            return None
    return headers, block, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a place, or None where there is no whole and valid one."""
    if not data.startswith(MEMBER, at):
        return None
    inflate, parts, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while at < len(data) and not inflate.eof:
            parts.append(inflate.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), at - len(inflate.unused_data)) if inflate.eof else None


_SCHEMA = (
    "kind string, file string, at long, gap_bytes long, record_id string, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path``; payload is null for revisits and gaps."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def page(value: str | None) -> str | None:
        return value[len("<urn:page:") : -1] if value and value.startswith("<urn:page:") else value

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        for kind, at, h, block in parse(data):
            if kind == "gap":
                yield kind, file, at, int(h["bytes"]), None, None, None, None, None, None, None
                continue
            whole = h.get("warc-type") != "revisit"
            digest = h.get("warc-payload-digest", "").partition(":")[2]
            yield (
                kind, file, at, None, page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"),
                len(block) if whole else int(h.get("x-payload-length", "0") or 0),
                hashlib.sha256(block).hexdigest() if whole else digest, page(h.get("warc-refers-to")), block if whole else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return files.mapInArrow(run, _SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with every revisit's payload taken from the response with the same digest."""
    held = records.where("kind = 'record' and record_type = 'response'").select(
        F.col("payload_digest").alias("_d"), F.col("payload").alias("_p")
    ).dropDuplicates(["_d"])
    wanted = records.where("kind = 'record'").join(held, F.col("payload_digest") == F.col("_d"), "left")
    return wanted.withColumn("payload", F.coalesce("payload", "_p")).drop("_d", "_p")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(plan_records(pages, **names), path)
    return read(spark, path)

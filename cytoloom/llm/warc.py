"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Archives are compressed record by record, one gzip member each, and written by Spark's text writer, so its commit
protocol and any store it knows are used: the writer's line end is an empty gzip member, which stands for no bytes.
A row of the writer is a block of some members, and a file holds at most ``BLOCKS`` blocks of about ``BLOCK`` bytes
(a longer record is a block of its own), as files are read whole as binary.

The reader checks each record (version line, headers, length, closing lines, block digest). After a failed
check it searches for the next gzip member or version line from which a whole valid record can be read, goes
on there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
BLOCK, BLOCKS, STEP = 2 << 20, 16, 1 << 14


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None = None, revisit: bool = False) -> bytes:
    """One response record, or with ``revisit`` one that refers to the response of page ``first``."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(first)}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """``raw`` as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


EMPTY = member(b"")


@dataclass
class Part:
    """A record, or with ``gap`` why these bytes were set aside."""

    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    gap: str = ""


def _parse(raw: bytes, at: int) -> tuple[Part, str]:
    """The record at ``at`` and what is wrong with it; on a fault the length is that of a frame to skip, else 0."""
    if raw[at : at + 7] != b"WARC/1.":
        return Part(at, 0), "no version line"
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return Part(at, 0), "headers without an end"
    headers: dict[str, str] = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return Part(at, 0), "a header line without a colon"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return Part(at, 0), "no content length"
    start = stop + 4
    end = start + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        return Part(at, 0), "the block does not end where its length says"
    whole = end + 4 - at
    block = raw[start:end]
    said = headers.get("warc-block-digest", "")
    if said.lower().startswith("sha1:") and said[5:].upper() != sha1_base32(block):
        framed = raw[end + 4 : end + 11] in (b"WARC/1.", b"")
        return Part(at, whole if framed else 0), "the block digest differs"
    if "warc-type" not in headers or "warc-record-id" not in headers:
        return Part(at, whole), "a required header is missing"
    return Part(at, whole, headers, block), ""


def _at(raw: bytes, at: int) -> tuple[list[Part], int, str]:
    """Records of the version line or gzip member at ``at``, the bytes it takes, and what is wrong."""
    if raw[at : at + 3] != GZIP:
        one, why = _parse(raw, at)
        return ([] if why else [one]), one.length, why
    z, view, stop, parts = zlib.decompressobj(31), memoryview(raw), at, []
    try:
        while stop < len(raw) and not z.eof:  # a step at a time: what follows the member is not copied
            parts.append(z.decompress(view[stop : stop + STEP]))
            stop += STEP
    except zlib.error as e:
        return [], 0, f"damaged gzip member: {e}"
    if not z.eof:
        return [], 0, "gzip member without an end"
    inner, size = b"".join(parts), min(stop, len(raw)) - at - len(z.unused_data)
    out: list[Part] = []
    place = 0
    while place < len(inner):
        one, why = _parse(inner, place)
        if why:
            return out, size, why
        place += one.length
        one.offset, one.length = at, size
        out.append(one)
    return out, size, ""


def salvage(raw: bytes) -> Iterator[Part]:
    """Every readable record of one file in order, and a gap for each run of bytes that is not one."""
    at, bad, reason = 0, -1, ""
    while at < len(raw):
        found, size, why = _at(raw, at)
        if found or not why:
            if bad >= 0:
                yield Part(bad, at - bad, gap=reason)
                bad = -1
            yield from found
        if why:
            if bad < 0:
                bad, reason = at, why
            if size:  # its frame is whole: go on behind it
                if found:
                    bad = at
                at += size
                continue
            here = at + 1
            nexts = [x for x in (raw.find(b"\nWARC/1.", at), raw.find(GZIP, here)) if x >= 0]
            if raw.find(b"\nWARC/1.", at) in nexts:
                nexts[nexts.index(raw.find(b"\nWARC/1.", at))] += 1
            at = min(nexts, default=len(raw))
        else:
            at += max(size, 1)
    if bad >= 0:
        yield Part(bad, len(raw) - bad, gap=reason)


def _packed(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, size and the compressed payload of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            raw = [(x or "").encode() for x in b.column(2).to_pylist()]
            cols = [pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([zlib.compress(x, 1) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["page_id", "url", "digest", "size", "z"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, digest binary, size long, z binary")


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, digest, size, z (compressed payload), first (the smallest id with the same payload) and revisit.

    Payloads are equal when their SHA-1 is. The smallest ids are found by an aggregation that combines before
    the shuffle, and joined to the compressed payloads, so one payload of a third of all pages is split by the
    adaptive join.
    """
    digest = F.unhex(F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    first = pages.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"))
    rows = _packed(pages).join(first, "digest")
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("revisit", again)


def write_warc(pages: DataFrame, to: str, least: int = 0, level: int = 1) -> None:
    """Write pages (page_id, url, html) to the folder ``to``.

    Null html is an empty payload, a null url ``about:blank``; a null page_id has an empty record name and
    revisits the smallest id of its payload, if any has one. Rows that repeat the smallest id are all
    responses. Other columns are ignored. No pages: no records.
    """
    rows = with_first(pages, least).select("page_id", "url", "z", "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
        for b in batches:
            for page, url, z, first, revisit in zip(*(c.to_pylist() if j != 2 else c for j, c in enumerate(b.columns)), strict=True):
                x = member(record(page, url, zlib.decompress(z.as_py()), first, revisit), level)
                if held and size + len(x) > BLOCK:
                    yield block()
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield block()

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", BLOCKS).option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(to)


SCHEMA = "file string, offset long, length long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record, and per quarantined gap one with ``gap`` set and no record; payloads only on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                for p in salvage(raw.as_py()):
                    if p.gap:
                        rows.append((file, p.offset, p.length, p.gap, *[None] * 7))
                        continue
                    head, _, body = p.block.partition(b"\r\n\r\n")
                    size = next((int(x.split(b":")[1]) for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")), len(body))
                    h = p.headers
                    rows.append((file, p.offset, p.length, None, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:"), size, body if payload else None))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def page_of(name: str) -> F.Column:
    """The page id in a record name, null where it has none."""
    return F.nullif(F.regexp_extract(name, "urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    to = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, to, least)
    rows = read_warc(pages.sparkSession, to).where(F.col("gap").isNull())
    return rows.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))

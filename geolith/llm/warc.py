"""WARC archives: written from pages, read back, and assembled into captures.

``write_archives`` makes one request, one response (or revisit) and one
metadata record per page; request and metadata name the response through
WARC-Concurrent-To. ``read_records`` parses archives into one row per record.
``assemble`` follows concurrent-to identifiers and emits one nested row per
capture.

Defined cases: null html is an empty payload; null url is an empty target; rows
with a null id are archived too, with a null page_id and an id of their own;
pages of equal payloads and equal ids stay separate captures, the first being
the response when its id is the smallest; extra columns are dropped; empty
tables give empty tables. A request or metadata record whose response is
missing gives a capture with a null response. A truncated or malformed record
ends its archive's rows with one row of type ``error``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geolith.llm.batches import small_batches
from geolith.operators.components import components
from geolith.tables import dropped, materialised

#: Payloads from this size on are stored once and revisited.
REVISIT_BYTES = 100
# Record types that a capture is named after.
MAINS = ("response", "revisit", "resource")
#: An archive is closed when it holds this many bytes.
ARCHIVE_BYTES = 4 << 20

_VERSION = b"WARC/1.1\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PAGE = re.compile(r"^<urn:page:(-?\d+):")


def _record(kind: str, record_id: str, block: bytes, content: str, **fields: str) -> bytes:
    head = f"WARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: {_DATE}\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items() if v) + f"Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    return _VERSION + head.encode() + block + b"\r\n\r\n"


def _capture(row: int, page: int | None, url: str, html: bytes, digest: str, first: int | None) -> bytes:
    me = f"<urn:page:{'' if page is None else page}:{row:x}>"
    url = re.sub(r"\s", "%20", url)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    said = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha256:{digest}"}
    if first is None:
        main = _record("response", me, head + html, "application/http;msgtype=response", **said)
    else:
        main = _record("revisit", me, head, "application/http;msgtype=response", **said, WARC_Refers_To=f"<urn:page:{first}:>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    path = re.sub(r"^[a-z]+://[^/]*", "", url) or "/"
    request = _record("request", me[:-1] + ":request>", f"GET {path} HTTP/1.1\r\n\r\n".encode(), "application/http;msgtype=request", WARC_Target_URI=url, WARC_Concurrent_To=me)
    about = _record("metadata", me[:-1] + ":metadata>", f"payload-bytes: {len(html)}\r\n".encode(), "application/warc-fields", WARC_Target_URI=url, WARC_Concurrent_To=me)
    return main + request + about


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows of archive bytes, a few MB each. Of equal payloads of revisit_bytes or more the smallest id is a response and the others revisit it."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    row = F.monotonically_increasing_id().alias("row")  # of the scan: the same when a task runs again
    rows = pages.select(row, F.col(f"`{id_col}`").cast("long").alias("page"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= revisit_bytes
    again = rows.where(large).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    again = materialised(again)  # a plain scan: small, it is broadcast by its size; large, the adaptive join splits hot digests
    rows = rows.join(again, "digest", "left").select("row", "page", "url", "html", "digest", F.when((F.col("page") != F.col("first")) | F.col("page").isNull(), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row, page, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(_capture(row, page, url, payload, digest, first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(b"".join(held))
                    held, size = [], 0
        if held:
            yield _archive(b"".join(held))

    return rows.mapInArrow(run, "archive string, content binary")


def _archive(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc"]), pa.array([content], pa.binary())], names=["archive", "content"])


_HEADER = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")
_FIELDS = [("archive", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
RECORD = "archive string, start bigint, type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes bigint, fields map<string,string>, block binary"


def parse(archive: str, content: bytes, keep_block: bool) -> Iterator[tuple]:
    """One tuple per record, in the order of RECORD. The digest of a whole payload is computed from its bytes, never copied from the header."""
    at, end = 0, len(content)
    while at < end:
        stop = content.find(b"\r\n\r\n", at)
        head = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(content, at, stop + 2)} if stop > 0 else {}
        length = int(n) if (n := head.get("content-length", "")).isdigit() else -1
        if not content.startswith(b"WARC/", at) or length < 0 or stop + 4 + length > end:
            yield (archive, at, "error", *[None] * 9)
            return
        block = content[stop + 4 : stop + 4 + length]
        kind, body, digest, size, fields = head.get("warc-type"), None, None, None, None
        if kind in ("response", "resource"):
            body = block[cut + 4 if (cut := block.find(b"\r\n\r\n")) >= 0 else 0 :] if head.get("content-type", "").startswith("application/http") else block
            digest, size = hashlib.sha256(body).hexdigest(), len(body)
        elif kind == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if head.get("content-type") == "application/warc-fields":
            fields = list({k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in _HEADER.findall(block)}.items())
        yield archive, at, kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, size, fields, block if keep_block else None
        at = stop + 4 + length
        while content.startswith(b"\r\n", at):
            at += 2


def read_records(archives: DataFrame, keep_block: bool = True) -> DataFrame:
    """One row per record of archives (archive, content). Without keep_block the payload stays behind and only its size and digest come."""
    small_batches(archives.sparkSession, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("archive").to_pylist(), b.column("content").to_pylist(), strict=True):
                if found := list(parse(archive, content or b"", keep_block)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its response (or revisit), requests and metadata as nested structs.

    A request or metadata record may name the response or any record that leads
    to it, through as many concurrent-to identifiers as there are; records that
    name each other in a circle are one capture without a response. Records
    without an id that name nothing are captures of their own, with a null
    capture_id. A capture is one row, which holds all its records.
    """
    kept = [c for c in records.columns if c not in ("archive", "start")]
    rows = records.where(F.col("type").isin(*MAINS, "request", "metadata")).withColumn("main", F.col("type").isin(*MAINS))
    links = rows.where(~F.col("main") & F.col("record_id").isNotNull() & F.col("concurrent_to").isNotNull()).select(F.col("record_id").alias("a"), F.col("concurrent_to").alias("b")).distinct()
    named = links.select(F.col("a").alias("b")).distinct()
    own = F.when(F.col("main"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    rows = rows.withColumn("anchor", own)
    if not links.join(named, "b", "left_semi").isEmpty():  # some record names another that names a third
        links = materialised(links)
        ends = links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("b").distinct()
        roots = components(links)
        last = roots.join(ends, F.col("node") == F.col("b"), "left").groupBy("root").agg(F.min("b").alias("end"))
        ways = materialised(roots.join(last, "root").select(F.col("node").alias("anchor"), F.coalesce("end", "root").alias("end")))
        rows = rows.join(ways, "anchor", "left").withColumn("anchor", F.coalesce("end", "anchor")).drop("end")
    alone = F.concat_ws(":", F.lit("\u0001"), "archive", "start")  # no identifier looks like this
    rows = rows.withColumn("capture_id", F.col("anchor")).withColumn("anchor", F.coalesce("anchor", alone))
    nested = F.struct(*kept)
    pick = lambda *kinds: F.collect_list(F.when(F.col("type").isin(*kinds), nested))
    both = rows.groupBy("anchor").agg(F.first("capture_id").alias("capture_id"), pick(*MAINS).alias("main"), pick("request").alias("requests"), pick("metadata").alias("metadata"))
    return both.select("capture_id", F.explode_outer("main").alias("response"), "requests", "metadata")


def archived_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages written to archives in the shared folder, read back and assembled: a nested row per capture."""
    archives = materialised(write_archives(pages, id_col, url_col, payload_col))
    records = materialised(read_records(archives, keep_block=False).drop("block"))
    dropped(archives)
    return assemble(records)


def page_of(record_id: str) -> Column:
    """The page's id inside a record's id."""
    return F.regexp_extract(F.col(record_id), _PAGE.pattern, 1).try_cast("long")

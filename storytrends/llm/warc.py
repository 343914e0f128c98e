"""Operator 8: WARC archives and the assembly of captures.

Writing: every page becomes a request, a response or revisit, and a metadata record, made
by column functions and written as gzipped archives through Spark's text sink, so any
store that Spark writes to will do. Reading: archives are parsed record by record; then
request and metadata records join their response through WARC-Concurrent-To, one nested
row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, lookup, written

DATE = "2024-01-01T00:00:00Z"
#: Payloads below this size never become revisits.
REVISIT_BYTES = 100
#: Pages of one archive file.
PAGES_PER_FILE = 2000
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = """record_id string, concurrent_to string, type string, uri string, date string, refers_to string,
 payload_digest string, payload_bytes long, fields map<string,string>, payload binary"""


def record_id(kind: str, *parts: Column) -> Column:
    """A URN made from the page's id, address and digest, so it can be named before it is written."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record(kind: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record as text: headers without a value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(LINE)) for name, value in headers]
    return F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: "), kind, F.lit(LINE),
        *[F.coalesce(line, F.lit("")) for line in lines],
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(LINE + LINE), body,
    )


def with_digest(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", F.regexp_replace("url", r"[\x00-\x20\x7f]", "").alias("url"), body.alias("html"),
        F.octet_length(body).cast("long").alias("size"), F.sha2(body.cast("binary"), 256).alias("digest"),
    )


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``.

    Of equal payloads of REVISIT_BYTES or more, the smallest (page_id, url) is the response. Blanks and
    control characters are cut out of addresses; a null address has no target header. Rows
    that repeat page_id, url and payload repeat their records under the same ids. A null page_id stays
    null; such a page is never the one that others revisit, unless none with its payload has an id, and is itself a response.
    """
    digests = written(with_digest(pages).drop("html"), "digests")
    firsts = (
        digests.filter(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    firsts = written(firsts, "firsts")
    rows = lookup(with_digest(pages), firsts, "digest", hot_keys(digests, "digest"), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.page_id") != F.col("page_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    own = record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("size").cast("string"), F.lit(LINE + LINE), F.when(revisit, "").otherwise(F.col("html")),
    )
    when, target = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
    first_id = record_id("response", F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    main = record(
        kind,
        [
            ("WARC-Record-ID", own), when, target,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, first_id)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        http,
    )
    request = record(
        F.lit("request"),
        [
            ("WARC-Record-ID", record_id("request", F.col("page_id"), F.col("url"), F.col("digest"))), when, target,
            ("WARC-Concurrent-To", own),
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{LINE}{LINE}")),
    )
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE))
    fields = F.concat(fields, F.coalesce(F.concat(F.lit("first-page-id: "), F.when(revisit, F.col("first.page_id")).cast("string"), F.lit(LINE)), F.lit("")))
    metadata = record(
        F.lit("metadata"),
        [
            ("WARC-Record-ID", record_id("metadata", F.col("page_id"), F.col("url"), F.col("digest"))), when, target,
            ("WARC-Concurrent-To", own),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        fields,
    )
    end = F.lit(LINE + LINE)
    # The sink ends each value with the last line break of its last record.
    value = F.concat(request, end, main, end, metadata, F.lit(LINE))
    writer = rows.select(value.alias("value")).write.option("lineSep", LINE).option("compression", "gzip")
    writer.option("maxRecordsPerFile", PAGES_PER_FILE).text(path)


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of an archive, read piece by piece."""
    held = bytearray()

    def more() -> bool:
        piece = next(chunks, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        end = held.find(b"\r\n\r\n")
        if end < 0 or held[:1] == b"\r":
            if more():
                continue
            if held.strip():
                raise ValueError("an archive ends within a record")
            return
        lines = held[:end].decode().split("\r\n")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record at the expected place")
        size = int(headers["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("an archive ends within a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


def inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """Content of gzip members, a piece at a time; data that is not gzipped as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            out = inflate.decompress(data, piece)
            data = inflate.unconsumed_tail
            if not out and not data and not inflate.eof:
                raise ValueError("a compressed archive is cut off")
            yield out
        data = inflate.unused_data


def read_records(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record below ``path``; digests are checked against the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "concurrent_to", "type", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "fields", "payload"]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for headers, block in records_in(inflated(data.as_py())):
                    kind, fields, payload = headers["warc-type"], [], None
                    digest, size = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, None
                    if kind == "metadata":
                        pairs = (line.partition(":") for line in block.decode().split("\r\n") if line)
                        fields = [(name, value.strip()) for name, _, value in pairs]
                    elif kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        inner = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
                        size = int(inner["Content-Length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                    row = [headers.get(h) for h in ("warc-record-id", "warc-concurrent-to", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")]
                    rows.append((*row, digest, size, fields, payload))
                    held += len(block) + 500
                    if held >= batch_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: its request and metadata joined by concurrent-to.

    A capture without a request or metadata record has nulls there. Records under one id
    are equal, so they count once as partners, while every response row is kept.
    """
    partner = records.filter("concurrent_to IS NOT NULL").dropDuplicates(["record_id"])
    request = partner.filter("type = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "uri", "date").alias("request")
    )
    metadata = partner.filter("type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "fields").alias("metadata")
    )
    main = records.filter("type IN ('response', 'revisit')").drop("concurrent_to", "fields")
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of an archive made by ``write_archive``, as digests per page."""
    fields = F.col("metadata.fields")
    return captures(read_records(spark, path)).select(
        fields["page-id"].try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        fields["first-page-id"].try_cast("long").alias("refers_to"),
    )


__all__ = ["captures", "page_captures", "read_records", "write_archive"]

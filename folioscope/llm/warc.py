"""WARC archives: writing pages with revisits and segments, reading them back.

Archives are written by Spark's text writer, one record a row with the blank
lines after a record as the line separator, so that any file system with a
Hadoop path works and lost tasks leave nothing behind.  A part file is one
gzip member; archives with a member for each record are read as well.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_run_dir, settle

END = b"\r\n\r\n"
# Fixed values of the format.
HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = re.compile(rb"<urn:page:(-?[0-9]*):[0-9a-f]*>")

MIN_REVISIT = 100  # bytes; equal payloads below this are stored each
SEGMENT = 16 * 1024  # bytes of a block that one record holds at most
CHUNK = 8 * 1024  # bytes of a chunk of the transfer coding
RECORDS_PER_FILE = 2_000
OUTPUT_BYTES = 4_000_000  # records handed on at a time
INPUT_BYTES = 1 << 16  # compressed bytes taken at a time
DATE = "2024-01-01T00:00:00Z"


# -- one record ---------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer coding."""
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of a stored HTTP response."""
    head, _, body = block.partition(END)
    lines = head.lower().split(b"\r\n")[1:]
    coded = any(x.startswith(b"transfer-encoding:") and b"chunked" in x for x in lines)
    return unchunked(body) if coded else body


def _header_value(text: str | None) -> bytes:
    """A header value: control characters are percent-encoded."""
    return re.sub(rb"[\x00-\x1f\x7f]", lambda m: b"%%%02X" % m[0][0], (text or "").encode())


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    fields.append((b"Content-Length", b"%d" % len(block)))
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % f for f in fields) + b"\r\n" + block


def page_urn(page_id: int | None, digest: str) -> bytes:
    return b"<urn:page:%s:%s>" % (b"" if page_id is None else b"%d" % page_id, digest.encode())


def page_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int
) -> list[bytes]:
    """The records of a page: one revisit, one response, or a response and its
    continuations."""
    urn = page_urn(page_id, digest)
    common = [
        (b"WARC-Record-ID", urn),
        (b"WARC-Target-URI", _header_value(url)),
        (b"WARC-Date", DATE.encode()),
        (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
        (b"Content-Type", b"application/http;msgtype=response"),
    ]
    if first is not None:
        refers = [(b"WARC-Refers-To", page_urn(first, digest)), (b"WARC-Profile", REVISIT_PROFILE)]
        return [_record([(b"WARC-Type", b"revisit"), *common, *refers], HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment:
        return [_record([(b"WARC-Type", b"response"), *common], block)]
    records = []
    for number, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        if number == 1:
            fields = [(b"WARC-Type", b"response"), *common]
        else:
            fields = [
                (b"WARC-Type", b"continuation"),
                (b"WARC-Record-ID", urn[:-1] + b".%x>" % number),
                (b"WARC-Date", DATE.encode()),
                (b"WARC-Segment-Origin-ID", urn),
            ]
        fields.append((b"WARC-Segment-Number", b"%d" % number))
        if at + segment >= len(block):
            fields.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        records.append(_record(fields, part))
    return records


def parse(archive: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        version, *lines = archive[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields = {}
        for line in lines:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        start = end + len(END)
        stop = start + int(fields[b"content-length"])
        if archive[stop : stop + len(END)] != END:
            raise ValueError("a record is shorter than its length says")
        yield fields, archive[start:stop]
        at = stop + len(END)


# -- archives -----------------------------------------------------------------


def write(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    segment: int = SEGMENT,
) -> None:
    """Write a record per row; the payload is the html in UTF-8.

    Of equal payloads of at least ``min_revisit`` bytes, that with the smallest
    id is stored and the others refer to it.  Blocks longer than ``segment``
    are split into segments.  Null html counts as empty, a null url as an empty
    one.  Rows that repeat an id and a payload are stored each.

    Payloads are compared by digest and length; only ids and digests are
    shuffled for it, and equal ones are reduced before.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.octet_length("payload") >= min_revisit).select("id", "digest")
    firsts = (
        narrow.groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    revisits = settle(
        narrow.join(firsts, "digest").where("id <> first").distinct().select("id", "digest", "first"),
        "revisits",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[bytes] = []
        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                made = page_records(*(column[at].as_py() for column in batch.columns), segment)
                ready += made
                size += sum(map(len, made))
                if size >= OUTPUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], names=["value"])
                    ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], names=["value"])

    marked = rows.join(revisits, ["id", "digest"], "left").select("id", "url", "payload", "digest", "first")
    records = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    (
        records.write.option("lineSep", END.decode())
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


RECORD = (
    "record_id binary, type string, refers_to binary, origin binary, segment int, total bigint, block binary"
)


def members(content) -> Iterator[bytes]:
    """The members of a gzip file, one after the other: archives hold a member
    for each record, or several records in one.  A member that is cut short is
    an error; zero bytes behind the last one are not."""
    data, at = memoryview(content), 0
    while at < len(data) and (data[at] or bytes(data[at:]).strip(b"\0")):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            piece = data[at : at + INPUT_BYTES]
            if not len(piece):
                raise ValueError("a gzip member is cut short")
            parts.append(reader.decompress(piece))
            at += len(piece)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def _records(spark: SparkSession, path: str) -> DataFrame:
    kinds = (pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
    names = ["record_id", "type", "refers_to", "origin", "segment", "total", "block"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in itertools.chain.from_iterable(map(parse, members(content.as_buffer()))):
                    number = fields.get(b"warc-segment-number")
                    total = fields.get(b"warc-segment-total-length")
                    rows.append((
                        fields[b"warc-record-id"],
                        fields[b"warc-type"].decode(),
                        fields.get(b"warc-refers-to"),
                        fields.get(b"warc-segment-origin-id") or (number and fields[b"warc-record-id"]),
                        number and int(number),
                        total and int(total),
                        block,
                    ))
                    size += len(block)
                    if size >= OUTPUT_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """``record_id, type, refers_to, block`` of whole records.

    Segments are grouped by origin and put in order of their number.  The
    block is null if a segment is missing or the total length is not met.  A
    group holds one record's segments.  Repeated records come back as often as
    their first segment does.
    """
    whole = records.where("segment is null").select("record_id", "type", "refers_to", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for parts, total in zip(batch.column("parts"), batch.column("total").to_pylist()):
                segments = {p["segment"].as_py(): p["block"].as_py() for p in parts}
                block = b"".join(segments.get(n, b"") for n in sorted(segments))
                good = sorted(segments) == list(range(1, len(segments) + 1)) and len(block) == total
                blocks.append(block if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("record_id", "copies")] + [pa.array(blocks, pa.binary())],
                names=["record_id", "copies", "block"],
            )

    grouped = (
        records.where("segment is not null")
        .groupBy(F.col("origin").alias("record_id"))
        .agg(
            F.collect_list(F.struct("segment", "block")).alias("parts"),
            F.max("total").alias("total"),
            F.greatest(F.count_if(F.col("segment") == 1), F.lit(1)).cast("int").alias("copies"),
        )
        .mapInArrow(run, "record_id binary, copies int, block binary")
        .select(
            "record_id",
            F.lit("response").alias("type"),
            F.lit(None).cast("binary").alias("refers_to"),
            "block",
            F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"),
        )
        .drop("_copy")
    )
    return whole.unionAll(grouped)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, refers_to, payload`` of the page records under ``path``.

    Transfer coding is undone.  A revisit has no payload of its own (null), nor
    has a record whose segments are not complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [
                None if block is None or kind == "revisit" else http_payload(block)
                for kind, block in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("record_id", "type", "refers_to")]
                + [pa.array(payloads, pa.binary())],
                names=["record_id", "type", "refers_to", "payload"],
            )

    whole = reassemble(_records(spark, path))
    return whole.mapInArrow(run, "record_id binary, type string, refers_to binary, payload binary")


def page_of(record_id):
    """The page id in a record id of ``write``; null for a page without one."""
    number = F.regexp_extract(record_id.cast("string"), PAGE_URN.pattern.decode(), 1)
    return number.try_cast("bigint")


# -- the query ----------------------------------------------------------------


def op2_warc(spark, folder):
    """Write all pages, read the archives, resolve revisits by what they refer to."""
    path = new_run_dir(spark, "warc")
    write(spark.read.parquet(f"{folder}/pages.parquet"), path)
    found = settle(
        read(spark, path).select(
            "record_id",
            "type",
            "refers_to",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "warc_pages",
    )
    own = found.where("type = 'response'").drop("refers_to")
    revisits = found.where("type = 'revisit'").select("record_id", "refers_to")
    originals = own.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    resolved = revisits.join(originals, "refers_to", "left")
    columns = ["payload_bytes", "payload_digest"]
    return own.select(
        page_of(F.col("record_id")).alias("page_id"),
        *columns,
        F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
    ).unionAll(
        resolved.select(
            page_of(F.col("record_id")).alias("page_id"),
            *columns,
            F.lit("revisit").alias("record_type"),
            page_of(F.col("refers_to")).alias("refers_to"),
        )
    )


SQL = f"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages
),
judged AS (
  SELECT *, CASE WHEN size >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM digests
)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM judged
"""

QUERIES = {"op2_warc": op2_warc}
ORACLE = {"op2_warc": SQL}

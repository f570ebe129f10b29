"""Web archives as a chunked record table.

A payload longer than ``chunk`` bytes is never held as one record: it becomes rows of (record id,
chunk number), each written as a WARC segment of its own, the first under the record's type, the
others as ``continuation``. Reading streams an archive's lines through a small state machine that
holds one line at a time and carries the record's SHA-1 from segment to segment, so every chunk
row has the digest of all bytes up to its end and the last one has the payload's.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page id
is the response, the others are revisits that name it and carry no payload. Archives are gzipped
text files that Spark writes and reads, so any store Spark knows will do; gzip keeps a file whole.

Defined results. NULL html is an empty payload; an empty payload has a digest like any other. A NULL page id sorts
below all others; if no copy has an id, all are responses. Rows repeating page id and payload get the same record
type and identifier. Line breaks in a URL become spaces. No pages, no records. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_folder, table, written

CHUNK = 1 << 16
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the WARC 1.1 format.
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: every 5 hex digits are 20 bits, hence 4 digits of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row per page: payload, its size and digest, record type, and the response of a revisit."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "payload")
    holders = written(
        hashed.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1")
        .select(F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("of_bytes"), "holder"), "holders")
    copied = (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") == F.col("of_bytes"))
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return hashed.join(holders, copied, "left").select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("holder")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record, chunk number, bytes): one row per ``chunk`` bytes of payload, at least one."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk))).cast("int")
    return (
        records.withColumn("chunks", F.coalesce(count, F.lit(1)))
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(1), "chunks")))
        .withColumn("data", F.substring("payload", (F.col("chunk_no") - 1) * chunk + 1, F.lit(chunk)))
        .drop("payload")
    )


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, least_bytes: int = LEAST_BYTES,
                   date: str = DATE) -> None:
    """Write every page as a WARC record below ``path``."""
    parts = chunk_rows(records(pages, least_bytes), chunk)
    first, final = F.col("chunk_no") == 1, F.col("chunk_no") == F.col("chunks")
    response, segmented = F.col("record_type") == "response", F.col("chunks") > 1
    name = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))
    own = F.concat(F.lit("<"), name(F.col("page_id")), F.when(first, "").otherwise(
        F.concat(F.lit(":"), "chunk_no")), F.lit(">"))
    block = F.when(~response, F.lit("").cast("binary")).when(
        first, F.concat(F.lit(HTTP_HEAD).cast("binary"), "data")).otherwise(F.col("data"))
    field = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    fields = [
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        field("WARC-Record-ID", own),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.translate("url", "\r\n", "  ")),
        F.when(first, field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))),
        F.when(first, field("X-Payload-Length", F.col("payload_bytes").cast("string"))),
        F.when(~response, F.concat(
            field("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("refers_to")), F.lit(">"))),
            field("WARC-Profile", F.lit(IDENTICAL)))),
        F.when(segmented, field("WARC-Segment-Number", F.col("chunk_no").cast("string"))),
        F.when(~first, field("WARC-Segment-Origin-ID", F.concat(F.lit("<"), name(F.col("page_id")), F.lit(">")))),
        F.when(segmented & final, field("WARC-Segment-Total-Length",
                                        (F.col("payload_bytes") + len(HTTP_HEAD)).cast("string"))),
        F.when(response & first, field("Content-Type", F.lit("application/http;msgtype=response"))),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    ]
    head = F.concat(*[F.coalesce(f, F.lit("")) for f in fields])
    text = parts.withColumn("block", block).select(F.concat(head.cast("binary"), "block").cast("string"))
    text.write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """One archive's lines in order; holds a record's fields and running digest, never its payload."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.record = None  # the fields being read, or of the record whose block is being read
        self.left = 0  # bytes of the block still to come
        self.origin = None  # of the last record begun: its fields, digest and payload length so far

    def line(self, line: bytes) -> dict | None:
        if self.left:
            return self._block(line + b"\n")
        if self.record is None:
            if line == b"WARC/1.1\r":
                self.record = {}
            return None
        if line != b"\r":
            key, _, value = line.rstrip(b"\r").partition(b": ")
            self.record[key.decode()] = value.decode("utf-8", "replace")
            return None
        self.left = int(self.record["Content-Length"]) + 2  # the block's end mark begins with a line's end
        if self.record["WARC-Type"] != "continuation":
            self.origin = {"fields": self.record, "sha1": hashlib.sha1(), "bytes": 0}
        self.chunk, self.data = 0, []
        self.in_head = self.record["WARC-Type"] == "response"
        return None

    def _block(self, piece: bytes) -> dict | None:
        self.left -= len(piece)
        if self.left <= 0:
            piece = piece[:-2]
        if self.in_head:
            self.in_head = piece != b"\r\n"
        else:
            self.origin["sha1"].update(piece)
            self.chunk += len(piece)
            if self.with_data:
                self.data.append(piece)
        if self.left > 0:
            return None
        self.left = 0
        return self._chunk()

    def _chunk(self) -> dict:
        own, origin = self.record, self.origin
        fields = origin["fields"]
        origin["bytes"] += self.chunk
        revisit = fields["WARC-Type"] == "revisit"
        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        digest = declared if revisit else b32encode(origin["sha1"].digest()).decode()
        size = int(fields["X-Payload-Length"]) if revisit else origin["bytes"]
        final = "WARC-Segment-Number" not in own or "WARC-Segment-Total-Length" in own
        self.record = None
        return {
            "record_id": fields["WARC-Record-ID"].strip("<>"), "record_type": fields["WARC-Type"],
            "refers_to": fields.get("WARC-Refers-To", "").strip("<>") or None,
            "url": fields.get("WARC-Target-URI"), "chunk_no": int(own.get("WARC-Segment-Number", 1)),
            "chunk_bytes": self.chunk, "bytes_so_far": size, "digest_so_far": digest, "last": final,
            "intact": not final or digest == declared and size == int(fields["X-Payload-Length"]),
            "data": b"".join(self.data) if self.with_data else None,
        }


CHUNKS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
    ("chunk_no", pa.int32()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()),
    ("digest_so_far", pa.string()), ("last", pa.bool_()), ("intact", pa.bool_()), ("data", pa.binary())])
FLUSH_ROWS, FLUSH_BYTES = 2000, 1 << 23


def _chunks(batches: Iterator[pa.RecordBatch], with_data: bool) -> Iterator[pa.RecordBatch]:
    reader, out, size = _Reader(with_data), [], 0
    for batch in batches:
        for line in batch.column(0):
            row = reader.line(line.as_py())
            if row:
                out.append(row)
                size += len(row["data"] or b"")
            if len(out) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=CHUNKS)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=CHUNKS)


def read_archives(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk rows of all gzipped archives below ``path``, in the order they were written."""
    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    schema = ("record_id string, record_type string, refers_to string, url string, chunk_no int, chunk_bytes bigint, "
              "bytes_so_far bigint, digest_so_far string, last boolean, intact boolean, data binary")
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(
        lambda batches: _chunks(batches, with_data), schema)


def page_of(record_id: str) -> Column:
    """The page id in a record's identifier; NULL where the page had none."""
    return F.when(F.col(record_id) != "urn:page:", F.substring_index(record_id, ":", -1).cast("long"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path, with_data=False).where("last").select(
        page_of("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"),
        "intact")


SQL = f"""
with payloads as (
    select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hexed,
           max(page_id) over (partition by coalesce(html, '')) as holder
    from pages
), digits as (
    select *, list_transform(range(0, 32), lambda i:
        (('0x' || substr(hexed, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) as parts
    from payloads
)
select page_id, strlen(payload)::bigint as payload_bytes,
       array_to_string(list_transform(parts, lambda d: substr('{BASE32}', d::bigint + 1, 1)), '') as payload_digest,
       case when page_id = holder then 'response' else 'revisit' end as record_type,
       case when page_id <> holder then holder end as refers_to, true as intact
from digits
"""

"""WARC archives: writer with revisit records, sequential reader.

One gzip member per record.  Members are written through Spark's own text writer, so any
Hadoop file system, its commit protocol and task retries apply: each row is one file's members,
and the "line separator" is an empty gzip member, which readers skip.  The reader takes whole
archive files (rolled by ``bytes_per_file``), inflates one member at a time, frames the
block by Content-Length and verifies the digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

MEMBERS = "members binary"
RECORD = (
    "record_type string, record_id string, target_uri string, refers_to string, payload binary, "
    "payload_bytes long, payload_digest string, verified boolean"
)
RECORD_ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("verified", pa.bool_()),
    ]
)
#: Compressed bytes fed to the decompressor at once.
CHUNK = 1 << 16


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = gzip_member(b"")


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(record, uri, payload, digest) plus ``refers``: the record that holds an equal payload.

    Of records with equal payloads of at least ``min_bytes`` the largest non-null id is the
    response.  Repeated rows of that id are all responses; a null id always revisits it.  Only
    digests are aggregated (with map-side combine), so a payload that makes up a third of all
    rows meets in no single task; the join back is an inner skew-splittable sort-merge join.
    """
    keyed = pages.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    holders = (
        keyed.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("record").alias("holder"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "holder")
    )
    other = F.col("holder").isNotNull() & ~F.col("record").eqNullSafe(F.col("holder"))
    return keyed.join(holders, "digest", "left").select(
        "record", "uri", "payload", "bytes", "digest", F.when(other & (F.col("bytes") >= min_bytes), F.col("holder")).alias("refers")
    )


def _header(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def build_record(record, uri, payload: bytes, digest: str, refers, date: str) -> bytes:
    """The bytes of one WARC/1.1 record; a revisit keeps the HTTP header and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if record is None else str(record).encode()),
        b"WARC-Date: " + date.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"Content-Length: %d" % len(block),
    ]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + _header(uri))
    if refers is not None:
        lines.append(b"WARC-Refers-To: <urn:page:%s>" % str(refers).encode())
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", bytes_per_file: int = 64 << 20, level: int = 6) -> None:
    """Write ``mark_revisits`` rows as gzip archives under ``path``.

    A file has at most ``bytes_per_file`` bytes beside its end, or one larger member.
    """

    def part(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for r, u, p, d, f in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], b[3].to_pylist(), b[4].to_pylist(), strict=True):
                member = gzip_member(build_record(r, u, p.as_py() or b"", d, f, date), level)
                if held and size + len(member) > bytes_per_file:
                    yield part(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield part(held)

    (
        marked.select("record", "uri", "payload", "digest", "refers")
        .mapInArrow(pack, MEMBERS)
        .select(F.col("members").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def members(archive) -> Iterator[bytes]:
    """Inflate a multi-member gzip archive, one member after the other.

    A damaged or cut member gives what could be inflated; reading goes on at the next place that
    looks like a member's head.
    """
    archive, at = memoryview(archive), 0
    whole = None
    while at < len(archive):
        begin, z, out = at, zlib.decompressobj(31), bytearray()
        try:
            while not z.eof:
                chunk = archive[at : at + CHUNK]
                if not chunk:
                    raise zlib.error("cut member")
                out += z.decompress(chunk)
                at += len(chunk)
            at -= len(z.unused_data)
        except zlib.error:
            whole = bytes(archive) if whole is None else whole
            at = whole.find(b"\x1f\x8b\x08", begin + 1)
            at = len(archive) if at < 0 else at
        if out:
            yield bytes(out)


def _number(value: bytes, default: int) -> int:
    return int(value) if value.isdigit() else default


def parse_record(data: bytes) -> tuple:
    """One record's fields in the order of ``RECORD``; damaged framing, headers or digests give verified = false."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    length = _number(fields.get(b"Content-Length", b""), -1)
    block = rest[: max(0, length)]
    framed = head.startswith(b"WARC/1.") and len(block) == length and rest[length:] == b"\r\n\r\n"
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind = text(b"WARC-Type") or ""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((_number(x[16:], -1) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")), len(payload))
    digest = (text(b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    good = framed and text(b"WARC-Block-Digest") == "sha1:" + hashlib.sha1(block).hexdigest()
    if kind == "response":
        good = good and size == len(payload) and digest == hashlib.sha1(payload).hexdigest()
    return kind, text(b"WARC-Record-ID"), text(b"WARC-Target-URI"), text(b"WARC-Refers-To"), payload if kind == "response" else None, size, digest, good


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, in ``RECORD`` columns."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                rows, held = [], 0
                for data in members(value.as_buffer()):
                    rows.append(parse_record(data))
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back.

    A null html is an empty payload; a null page_id keeps a null id; a null url omits the
    target URI; repeated rows each get their record; an empty table gives an empty archive.
    """
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record"), F.col("url").alias("uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )
    path = scratch(spark, "warc")
    write_archives(mark_revisits(pages), path)
    ident = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    return read_archives(spark, path).select(
        ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"), "verified"
    )


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS holder FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> holder THEN holder END AS refers_to, true AS verified
FROM p LEFT JOIN m ON p.d = m.d
"""

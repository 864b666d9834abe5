"""WARC archives: writing, reading, and resolving revisits by payload digest.

Each record is a gzip member of its own, so tools can seek to it. Archives are written by Spark's own
text writer (any Hadoop file system, task commit, so a lost executor leaves no half file): a row holds
a member's bytes, and its line separator is an empty member, which gzip readers pass over. A task
begins a new volume after ``file_bytes`` of records, so a file exceeds that by one record at most.
Archives are read with the binaryFile source and parsed by Content-Length, never by searching for
separators, so payloads may contain anything.

Record ids are unique: what a revisit refers to is known by its page id, all others carry a random
part. Where several equal rows share the id of a response, each has a random part as well, and
revisits refer to the page id that they share.

Defined results: a null payload is empty; payloads under ``min_bytes`` are never deduplicated; of
equal payloads the smallest id is the response; rows with a null id are written and read with a
null id and never take part in deduplication; a repeated id is written once per row; controls in an
address become %XX; a response's block without HTTP headers is all payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch

MIN_BYTES = 100
FILE_BYTES = 32 << 20
CRLF = "\r\n"
#: A gzip member of no bytes.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload_ok boolean"


def _urn(id_col: Column, tail: Column | None = None) -> Column:
    return F.concat(F.lit("<urn:palimpsest:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("") if tail is None else tail, F.lit(">"))


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def _clean_uri(uri: Column) -> Column:
    """Header values can't hold line ends or other controls; they become %XX as in a URI."""
    uri = F.coalesce(uri, F.lit(""))
    out = uri
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(uri.rlike(r"[\x00-\x1f\x7f]"), out).otherwise(uri)


def record_text(urn: Column, uri: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record. With refers_to it is a revisit and holds only HTTP headers."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), _octets(payload), F.lit(CRLF * 2))
    revisit = refers_to.isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn,
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), _clean_uri(uri),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), digest,
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _urn(refers_to))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), _octets(block),
        F.lit(CRLF * 2), block, F.lit(CRLF * 2),
    )


def find_revisits(headers: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, payload_digest, refers_to, times) of the records whose payload is met again: revisits, and the responses that they refer to (refers_to is their own id), with the number of such rows.

    headers: record_id, payload_digest, payload_bytes. Only headers are shuffled. The smallest id of
    each digest is found with a partial aggregate (one row per digest and task leaves each mapper,
    however hot the digest); the table of repeated digests is written, so the join that follows is one
    between plain scans, whose hot partitions Spark splits.
    """
    big = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("record_id").isNotNull())
    firsts = scratch.table(
        big.groupBy("payload_digest").agg(F.min("record_id").alias("refers_to"), F.max("record_id").alias("last")).where("last > refers_to").drop("last"),
        "firsts",
    )
    met = big.join(firsts, "payload_digest").groupBy("record_id", "payload_digest", "refers_to")
    return met.agg(F.count(F.lit(1)).alias("times"))


def _members(file_bytes: int):
    """Records as gzip members, with the number of the task's volume that each goes to."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, held = 0, 0
        for batch in batches:
            values, volumes = [], []
            for record in batch.column(0):
                data = record.as_py()
                if held and held + len(data) > file_bytes:
                    volume, held = volume + 1, 0
                held += len(data)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                values.append(z.compress(data) + z.flush())
                volumes.append(volume)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(volumes, pa.int32())], ["value", "volume"])

    return compress


def write_archives(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html) as deduplicated gzip archives of about file_bytes uncompressed."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    )
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    headers = scratch.table(pages.select("record_id", digest.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "headers")
    marks = scratch.table(find_revisits(headers, scratch, min_bytes), "marks")
    if marks.count() <= BROADCAST_IDS:  # then payloads aren't shuffled at all
        marks = F.broadcast(marks)
    joined = pages.withColumn("payload_digest", digest).join(marks, ["record_id", "payload_digest"], "left")
    refers_to = F.when(F.col("refers_to") != F.col("record_id"), F.col("refers_to"))
    known = (F.col("refers_to") == F.col("record_id")) & (F.col("times") == 1)
    urn = _urn(F.col("record_id"), F.when(known, F.lit("")).otherwise(F.concat(F.lit(":"), F.uuid())))
    text = record_text(urn, F.col("uri"), F.col("payload"), F.col("payload_digest"), refers_to)
    members = joined.select(text.cast("binary").alias("record")).mapInArrow(_members(file_bytes), "value binary, volume int")
    # members are bytes, not text: the writer passes them on as they are
    out = members.select(F.col("value").cast("string").alias("value"), "volume").write.mode("overwrite").partitionBy("volume")
    out.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").text(path)


def _inflate(content: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def _id(value: bytes) -> int | None:
    """The page id of one of our record ids."""
    tail = value.rpartition(b":page:")[2].rstrip(b">").partition(b":")[0]
    return int(tail) if tail else None


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """(headers, block) of each record, by Content-Length. A damaged record raises ValueError."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].split(b"\r\n")[1:]
        head = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines)}
        start, size = end + 4, int(head[b"content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, view[start : start + size]
        at = start + size + 4


def payload_of(head: dict[bytes, bytes], block: memoryview) -> memoryview:
    """What follows the HTTP headers, however long they are; a block without them is all payload."""
    if not head.get(b"content-type", b"application/http").lower().startswith(b"application/http"):
        return block
    cut = bytes(block).find(b"\r\n\r\n")
    return block[cut + 4 :] if cut >= 0 else block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse_records(_inflate(content.as_py())):
                kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].partition(b":")[2].decode()
                payload = payload_of(head, block)
                revisit = kind == "revisit"
                ok = None if revisit else hashlib.sha256(payload).hexdigest() == digest
                refers = _id(head[b"warc-refers-to"]) if revisit else None
                rows.append((_id(head[b"warc-record-id"]), kind, head[b"warc-target-uri"].decode(), digest, None if revisit else len(payload), refers, ok))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload_ok"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record (see RECORD); payload_ok: a response's payload has the digest of its header (null for revisits)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read, RECORD)


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records with the length of the full payload: revisits are joined to the responses that they refer to.

    A hot response is joined by many revisits; both sides are scans, so Spark can split it. A revisit
    is ok if a response with its digest is there and is ok; if none is there its length is null.
    """
    records = scratch.table(records, "records")
    revisits, rest = records.where("record_type = 'revisit'"), records.where("record_type <> 'revisit'")
    originals = rest.groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"), F.max("payload_ok").alias("ok"))
    found = revisits.join(scratch.table(originals, "originals"), ["refers_to", "payload_digest"], "left")
    found = found.withColumn("payload_bytes", F.col("full")).withColumn("payload_ok", F.coalesce("ok", F.lit(False)))
    return rest.unionByName(found.select(*records.columns))

"""WARC archives with revisit resolution.

Narrow headers are shuffled by payload digest to find each payload's original;
only the resolution meets the payloads again, by page id.  Records are laid out
in tasks, written through Spark's own writer (so by its commit protocol, to any
store Spark can write) and read back with the binary file source.

Defined cases: a null html is an empty payload; among equal payloads the
smallest non-null page_id is the response, and where every id is null all are
responses; rows equal in page_id and payload are each written, as the same
type; a null url becomes urn:page:<id>; an empty table gives an empty archive
and an empty result.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices

#: Rows of the text writer are segments of whole records; a file holds a few of them.
SEGMENT_BYTES = 4 << 20
SEGMENTS_PER_FILE = 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), refers_to, refers_url of every page."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    heads = p.select("page_id", "url", "digest").filter(F.octet_length("payload") >= min_bytes)
    originals = (heads.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("o"), F.count("*").alias("n"))
                 .filter("n > 1 AND o IS NOT NULL").select("digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_url")))
    revisits = (heads.select("page_id", "digest").join(originals, "digest")
                .filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
                .select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "refers_to", "refers_url"))
    return p.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").drop("_id", "_d")


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, refers_url, date: str) -> bytes:
    """One WARC/1.1 record with fresh headers."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_uri(url, page_id)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{b32}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}",
                 f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives below ``path``, whole-file gzip.  A record ends in a line feed, and the
    writer's row separator is that line feed, so the files hold nothing else."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        give = lambda: pa.RecordBatch.from_pydict({"value": pa.array([b"".join(held)[:-1]], pa.binary())})
        for b in slices(batches, 64):
            for row in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")]):
                held.append(record(*row, date))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield give()
                    held, size = [], 0
        if held:
            yield give()

    rows = resolved.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(segments, "value binary")
    (rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n")
     .option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path))


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        block = memoryview(data)[start:start + size]
        body = data.index(b"\r\n\r\n", start) + 4
        http = data[start:body].decode().lower()
        yield {"head": head, "http": http, "payload": block[body - start:]}
        if data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError("record does not end where its header says")
        at = start + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of every archive below ``path``; ``intact`` compares a response's payload with its digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out: list[tuple] = []
            for r in parse(gzip.decompress(b.column("content")[0].as_py())):
                h, revisit = r["head"], r["head"]["warc-type"] == "revisit"
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                size = int(r["http"].split("content-length: ")[1].split("\r\n")[0])
                ok = revisit or (len(r["payload"]) == size and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == digest)
                out.append((int(h["x-page-id"]) if "x-page-id" in h else None, h["warc-target-uri"], h["warc-record-id"], h["warc-type"],
                            size, digest, int(h["x-refers-to-page-id"]) if revisit else None, ok))
            cols = list(zip(*out)) or [()] * 8
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = [x.split()[0] for x in RECORDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, RECORDS)


def rewrite(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives and return what reading them back gives."""
    write(resolve(pages, min_bytes), path)
    return read(pages.sparkSession, path)

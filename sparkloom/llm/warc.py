"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is text, and the blank line that ends it is the writer's line separator, so archives go through
Spark's own committer to any store and survive a lost executor. Of equal payloads the one with the smallest page id is
the response; the others are revisits that carry its digest and length but no payload.

Reading. A task scans its archive for the magic of a record, also where a payload holds it, and makes of every
candidate a link to its successor: the offset behind the block that its header announces. Pointer jumping from the
start of the file doubles the reach of every link in each round, so after log2(candidates) rounds exactly the offsets
on the chain from offset 0 are marked; magic inside payloads is never reached. Only reached records are parsed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.shared import written

MAGIC = b"WARC/1.1\r\n"
#: An archive is closed after so many records, which bounds what a reading task holds.
ARCHIVE_RECORDS = 4096
#: Payload ids in the map of revisits that may be broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
MIN_REVISIT_BYTES = 0
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal; it is read eight times, so it should be a column, not an expression."""
    out = []
    for group in range(8):
        value = F.conv(F.substring(sha1, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One record for each row of `pages` under `path`.

    Null html is an empty payload, a null url an empty one. Rows with the payload and the id of a response are
    responses too (repeated rows). A null id comes last among equal payloads and reads back as null. An empty table writes
    no record. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long"))
    rows = rows.withColumn("digest", F.sha1("html"))
    digests = written(rows.select("page_id", "size", "digest").where(F.col("size") >= min_revisit_bytes), "payload-digests")
    first = digests.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    later = digests.where("page_id is not null").join(first, "digest").where("page_id <> refers_to").select("page_id", "refers_to", F.col("digest").alias("of")).distinct()
    later = written(later, "revisits")
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later
    rows = rows.join(later.withColumnRenamed("page_id", "of_page"), (F.col("page_id") == F.col("of_page")) & (F.col("digest") == F.col("of")), "left")
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", urn(F.col("page_id"))), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def candidate_links(archive: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offset, successor) of everything that looks like a record: magic, a header with a length, and a block that fits."""
    offsets, ends = [], []
    at = archive.find(MAGIC)
    while at >= 0:
        stop = archive.find(b"\r\n\r\n", at)
        if stop < 0:
            break
        length = re.search(rb"\r\nContent-Length: *([0-9]{1,18}) *(?=\r\n|\Z)", archive[at:stop], re.IGNORECASE)
        if length:
            end = stop + 4 + int(length[1]) + 4
            if end <= len(archive):
                offsets.append(at)
                ends.append(end)
        at = archive.find(MAGIC, at + 1)
    return np.array(offsets, dtype=np.int64), np.array(ends, dtype=np.int64)


def reached(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates lie on the chain from offset 0, by pointer jumping."""
    n = len(offsets)
    marks = np.zeros(n + 1, dtype=bool)
    if not n or offsets[0] != 0:
        return marks[:n]
    jump = np.searchsorted(offsets, successors)
    jump = np.append(np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == successors), jump, n), n)
    marks[0] = True
    while True:
        before = marks.sum()
        marks[jump[np.flatnonzero(marks)]] = True
        if marks.sum() == before and (jump[marks] == n).all():
            return marks[:n]
        jump = jump[jump]


def _record(archive: bytes, at: int, end: int) -> dict:
    stop = archive.index(b"\r\n\r\n", at)
    head = dict(x.split(b": ", 1) for x in archive[at + len(MAGIC) : stop].split(b"\r\n") if b": " in x)
    block = archive[stop + 4 : end - 4]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(re.search(rb"Content-Length: *([0-9]+)", http)[1])
    kind = head[b"WARC-Type"].decode()
    page = lambda name: None if (v := head[name][len(b"<urn:page:") : -1]) == b"null" else int(v)
    digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    sound = kind == "revisit" or (len(payload) == told and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return {"page_id": page(b"WARC-Record-ID"), "url": head[b"WARC-Target-URI"].decode(), "payload_bytes": told, "payload_digest": digest, "record_type": kind, "refers_to": page(b"WARC-Refers-To") if kind == "revisit" else None, "sound": sound, "payload": payload.decode("utf-8", "replace") if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records on the chains of all archives under `path`: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, sound, payload).

    sound: a response's payload has the length and digest that its header tells. payload is null unless asked for.
    An archive whose chain breaks gives the records before the break. A task holds the archives of one input partition,
    at most spark.sql.files.maxPartitionBytes, or one larger archive.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "sound": pa.bool_(), "payload": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                archive = cell.as_py() or b""
                offsets, ends = candidate_links(archive)
                on = reached(offsets, ends)
                records: list[dict] = []
                for at, end in zip(offsets[on].tolist(), ends[on].tolist(), strict=True):
                    records.append(_record(archive, at, end))
                    if not payloads:
                        records[-1]["payload"] = None
                    if len(records) == 256:
                        yield pa.RecordBatch.from_pylist(records, schema=schema)
                        records = []
                if records:
                    yield pa.RecordBatch.from_pylist(records, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return files.mapInArrow(scan, ", ".join(f"{k} {names[v]}" for k, v in kinds.items()))


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes `pages` under `path` and reads the archives back."""
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)

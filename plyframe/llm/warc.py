"""WARC: deduplicated archives with revisit records, and their resolution.

Writing: headers (id, payload digest, size) are shuffled by digest; the
smallest id of each digest is the response, later copies of payloads of at
least ``min_bytes`` become revisit records that name it.  Payloads then move
once, dealt to archive files by row number, where each record is built with
fresh headers as one string; the archives are written by Spark's text writer
(gzip, any store, safe against lost and repeated tasks).

Reading: archives are read as whole files of bounded size and parsed record by
record by ``Content-Length``, never by looking for a separator, so a payload
may hold anything.  Revisit records are then joined to the responses by digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import save

MIN_BYTES = 100
#: Payload bytes an archive file is meant to hold, at least and (for large inputs) at most, and files up to which it is the least.
FILE_BYTES = 16 << 20
MOST_FILE_BYTES = 256 << 20
FILES = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()),
                     ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                     ("date", pa.string()), ("digest_ok", pa.bool_())])


def _record_id(rid: Column, digest: Column) -> Column:
    """A urn:uuid from the payload's digest and the row's number."""
    h = F.sha2(F.concat_ws("|", digest, rid.cast("string")), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"),
                    part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, without line ends in the value; a null value gives no line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """One record per row of ``pages`` to gzip archives under ``path``.

    A null payload counts as empty; a null id or address gives no such header.
    Of equal payloads the row with the smallest id (nulls last) is the response;
    rows that repeat an id are separate records.  An empty table gives archives
    without records.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = save(spark, pages.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")),
        "warc-rows")
    heads = rows.drop("payload")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid", "url")).alias("first")
    twice = save(spark, heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                 .agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first"),
                 "warc-responses")
    revisits = save(spark, heads.join(twice, "payload_digest").filter("rid <> first.rid").select(
        F.col("rid").alias("own"), F.col("first.rid").alias("to"), F.col("first.url").alias("to_url")), "warc-revisits")
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    files = int(-(-total // max(file_bytes, min(MOST_FILE_BYTES, total // FILES)))) or 1
    placed = rows.repartition(files, "rid").join(revisits, F.col("rid") == F.col("own"), "left")
    again = F.col("to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    placed = placed.withColumn("block", F.when(again, http).otherwise(F.concat(http, F.col("payload"))))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("rid"), F.col("payload_digest")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"), _line("WARC-Target-URI", F.col("url")),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2("block", 256), F.lit("\r\n"),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                               _record_id(F.col("to"), F.col("payload_digest")),
                               F.lit(f"\r\nWARC-Refers-To-Date: {DATE}\r\n"),
                               _line("WARC-Refers-To-Target-URI", F.col("to_url")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(END), F.col("block"))
    placed.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(stream) -> dict[str, str]:
    """Header lines up to the empty line, names in lower case."""
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive (plain or gzip, any number of members), as ``RECORDS`` and ``payload``."""
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        head = _fields(stream)
        block = stream.read(int(head.get("content-length", 0)))
        payload, size = block, None
        if head.get("content-type", "").startswith("application/http"):
            inner = io.BytesIO(block)
            inner.readline()
            size = _fields(inner).get("content-length")
            payload = block[inner.tell():]
        kind = head.get("warc-type")
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        yield {"record_id": head.get("warc-record-id"), "page_id": head.get("x-page-id"),
               "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
               "payload_bytes": int(size) if kind == "revisit" and size else len(payload),
               "date": head.get("warc-date"), "payload": payload,
               "digest_ok": kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest}


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``: the columns of ``RECORDS`` (and ``payload``)."""
    schema = RECORDS.append(pa.field("payload", pa.binary())) if payloads else RECORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in parse(content.as_py()):
                    rows.append(r)
                    held += len(r["payload"]) if payloads else 0
                    if len(rows) == 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` and ``refers_to``: for a revisit the page id of the original response, found by payload
    digest (of several the earliest, then the smallest record id); else null.  Only headers move."""
    originals = records.filter("record_type = 'response'").groupBy("payload_digest").agg(
        F.min(F.struct("date", "record_id", "page_id")).alias("o"))
    found = records.filter("record_type = 'revisit'").join(originals, "payload_digest", "left")
    return found.select(*records.columns, F.col("o.page_id").alias("refers_to")).unionByName(
        records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("string")))

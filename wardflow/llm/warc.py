"""WARC archives in which repeated payloads are revisit records.

Archives are written by Spark's text sink: a row is a whole record, and the
line separator is the two line ends that close a record. The commit protocol
of the sink thus holds for them, and they go to any store that Spark writes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardflow.llm.common import bounded_batches, pick, shared_folder

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
LINE = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD_PREFIX = "urn:page:"
RECORD_COLUMNS = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of 40 bits, written as eight digits each."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0"), DIGITS32, BASE32) for i in range(4)]
    return F.concat(*parts)


def with_decision(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Only headers (id, digest, size) are shuffled by digest to choose the
    response of each payload; the join back is an equi join on the digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload.cast("binary")).alias("payload_digest"),
    )
    chosen = base.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"))
    repeats = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return base.join(chosen, "payload_digest").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(repeats, "revisit").otherwise("response").alias("record_type"), F.when(repeats, F.col("response_id")).alias("refers_to"),
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_PREFIX}"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none:"), digest)), F.lit(">"))


def write_archive(decided: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the records of :func:`with_decision` with fresh headers; the tables hold no date, so one is given."""
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(LINE + LINE)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Target-URI", uri),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{RECORD_PREFIX}"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("Content-Type", F.lit(HTTP_TYPE)),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = F.concat(F.lit(VERSION + LINE), *[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit("")) for name, value in fields], F.lit(LINE))
    decided.select(F.concat(head, block).alias("value")).write.option("lineSep", LINE + LINE).option("compression", "gzip").text(path)


def parse_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the content block of each record, read by its length, whatever the block contains."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.read(int(headers["content-length"]))


def _page_of(record_id: str | None) -> int | None:
    number = (record_id or "").strip("<>").removeprefix(RECORD_PREFIX)
    return int(number) if number.lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    intact = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return (
        _page_of(headers["warc-record-id"]), kind, headers["warc-target-uri"], _page_of(headers.get("warc-refers-to")), size, digest,
        payload if payloads and kind != "revisit" else None, intact,
    )


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of an archive folder, each checked against its digest (``intact``).

    A file is decompressed and parsed as a stream; rows leave in batches of
    bounded size. ``payload`` is null for revisits and if not asked for.
    """
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as raw, io.BufferedReader(raw, 1 << 20) as source:
                    for headers, block in parse_records(source):
                        rows.append(_row(headers, block, payloads))
                        held += len(block)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    bounded_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parsed, RECORD_COLUMNS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``original_id``, the page whose response has the payload of a revisit; null for responses.

    Headers alone are joined, by payload digest; responses are reduced to one
    row a digest first, so a revisit never meets two of them.
    """
    originals = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("_original"))
    found = F.when(F.col("record_type") == "revisit", F.col("_original"))
    return records.join(originals, "payload_digest", "left").withColumn("original_id", found).drop("_original")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write a record per page to an archive, read it back, and resolve its revisits.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url``, all taken from the archive. Of equal payloads of at least
    ``min_bytes`` bytes the page with the largest id is the response.

    * null html is the empty payload; a null url is an empty target.
    * a page with a null id revisits a page that has one; among themselves all
      such pages are responses.
    * rows that repeat the responding page's id and payload are responses too.
    * an empty table gives an empty archive and an empty result.
    * a record whose payload does not have its digest raises an error.
    """
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archive(with_decision(pages, min_bytes), path)
    resolved = resolve_revisits(read_archive(spark, path, payloads=False))
    broken = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    kind = F.when(F.col("intact") & F.col("refers_to").eqNullSafe(F.col("original_id")), F.col("record_type")).otherwise(broken)
    return resolved.select(
        "page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("original_id").alias("refers_to"), F.col("target_uri").alias("url")
    )

"""SimHash near-duplicates found by hashing the ball around every fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wardflow.llm.common import bounded_batches, byte_values, connected, pick, stored

SHINGLE_WORDS = 3
HASH_SEED = 42
BITS = 64
BLOCK = 1 << 16


def simhash(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: bit i is set if it is set in over half the hashes of its word shingles.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space.
    A text of fewer words than a shingle is one shingle; without words it is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(line, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), BLOCK):
        octets = values[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t) for t in byte_values(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints)], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long, ``print``."""
    bounded_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_fingerprints, "doc_id long, print long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the distinct fingerprints within two bits of each other.

    Every fingerprint emits itself and its 64 neighbours at one bit, half the
    radius. Two fingerprints within two bits share such a variant, and all
    that share one are within two bits of each other. A variant thus meets 65
    fingerprints at most, whatever the data, and linking each of them to the
    smallest is enough to connect them all. The links are verified by their
    distance.
    """
    variants = [F.col("print")] + [F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]
    ball = prints.select("print", F.explode(F.array(*variants)).alias("variant"))
    met = ball.select("print", F.min("print").over(Window.partitionBy("variant")).alias("first"))
    links = met.filter("print <> first").select(F.col("print").alias("a"), F.col("first").alias("b")).distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and the component of near-duplicates it belongs to.

    Fingerprints link at two or fewer differing bits; components are those of
    the links. Only distinct fingerprints take part in the search, so a group
    of copies counts once however large it is.

    Returns ``doc_id, fingerprint`` (16 lower-case hex digits) and
    ``component_id``, the smallest ``doc_id`` of the component.

    * null and empty texts have fingerprint zero and link like any other.
    * rows with a null id take part; a component of nothing else has a null id.
    * repeated rows give repeated rows; an empty table gives an empty result.
    """
    marked = stored(fingerprints(docs))
    nodes = marked.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = connected(ball_links(nodes.select("print")))
    member = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = member.join(named, "root").select("print", "component_id")
    return marked.join(component, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

"""Exact duplicates by a 128-bit content hash, with a comparison of the bytes behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.llm.common import ascii_lower, pick
from wardflow.session import materialize


def leading_128_bits(sha256: Column) -> Column:
    """The first 128 bits of the content's SHA-256."""
    return F.unhex(F.substring(sha256, 1, 32))


def exact_dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = leading_128_bits) -> DataFrame:
    """One row per document: the class of equal texts it belongs to and whether it stays.

    Texts are equal when they are identical after lower-casing A-Z. Documents
    are grouped by (hash, text), so the bytes inside a hash group are compared
    by the grouping itself and copies are merged inside each task before the
    shuffle: a text with a third of all rows crosses it once per task. Hashes
    that turn out to hold different texts are resolved by text, all others by
    hash alone; the join back on a hot hash is an equi join that AQE can split.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.

    * ``keep``: ``"largest"`` or ``"smallest"`` id of the class stays.
    * null text is the empty text, which forms a class of its own.
    * null ``doc_id`` counts in ``group_size`` and never stays unless the class
      has no other id; ``keep_id`` is then null and every such row stays.
    * a row that repeats an id and its text is the same document: both rows
      are counted, and both stay or go.
    * an empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    normal = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    keyed = (
        pick(docs, "doc_id", "text")
        .select("doc_id", normal.alias("normal"))
        .withColumn("text_sha256", F.sha2(F.col("normal").cast("binary"), 256))
        .withColumn("hash", digest(F.col("text_sha256")))
    )
    classes = keyed.groupBy("hash", "normal").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
    by_hash = materialize(
        classes.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("group_size").alias("group_size"), best("keep_id").alias("keep_id"))
    )
    plain = by_hash.filter("texts = 1").drop("texts")
    shared = by_hash.filter("texts > 1").select("hash")
    members = keyed.drop("normal").join(plain, "hash")
    if not shared.isEmpty():
        several = keyed.join(shared, "hash")
        texts = several.groupBy("hash", "normal").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
        members = members.unionByName(several.join(texts, ["hash", "normal"]).drop("normal"))
    return members.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

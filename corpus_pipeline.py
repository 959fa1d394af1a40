"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

The first four return rows of ``documents`` with its columns; the last one
returns the pieces of the packed sequences. SQL cannot express the language
model, the tokenizer and the packing, so there is no ``ORACLE_SQL``; the
stages are tested against brute force.

A row is dropped or kept by its ``doc_id``. Rows without an id cannot be told
apart by it: they stay if one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.llm.common import stored
from wardflow.llm.decontamination import find_leaks
from wardflow.llm.exact_dedup import exact_dedup
from wardflow.llm.language_id import keep_identified, learned_from
from wardflow.llm.near_copies import near_copies
from wardflow.llm.packing import pack
from wardflow.llm.registered import oracle_sql as operator_sql, queries as operator_queries, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join with ids whose number grows with the documents: a merge join at every size."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or not a letter in it) go."""
    docs = docs.select(*COLUMNS)
    return keep_identified(docs, learned_from(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays; of rows that repeat it, one."""
    docs = docs.select(*COLUMNS)
    kept = stored(exact_dedup(docs).filter("kept").select("doc_id"))
    left = _with_ids(docs, kept, "left_semi")
    if kept.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    return left.dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, the one with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    return _with_ids(docs, near_copies(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that resembles a benchmark item go."""
    docs = docs.select(*COLUMNS)
    return _with_ids(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return operator_queries() | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return operator_sql() | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})

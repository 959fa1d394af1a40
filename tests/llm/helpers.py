"""Small awkward tables, and brute-force versions of the operators."""

import itertools

from pyspark.sql import SparkSession, functions as F

from wardflow.llm.simhash_dedup import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(60_000))

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "THE quick brown fox jumps over the lazy dog", "en", "a", 43),
    (3, "", "en", None, 0),
    (4, None, None, None, None),
    (5, "   \n\t ", "de", "a", 6),
    (6, "été", "fr", "b", 3),
    (6, "été", "fr", "b", 3),
    (None, "no id here at all", "en", "b", 17),
    (None, None, "en", "b", None),
    (7, LONG, "en", "a", len(LONG)),
    (8, "x" * 500, "en", "a", 500),
    (9, "\x00nul \x01 bytes ÉTÉ", "fr", "a", 5),
    (-3, "negative id", "en", "a", 11),
]


def awkward(spark: SparkSession):
    """Rows with nulls, repeats and long texts, and columns whose names clash with those of the operators."""
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("Text", "hash", "print", "fingerprint", "component_id", "rank", "class", "keep_id", "number", "unit", "score", "h"):
        docs = docs.withColumn(name, F.lit("other")) if name != "Text" else docs.select("*", F.lit("other").alias("Text"))
    return docs


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def linked_components(docs: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component) by comparing all pairs of fingerprints."""
    prints = [(d, simhash((t or "").encode())) for d, t in docs]
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=repr)

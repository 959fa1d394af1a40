"""Language identification that infers the mixture of languages in each document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.common import bounded_batches, byte_values, pick, remainder

UNDETERMINED = "und"
#: Byte trigrams are hashed into this many buckets, which bounds the model by the number of languages alone.
BUCKETS = 1 << 16
#: Added to every count of a bucket.
SMOOTHING = 0.5
#: Gain in log-likelihood per language that a larger set has to bring, as a multiple of log(trigrams).
PENALTY = 8.0
#: Trigrams of one block of a text; a longer text is counted block by block.
BLOCK = 1 << 20
ROUNDS, SETTLED = 30, 1e-4

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c

ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of each byte trigram; ASCII letters are folded, other ASCII bytes count as blanks."""
    folded = _FOLD[data].astype(np.uint32)
    if len(folded) < 3:
        folded = np.concatenate((folded, np.full(3 - len(folded), 32, np.uint32)))
    mixed = (folded[:-2] * np.uint32(0x9E3779B1)) ^ (folded[1:-1] * np.uint32(0x85EBCA77)) ^ (folded[2:] * np.uint32(0xC2B2AE3D))
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of all buckets over a whole text."""
    data = np.frombuffer(text, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data) - 2), BLOCK):
        total += np.bincount(trigram_buckets(data[at : at + BLOCK + 2]), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    """``shares[bucket, language]``: probability of a trigram bucket in each language."""

    languages: tuple[str, ...]
    shares: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def emit():
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), byte_values(batch.column("text"))):
            if lang not in totals:
                if len(totals) == 64:
                    yield from emit()
                totals[lang] = np.zeros(BUCKETS, np.int64)
            totals[lang] += trigram_counts(text)
    yield from emit()


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """Learn trigram shares from all rows of ``text, lang``; rows with a null are left out.

    Counts are added up inside each task and then by (language, bucket), so
    what reaches the driver is bounded by languages times buckets.
    """
    bounded_batches(labelled.sparkSession)
    rows = pick(labelled, "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(counts.column("lang").to_pylist())))
    totals = np.zeros((BUCKETS, len(languages)))
    if languages:
        code = {lang: i for i, lang in enumerate(languages)}
        totals[counts.column("bucket").to_numpy(), [code[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    totals += SMOOTHING
    return LanguageModel(languages, totals / totals.sum(0))


def _fit(shares: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions of some languages; their log-likelihood."""
    share, n = start, counts.sum()
    for _ in range(ROUNDS):
        updated = share * (shares.T @ (counts / (shares @ share))) / n
        moved = np.abs(updated - share).max()
        share = updated
        if moved < SETTLED:
            break
    return share, float(counts @ np.log(shares @ share))


def mixture(model: LanguageModel, text: bytes) -> dict[str, float]:
    """The languages of a text with their proportions.

    The set starts with the single likeliest language. The language whose
    addition raises the likelihood most steeply is tried next, the proportions
    are fitted by expectation-maximisation, and it stays if the gain exceeds
    the penalty for a larger set.
    """
    total = trigram_counts(text)
    at = np.flatnonzero(total)
    counts, shares = total[at].astype(float), model.shares[at]
    n = counts.sum()
    single = counts @ np.log(shares)
    chosen = [int(single.argmax())]
    share, likelihood = np.ones(1), float(single.max())
    while len(chosen) < len(model.languages):
        slope = shares.T @ (counts / (shares[:, chosen] @ share)) - n
        slope[chosen] = -np.inf
        added = int(slope.argmax())
        if slope[added] <= 0:
            break
        start = np.append(share * 0.9, 0.1)
        tried, reached = _fit(shares[:, [*chosen, added]], counts, start)
        if reached - likelihood <= PENALTY * np.log(n + 1):
            break
        chosen, share, likelihood = [*chosen, added], tried, reached
    return {model.languages[i]: float(s) for i, s in zip(chosen, share)}


def predict(model: LanguageModel, text: bytes | None) -> tuple[str, float]:
    """The language with the largest proportion, the first by name of equal ones, and that proportion."""
    if not text or not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    lang, share = min(mixture(model, text).items(), key=lambda x: (-x[1], x[0]))
    return lang, min(1.0, max(0.0, share))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document from its whole text alone.

    ``score`` is the proportion of the predicted language in the document.
    Null texts and texts without a letter are ``und`` with score 0, as is
    everything if nothing was learned. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t) for t in byte_values(batch.column("text"))]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; those that are ``und`` go.

    If nothing was learned no text can be told, and only texts without a letter go.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = byte_values(batch.column("text")), shared.value.languages
            stay = [predict(shared.value, t)[0] != UNDETERMINED if known else bool(t) and has_letter(t) for t in texts]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def learned_from(docs: DataFrame) -> LanguageModel:
    """The model of the documents that are not held out."""
    return fit_languages(pick(docs, "doc_id", "text", "lang").filter(remainder(F.col("doc_id"), 4) != 2))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the documents that are not held out.

    Held out are ids whose crc32 (of the id as text) is 2 modulo 4. A row with
    a null id is not held out, but nothing is learned from it.
    """
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, learned_from(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

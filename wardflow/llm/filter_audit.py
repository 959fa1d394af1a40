"""Filter interaction audit: what each of five document filters removes, in every order they can be applied in.

One pass marks which filters a document fails; documents are then only
counted by part and mask, at most 32 cells a part. All subsets of filters are
walked in Gray-code order, and any step of any order is a difference of two
of the 32 stored states.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.common import UPPER, bounded_batches, byte_values, pick, stored

#: The filters, in the order of the bits of a mask.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SYMBOLS = b"#$%&*|"
#: Counts of a cell, and of a state of the walk.
COUNTS = ["n", "good", "toxic"]

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails by itself.

    A: fewer than 200 words. B: under half of the words distinct. C: over
    three percent of the code points are A-Z. D: one of ``#$%&*|`` occurs.
    Words are runs of bytes other than ASCII white space.
    """
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * upper > UPPER_PERCENT * points,
        any(bytes([b]) in text for b in SYMBOLS),
    )
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_values(batch.column("text"))
        columns = [
            batch.column("doc_id").cast(pa.int64()),
            batch.column("part").cast(pa.string()),
            pa.array([own_failures(t) for t in texts], pa.int32()),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "own", "digest"])


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic``: a row for every document.

    Equal texts are found by their SHA-256. Only digests that occur more than
    once are joined back, and what is joined holds no text, so a hot group is
    an ordinary skewed join of narrow rows.
    """
    bounded_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part"))
    marked = base.mapInArrow(_mark, "doc_id long, part string, own int, digest binary")
    judged = pick(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = stored(marked.join(judged, marked["doc_id"] == judged["_id"], "left").select(
        "doc_id", "part", "own", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    copies = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").select("digest", "first_id"))
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    mask = F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(copies, "digest", "left").select("part", mask.alias("mask"), "good", "toxic")


def subset_states(masks: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """What survives each subset of the filters: a row of counts for every subset, indexed by its bits.

    The subsets are visited in Gray-code order, so that each step toggles one
    filter. A cell keeps the number of active filters it fails; it leaves the
    running survivors when that number becomes one and returns when it is zero again.
    """
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(0)
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    states[0], subset = running, 0
    for step in range(1, 1 << filters):
        toggled = step & -step
        subset ^= toggled
        fails = masks & toggled != 0
        if subset & toggled:
            running = running - counts[fails & (active == 0)].sum(0)
            active[fails] += 1
        else:
            active[fails] -= 1
            running = running + counts[fails & (active == 0)].sum(0)
        states[subset] = running
    return states


def order_rows(part: str, masks: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """All steps of all orders of the filters for one part."""
    states = subset_states(masks, counts)
    failing = [int(counts[masks & (1 << f) != 0, 0].sum()) for f in range(len(FILTERS))]
    alone = [int(counts[masks == 1 << f, 0].sum()) for f in range(len(FILTERS))]
    shapley, rows = [0] * len(FILTERS), []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            rows.append((part, name, step, int(states[after][0]), removed, failing[f] - removed, alone[f], good, toxic, f))
            shapley[f] += removed
            before = after
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


def _walk(cells: pd.DataFrame) -> pd.DataFrame:
    rows = order_rows(cells["part"].iloc[0], cells["mask"].to_numpy(np.int64), cells[COUNTS].to_numpy(np.int64))
    return pd.DataFrame(rows, columns=[field.split()[0] for field in RESULT.split(",")])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, for each part of the documents.

    Returns one row for each part (value of ``lang``), order of the five
    filters and step. E fails a document whose text equals that of a smaller
    ``doc_id`` anywhere in the table.

    * null texts are empty: they fail A and, but for the smallest id among them, E. A null ``lang`` is the part "".
    * rows with a null id never fail E and have no label; rows that repeat an id and its text are counted one by one, and none is the earlier.
    * of several label rows for an id, one with quality or toxic 1 is enough; ids without labels are neither.
    * an empty table has no parts, so it gives an empty result.
    """
    cells = failure_masks(docs, labels).groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    return cells.groupBy("part").applyInPandas(_walk, RESULT)

"""Packing of tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardflow.llm.common import bounded_batches, groups_of_bytes, pick, ranks, stored

CAPACITY = 2048
END_ID = 1
#: Width of a class of the length histogram; a piece counts as the upper end of its class.
CLASS_WIDTH = 2
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text whose words are held at a time.
TEXT_BYTES = 1 << 20
ROW_BLOCK = 50_000
#: The search ends when the program's value falls by less than the gap over so many pivots.
TAIL = 200

# --- tokens -----------------------------------------------------------------------------------------------------------

# How the byte-level vocabulary splits text before its merges, over the letters, digits and white space up to U+00FF.
_LETTER, _DIGIT, _BLANK = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0"
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
#: Texts with other characters, or with the string of the special token, go to the tokenizer whole.
OTHER = re.compile(r"[^\x00-\xff]|<\|endoftext\|>")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """A tokenizer, and the packed ids of the words it has been asked for."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def packed_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of whole texts as little-endian unsigned 32-bit numbers, each with the id that ends a document.

    Words are looked up; those not seen before go to the tokenizer together.
    The first words to come are remembered, up to a bound, others are not.
    """
    tokenizer, known = _tokenizer(path)
    split = [None if OTHER.search(t) else WORD.findall(t) for t in texts]
    unseen = list(set().union(*(w for w in split if w)).difference(known))
    encoded = tokenizer.encode_batch_fast(unseen, add_special_tokens=False)
    fresh = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(unseen, encoded)}
    known.update(fresh)
    end = END_ID.to_bytes(4, "little")
    packed = [
        (b"".join(map(known.__getitem__, words)) if words is not None else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) + end
        for t, words in zip(texts, split)
    ]
    if len(known) > REMEMBERED:
        for word in fresh:
            del known[word]
    return packed


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document cut into pieces of a full sequence and one shorter rest, with the checksum of their ids.

    Tokens stay in the task that made them: where the cuts lie depends on the
    length of the document alone.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_bytes(batches, TEXT_BYTES):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), packed_ids(texts, tokenizer_path)):
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], list(names))

    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# --- patterns ---------------------------------------------------------------------------------------------------------


def price_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence: a knapsack with repetition, solved over all capacities.

    ``sizes`` are in units of the class width. Each size is taken as often as
    it fits; ``choice`` remembers the last piece of the best filling.
    """
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    reach = sizes[useful]
    for room in range(1, capacity + 1):
        fits = useful[: np.searchsorted(reach, room, side="right")]
        best[room], choice[room] = best[room - 1], -1
        if len(fits):
            gains = best[room - sizes[fits]] + values[fits]
            top = int(gains.argmax())
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], fits[top]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def longest_first(left: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A sequence filled with the longest pieces that are left, as long as they fit."""
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for c in np.flatnonzero(left >= 1e-9)[::-1].tolist():
        pattern[c] = min(max(1, int(left[c])), room // int(sizes[c]))
        room -= int(pattern[c] * sizes[c])
        if room < sizes[0]:
            break
    return pattern


def starting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern per class: each is used until a class is exhausted, and later ones do without that class.

    The matrix of the patterns is thus triangular up to order, and a basis.
    """
    left, basis = demand.astype(float), np.zeros((len(sizes), len(sizes)))
    while (left >= 1e-9).any():
        pattern = longest_first(left, sizes, capacity)
        used = pattern > 0
        times = (left[used] / pattern[used]).min()
        left[used] -= times * pattern[used]
        for place, c in enumerate(np.flatnonzero(used & (left < 1e-9)).tolist()):
            basis[:, c] = pattern if place == 0 else 0
            basis[c, c] = pattern[c] if place == 0 else capacity // sizes[c]
            left[c] = 0
    return basis


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often to use them, from the linear program that covers a demand by the fewest sequences.

    The simplex method keeps one pattern per class. The prices of the classes
    are the duals; the knapsack finds the pattern worth most, which enters the
    basis if it is worth more than the one sequence it costs. The program's
    value divided by that worth bounds the optimum from below, as does the
    total length. The search ends at a small gap to the bound, when no pattern
    is worth more than it costs, or when the last ``TAIL`` pivots have gained less than the gap.
    """
    basis = starting_patterns(sizes, demand, capacity)
    inverse = np.linalg.inv(basis)
    amounts = np.maximum(inverse @ demand, 0)
    bound = float(sizes @ demand) / capacity
    step, earlier = 0, math.inf
    while amounts.sum() > bound * (1 + gap):
        if step % TAIL == 0:
            if earlier - amounts.sum() <= max(gap, 1e-9) * amounts.sum():
                break
            earlier = amounts.sum()
        step += 1
        prices = inverse.sum(0)  # every sequence costs one
        worth, pattern = price_pattern(np.maximum(prices, 0), sizes, capacity)
        bound = max(bound, amounts.sum() / max(worth, 1.0))
        direction = inverse @ pattern
        rising = direction > 1e-9
        if worth <= 1 + 1e-9 or not rising.any():
            break
        ratio = np.where(rising, amounts / np.where(rising, direction, 1), np.inf)
        leaving = int(ratio.argmin())
        basis[:, leaving] = pattern
        least = ratio[leaving]
        amounts = np.maximum(amounts - least * direction, 0)
        amounts[leaving] = least
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        if step % 200 == 0:
            inverse = np.linalg.inv(basis)
            amounts = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), amounts


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each class go.

    Use ``p`` of the patterns makes ``times[p]`` sequences from ``first[p]``
    on. The pieces of class ``c``, counted from 0, fill the entries of the
    class in order: entry ``e`` takes ``ends[c][e] - ends[c][e-1]`` of them,
    ``each[c][e]`` in a sequence, for the sequences from ``base[c][e]`` on.
    """

    ends: list[np.ndarray]
    each: list[np.ndarray]
    base: list[np.ndarray]
    sequences: int


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Round the patterns of the linear program down, and fill further sequences with what is left, longest first."""
    ends: list[list[int]] = [[] for _ in sizes]
    each: list[list[int]] = [[] for _ in sizes]
    base: list[list[int]] = [[] for _ in sizes]
    left = demand.astype(np.int64).copy()
    sequences = 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequences
        for c in np.flatnonzero(pattern).tolist():
            taken = int(min(left[c], pattern[c] * times))
            if taken:
                ends[c].append((ends[c][-1] if ends[c] else 0) + taken)
                each[c].append(int(pattern[c]))
                base[c].append(sequences)
                left[c] -= taken
        sequences += times

    present = np.flatnonzero(demand)
    if len(present):
        patterns, amounts = generate_columns(sizes[present], demand[present].astype(float), capacity)
        for pattern, amount in zip(patterns, np.floor(amounts + 1e-9).astype(np.int64)):
            if amount:
                full = np.zeros(len(sizes), np.int64)
                full[present] = pattern
                use(full, int(amount))
    while left.any():
        pattern = longest_first(left, sizes, capacity)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        use(pattern, max(1, times))
    arrays = lambda rows: [np.array(r, np.int64) for r in rows]
    return Plan(arrays(ends), arrays(each), arrays(base), sequences)


def planned(histogram: DataFrame, units: int) -> Plan:
    """The plan for a histogram of ``class, n``, made in one task: it has a row per class, however many documents there are.

    What comes back has a few entries per pattern and no more patterns than
    classes, but for the sequences filled at the end.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        demand = np.zeros(units, np.int64)
        for batch in batches:
            demand[batch.column("class").to_numpy()] = batch.column("n").to_numpy()
        made = plan_sequences(np.arange(1, units + 1), demand, units)
        sizes = [len(e) for e in made.ends]
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (made.ends, made.each, made.base)]
        data = [np.append(np.repeat(np.arange(units), sizes), -1), *[np.append(c, made.sequences) for c in columns]]
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)) for d in data], ["class", "end", "each", "base"])

    rows = histogram.coalesce(1).mapInArrow(plan, "class long, end long, each long, base long").toArrow().to_pydict()
    kind = np.array(rows["class"], np.int64)
    parts = {n: np.array(rows[n], np.int64) for n in ("end", "each", "base")}
    split = {n: [v[kind == c] for c in range(units)] for n, v in parts.items()}
    return Plan(split["end"], split["each"], split["base"], int(parts["end"][kind == -1].sum()))


# --- the operator -----------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> DataFrame:
    """Pieces of documents, packed into sequences of at most ``capacity`` tokens.

    A document is its ids and the id that ends it. It is cut into full
    sequences and a rest; the rests are what is packed. Their lengths are
    counted in classes, a linear program over patterns of classes is solved by
    column generation on the driver (its size is the number of classes, not
    of documents), and the patterns are dealt to the documents by their rank
    in their class. Ranks are made in blocks, so a class may hold any share of
    the documents. A sequence holds ``capacity`` pieces at most, and its
    offsets come from a window over those.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and ``padding``, the padding of the sequence (0 at a power of two).

    * null text is empty: a document of the ending id alone.
    * null ids are packed like others; repeated rows are packed repeatedly.
    * an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity))
    full = cut.filter(F.col("length") == capacity)
    rests = cut.filter(F.col("length") < capacity).withColumn("class", F.ceil(F.col("length") / F.lit(width)).cast("long") - 1)
    plan = planned(rests.groupBy("class").agg(F.count("*").alias("n")), capacity // width)
    shared = spark.sparkContext.broadcast(plan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                at = np.flatnonzero(kind == c)
                ends = shared.value.ends[c]
                entry = np.searchsorted(ends, rank[at], side="right")
                before = rank[at] - np.append(0, ends)[entry]
                sequence[at] = shared.value.base[c][entry] + before // shared.value.each[c][entry]
            columns = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = ranks(rests, "class", order, ROW_BLOCK).mapInArrow(assign, schema)
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order)
    offset = F.sum("length").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    placed = placed.select("*", offset.alias("offset"), total.alias("_total"))
    padding = F.when(F.bit_count("_total") == 1, F.lit(0)).otherwise(F.lit(capacity) - F.col("_total")).cast("long")
    numbered = ranks(full.withColumn("class", F.lit(0)), "class", order, ROW_BLOCK)
    alone = numbered.select(*order[:1], "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("padding"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padding.alias("padding")).unionByName(alone)

"""Removal of byte strings that occur earlier in the corpus, with suffix orders of the places where they can."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.common import bounded_batches, byte_values, pick, stored
from wardflow.llm.suffix_groups import joined_texts, suffix_order, words_at

#: Bytes of a string that must not occur twice.
LENGTH = 100
#: Bytes of the anchor: of all such grams of a string, the one with the smallest hash.
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Bytes hashed together; positions inside take the low bits of a hash.
BLOCK = 1 << 18
LOW = np.uint64((1 << 20) - 1)
#: Bytes whose suffixes are sorted together, and distinct stretches a bucket may have before it is split.
SORTED_BYTES = 400_000
BUCKET_ROWS = 20_000

_RANDOM = np.random.default_rng(11)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 2 * LENGTH, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position."""
    out, width = _BYTE[data], 1
    while width < GRAM:
        out = out[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + out[width:]
        width *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(29)
    return out


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of some texts: consecutive strings of ``LENGTH`` bytes that have the same anchor.

    Returns row, start in the row, number of strings, offset of the anchor, hash
    of the anchor, and a hash of the content from the first byte of the first
    string to the last of the last. Equal strings have equal anchors at
    equal offsets wherever they stand, so they meet under the anchor's hash.
    """
    size = len(data)
    if size < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    hashes = gram_hashes(data)
    least = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    anchor = (least & LOW).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    anchor[np.arange(len(anchor)) + LENGTH > bounds[1:][row]] = -1
    cut = np.flatnonzero(np.diff(anchor)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(anchor))
    inside = anchor[starts] >= 0
    starts, ends = starts[inside], ends[inside]
    prefix = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[:size], out=prefix[1:])
    content = (prefix[ends - 1 + LENGTH] - prefix[starts]) * _INVERSE[starts]
    content ^= content >> np.uint64(31)
    at = row[starts]
    return at, starts - bounds[at], ends - starts, anchor[starts] - starts, hashes[anchor[starts]], content


def _blocks(texts: Iterable[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts put together to blocks: index of the first, offset in it, pieces. A long text is cut so that no string is lost or met twice."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BLOCK:
            yield first, 0, held
            held, size = [], 0
        if len(text) > BLOCK:
            step = BLOCK - LENGTH + 1
            for at in range(0, len(text) - LENGTH + 1, step):
                yield i, at, [text[at : at + BLOCK]]
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text)
    if held:
        yield first, 0, held


def text_stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`stretches` of texts of any length, block by block."""
    for first, offset, pieces in _blocks(texts):
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=bounds[1:])
        row, start, count, lead, anchor, content = stretches(np.frombuffer(b"".join(pieces), np.uint8), bounds)
        yield row + first, start + offset, count, lead, anchor, content


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


# --- the order of documents -------------------------------------------------------------------------------------------


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, text, number`` and the bits of a position; ``number << bits | start`` orders all places of the corpus.

    The number is the id itself where ids are unique, not negative and fit
    beside a start. Otherwise documents are numbered by id (null last) and
    content; rows that repeat an id and its text are one document.
    """
    base = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    print_ = F.xxhash64("text")
    ids = base.groupBy("doc_id").agg(F.min(print_).alias("low"), F.max(print_).alias("high"), F.max(F.octet_length("text")).alias("size"))
    facts = ids.agg(
        F.max("size").alias("size"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
        F.count_if(F.expr("low <> high OR doc_id IS NULL")).alias("shared"),
    ).first()
    bits = max(1, int(facts["size"] or 1).bit_length())
    if not facts["shared"] and (facts["least"] is None or facts["least"] >= 0 and int(facts["most"]).bit_length() + bits <= 63):
        return base.withColumn("number", F.col("doc_id")), bits
    keys = base.select("doc_id", print_.alias("_print")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "_print")
    order = stored(keys.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("id long, print long, number long"))
    return base.join(order, base["doc_id"].eqNullSafe(order["id"]) & (print_ == order["print"])).select("doc_id", "text", "number"), bits


# --- suffix orders of the places with the same anchor -----------------------------------------------------------------


def _shared_reach(rows: np.ndarray, lengths: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each row of bytes the longest beginning it shares with another row of its bucket."""
    words = rows.view(">u8")
    order = np.lexsort([words[:, i] for i in range(words.shape[1] - 1, -1, -1)] + [buckets])
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common = np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1]))
    common[buckets[order][1:] != buckets[order][:-1]] = 0
    out = np.zeros(len(rows), np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def repeated_strings(buckets: np.ndarray, keys: np.ndarray, leads: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Strings of some stretches that also start earlier: the key of the first and the number of consecutive ones.

    A stretch is trimmed to what it shares to the left and to the right of
    its anchor with any other of its bucket; if that is shorter than a string
    it has none. The suffixes of the rest are put in order, and of the strings
    that stand together in it all but the first of the corpus are repeats.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    data = np.frombuffer(b"".join(texts) + bytes(2 * LENGTH + 8), np.uint8)
    to_right, to_left = np.arange(LENGTH + 4), np.arange(1, SPAN + 4)
    anchors = (starts + leads)[:, None]
    right = np.where(to_right < (lengths - leads)[:, None], data[np.minimum(anchors + to_right, len(data) - 1)], 0).astype(np.uint8)
    left = np.where(to_left <= leads[:, None], data[np.maximum(anchors - to_left, 0)], 0).astype(np.uint8)
    after = _shared_reach(np.ascontiguousarray(right), lengths - leads, buckets)
    before = _shared_reach(np.ascontiguousarray(left), leads, buckets)
    kept = np.flatnonzero(before + after >= LENGTH)
    first_keys = keys[kept] + leads[kept] - before[kept]
    kept = kept[np.argsort(first_keys, kind="stable")]
    found_keys, found_counts = [], []
    distinct: dict[tuple[int, bytes], int] = {}
    for i in kept.tolist():
        text = texts[i][leads[i] - before[i] : leads[i] + after[i]]
        key = int(keys[i] + leads[i] - before[i])
        # The same place read twice (a repeated row) is no repeat of itself.
        if distinct.setdefault((int(buckets[i]), text), key) != key:
            found_keys.append(key)
            found_counts.append(len(text) - LENGTH + 1)
    out_keys, out_counts = [np.array(found_keys, np.int64)], [np.array(found_counts, np.int64)]
    if distinct:
        trimmed, firsts = [t for _, t in distinct], np.array(list(distinct.values()), np.int64)
        more = _repeats_in_order(trimmed, firsts)
        out_keys.append(more[0])
        out_counts.append(more[1])
    return np.concatenate(out_keys), np.concatenate(out_counts)


def _repeats_in_order(texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The repeats among texts that stand in the order of the corpus."""
    data, starts = joined_texts(texts)
    words = words_at(data)
    order = suffix_order(data, starts, words)
    ends = np.repeat(starts[1:] - 1, np.diff(starts))
    strings = order[ends[order] - order >= LENGTH]
    same = np.ones(len(strings) - 1, bool)
    for shift in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[strings[1:] + shift] == words[strings[:-1] + shift]
    heads = np.flatnonzero(np.append(True, ~same))
    first = np.minimum.reduceat(strings, heads)
    repeats = np.sort(strings[strings != np.repeat(first, np.diff(np.append(heads, len(strings))))])
    if not len(repeats):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(starts, repeats, side="right") - 1
    cut = np.append(True, (np.diff(repeats) != 1) | (np.diff(text) != 0))
    at = np.flatnonzero(cut)
    return keys[text[at]] + repeats[at] - starts[text[at]], np.diff(np.append(at, len(repeats)))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; whole buckets are taken together until they hold ``SORTED_BYTES``."""
    buckets, keys, leads, texts, size = [], [], [], [], 0

    def solved():
        key, count = repeated_strings(np.array(buckets, np.int64), np.array(keys, np.int64), np.array(leads, np.int64), texts)
        return _batch(key=key, strings=count)

    for batch in batches:
        columns = (batch.column("bucket").to_pylist(), batch.column("key").to_pylist(), batch.column("lead").to_pylist(), byte_values(batch.column("content")))
        for bucket, key, lead, text in zip(*columns):
            if size > SORTED_BYTES and bucket != buckets[-1]:
                yield solved()
                buckets, keys, leads, texts, size = [], [], [], [], 0
            buckets.append(bucket)
            keys.append(key)
            leads.append(lead)
            texts.append(text)
            size += len(text)
    if texts:
        yield solved()


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut stretches in two by the offset of the anchor in their strings, and rename their buckets by what all strings of a half contain."""
    for batch in batches:
        rows = []
        names = ("key", "lead", "low", "high")
        for (key, lead, low, high), text in zip(zip(*(batch.column(n).to_pylist() for n in names)), byte_values(batch.column("content"))):
            middle = (low + high + 1) // 2
            for a, b in ((middle, high), (low, middle - 1)):
                first, last = max(0, lead - b), min(len(text) - LENGTH, lead - a)
                if a <= b and first <= last:
                    core = text[lead - a : lead - b + LENGTH]
                    name = xxhash.xxh64_intdigest(core, a) - (1 << 63)
                    rows.append((name, key + first, lead - first, a, b, text[first : last + LENGTH]))
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield _batch(**{n: pa.array(v, k) for n, v, k in zip(("bucket", "key", "lead", "low", "high", "content"), columns, kinds)})


_STRETCH = "bucket long, key long, lead long, low long, high long, content binary"


def split_buckets(hot: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Split buckets with more than ``most`` distinct stretches until each is small.

    A half keeps the strings whose anchor lies in one half of the offsets, so
    its strings have more bytes in common, which name its bucket; equal
    stretches of a bucket are merged. After seven halvings a stretch is one
    string and every bucket has one stretch. Returns the small buckets that
    are left to sort, and the repeats found by merging.
    """
    ready, repeats = None, None
    while not hot.isEmpty():
        parts = stored(hot.select(*[c.split()[0] for c in _STRETCH.split(", ")]).mapInArrow(_halves, _STRETCH))
        firsts = parts.groupBy("bucket", "content").agg(F.min("key").alias("first"), F.min("lead").alias("lead"), F.min("low").alias("low"), F.min("high").alias("high"))
        found = parts.join(firsts.select("bucket", "content", "first"), ["bucket", "content"]).filter("key <> first")
        found = found.select("key", (F.length("content") - (LENGTH - 1)).cast("long").alias("strings"))
        counts = firsts.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        left = stored(firsts.withColumnRenamed("first", "key").join(counts, "bucket"))
        small = left.filter(F.col("n") <= most).drop("n")
        hot = left.filter(F.col("n") > most)
        ready = small if ready is None else ready.unionByName(small)
        repeats = found if repeats is None else repeats.unionByName(found)
    return ready, repeats


# --- the operator -----------------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document what is left when each byte covered by a string of ``LENGTH`` bytes that starts earlier is removed.

    1. Every text is cut into stretches of strings with the same anchor. They
       are grouped by (anchor, content), and the first of equal ones is kept:
       all strings of the others start earlier, too. Copies are merged in each
       task before the shuffle, so a group of copies may have any size.
    2. Anchors with several different first stretches are looked into: those
       stretches are sent to the task of their anchor, where the suffixes of
       what they may share are put in order. An anchor with very many is
       split first (:func:`split_buckets`).
    3. Each text is read again with its first stretches and its repeats.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    * null text is empty; texts shorter than a string are kept whole.
    * earlier is: smaller ``doc_id``, or same document and earlier start; a
      null id comes last, texts of equal ids are ordered by a hash.
    * rows that repeat an id and its text are one document and get equal results.
    * an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base, bits = numbered(docs)
    mask = (1 << bits) - 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("number").to_numpy()
            for row, start, _, _, anchor, content in text_stretches(byte_values(batch.column("text"))):
                yield _batch(anchor=anchor.view(np.int64), content=content.view(np.int64), key=(number[row] << bits) | start)

    def wanted_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, number = byte_values(batch.column("text")), batch.column("number").to_numpy()
            wanted, hot = batch.column("starts").to_pylist(), batch.column("hot").to_pylist()
            for row, start, count, lead, anchor, _ in text_stretches(texts):
                names, keys, leads, flags, contents = [], [], [], [], []
                sets = {r: dict(zip(wanted[r], hot[r])) for r in np.unique(row).tolist()}
                for r, s, n, a, h in zip(row.tolist(), start.tolist(), count.tolist(), lead.tolist(), anchor.view(np.int64).tolist()):
                    if s in sets[r]:
                        names.append(h)
                        keys.append((int(number[r]) << bits) | s)
                        leads.append(a)
                        flags.append(sets[r][s])
                        contents.append(texts[r][s : s + n - 1 + LENGTH])
                low, high = np.zeros(len(names), np.int64), np.full(len(names), SPAN - 1, np.int64)
                yield _batch(
                    bucket=pa.array(names, pa.int64()), key=pa.array(keys, pa.int64()), lead=pa.array(leads, pa.int64()), low=low, high=high,
                    content=pa.array(contents, pa.binary()), hot=pa.array(flags, pa.bool_()),
                )

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column("text"))
            firsts, repeats = batch.column("firsts").to_pylist(), batch.column("repeats").to_pylist()
            marks: dict[int, np.ndarray] = {}  # a step up where repeated strings begin, a step down behind their last byte

            def mark(r: int, start: int, strings: int) -> None:
                if r not in marks:
                    marks[r] = np.zeros(len(texts[r]) + 1, np.int32)
                marks[r][start] += 1
                marks[r][start + strings - 1 + LENGTH] -= 1

            alive = [None if x is None else set(x) for x in firsts]
            for row, start, count, *_ in text_stretches(texts):
                for r, s, n in zip(row.tolist(), start.tolist(), count.tolist()):
                    if alive[r] is None or s not in alive[r]:
                        mark(r, s, n)
            for r, found in enumerate(repeats):
                for x in found or ():
                    mark(r, x["start"], x["strings"])
            rows = []
            for r, text in enumerate(texts):
                removed = spans = 0
                left = text
                if r in marks:
                    gone = np.cumsum(marks[r][:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), removed, spans, hashlib.sha256(left).hexdigest()))
            sizes, gone, spans, digests = zip(*rows) if rows else ((), (), (), ())
            yield _batch(
                doc_id=batch.column("doc_id"), n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(gone, pa.int64()),
                n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(digests, pa.string()),
            )

    number, start = F.shiftright("key", bits), F.col("key").bitwiseAND(F.lit(mask))
    firsts = stored(
        base.select("number", "text").mapInArrow(places, "anchor long, content long, key long")
        .groupBy("anchor", "content").agg(F.min("key").alias("key")).select("anchor", "key")
    )
    several = firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = (
        firsts.join(several, "anchor").select(number.alias("number"), start.alias("start"), (F.col("n") > bucket_rows).alias("hot"))
        .groupBy("number").agg(F.collect_list("start").alias("starts"), F.collect_list("hot").alias("hot"))
    )
    candidates = stored(base.join(wanted, "number").select("number", "text", "starts", "hot").mapInArrow(wanted_stretches, _STRETCH + ", hot boolean"))
    ready = candidates.filter(~F.col("hot")).drop("hot")
    split, merged = split_buckets(candidates.filter("hot").drop("hot"), bucket_rows)
    if split is not None:
        ready = ready.unionByName(split)
    sorted_ = ready.select("bucket", "key", "lead", "content").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_solve, "key long, strings long")
    repeats = sorted_ if merged is None else sorted_.unionByName(merged)
    by_doc = repeats.select(number.alias("number"), F.struct(start.alias("start"), "strings").alias("span")).groupBy("number").agg(F.collect_list("span").alias("repeats"))
    alive = firsts.select(number.alias("number"), start.alias("start")).groupBy("number").agg(F.collect_list("start").alias("firsts"))
    facts = alive.join(by_doc, "number", "full").withColumnRenamed("number", "n")
    return base.join(facts, base["number"] == facts["n"], "left").select("doc_id", "text", "firsts", "repeats").mapInArrow(
        cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )

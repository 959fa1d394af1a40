import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, LONG, SCHEMA, awkward, empty, linked_components, rows
from corpus_pipeline import drop_near_copies
from wardflow.llm import near_copies as near, substring_dedup
from wardflow.llm.common import connected, ranks
from wardflow.llm.exact_dedup import exact_dedup
from wardflow.llm.simhash_dedup import fingerprints, simhash, simhash_dedup
from wardflow.llm.substring_dedup import LENGTH, remove_repeats, text_stretches
from wardflow.llm.suffix_groups import joined_texts, suffix_order, words_at


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_classes_of_awkward_rows(spark):
    want = []
    for d, t, *_ in AWKWARD:
        same = [x for x, y, *_ in AWKWARD if folded(y) == folded(t)]
        keep = max((x for x in same if x is not None), default=None)
        want.append((d, keep, len(same), d == keep, hashlib.sha256(folded(t).encode()).hexdigest()))
    assert rows(exact_dedup(awkward(spark))) == sorted(want, key=repr)


def test_colliding_hashes_are_told_apart_by_their_bytes(spark):
    colliding = exact_dedup(awkward(spark), digest=lambda sha: F.lit("same"))
    assert rows(colliding) == rows(exact_dedup(awkward(spark)))


def test_exact_keeps_the_smallest_if_asked(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup(docs, "smallest").orderBy("doc_id").collect()] == [(1, 1, True), (2, 1, False), (3, 3, True)]
    with pytest.raises(ValueError):
        exact_dedup(docs, "middle")


def test_empty_tables(spark):
    for operator in (exact_dedup, simhash_dedup, remove_repeats):
        assert operator(empty(spark)).count() == 0


def test_simhash_by_hand():
    import xxhash

    text = "One two  three FOUR\tfive".encode()
    shingles = [b"one two three", b"two three four", b"three four five"]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    assert simhash(text) == sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) > 1.5)
    assert simhash(b" \n") == 0 and simhash(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_spark_hashes_a_shingle_alike(spark):
    docs = spark.createDataFrame([(1, "one TWO three")], "doc_id long, text string")
    assert fingerprints(docs).first()["print"] == spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]


def test_components_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(20)]
    texts = [(i, t) for i, t in enumerate(base)]
    for k in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("abcdefgh")
        texts.append((100 + k, " ".join(words)))
    texts += [(d, t) for d, t, *_ in AWKWARD]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = linked_components(texts)
    assert rows(simhash_dedup(docs)) == want
    assert len({w[2] for w in want}) < len(want) - 20  # there is something to link


def test_connected_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 140)}}


def test_ranks_number_a_hot_key_in_blocks(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 3).alias("k"))
    got = ranks(df, "k", ["id"], block_rows=100).groupBy("k").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count("*")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] == r[4] for r in got)


# --- near copies by shingles ------------------------------------------------------------------------------------------


def near_components(docs: list[tuple]) -> dict:
    """The smallest id linked with each id, by the Jaccard similarity of all pairs."""
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [(d, shingles(t)) for d, t in docs], {d: d for d, _ in docs}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            low, high = sorted((root[i], root[j]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def near_documents() -> list[tuple]:
    rng = random.Random(8)
    line = "this common line stands in all of the documents"
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 4) for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w) + (f" {line}" if rng.random() < 0.7 else ""))
    return list(enumerate([*texts, line, "one two", "One  TWO", "one three"]))


@pytest.mark.parametrize("pairs_a_row, common_docs", [(4, 4), (0, 10**9)])
def test_near_copies_equal_brute_force_jaccard(spark, monkeypatch, pairs_a_row, common_docs):
    monkeypatch.setattr(near, "PAIRS_A_ROW", pairs_a_row)
    monkeypatch.setattr(near, "COMMON_DOCS", common_docs)
    docs = near_documents()
    want = near_components(docs)
    got = near.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert 20 < len(set(want.values())) < len(want) - 20


def test_common_shingles_come_last_by_frequency():
    often, order = np.array([2, 5, 7], np.uint64), np.array([2, 0, 1])
    assert near.prefix(np.arange(1, 11, dtype=np.uint64), (often, order), 0.8).tolist() == [1, 3, 4]
    assert near.prefix(often, (often, order), 0.8).tolist() == [5]


def test_sets_of_other_sizes_do_not_meet(spark):
    """A shingle of 100 sets of two sizes holds the pairs of equal sizes only, and none once these are components."""
    rows = [(1, i, 10 if i % 2 else 1000, 0, i) for i in range(100)] + [(2, 1000, 10, 2, 1000), (2, 1001, 10, 2, 1001)]
    labelled = spark.createDataFrame(rows, "h long, node long, n int, place int, root long")
    assert sum(r["pairs"] for r in near._crossing(near._binned(labelled, 0.8)).collect()) == 2 * 50 * 49
    assert near._crossing(near._binned(labelled.withColumn("root", F.col("n")), 0.8)).isEmpty()
    close = spark.createDataFrame([(1, i, n, 0, i) for i, n in enumerate([8, 10, 100, 125, 126])], labelled.schema)
    x, y = (near._binned(close, 0.8).filter(side).select("h", "bin", F.col("n").alias(name)) for side, name in (("small", "x"), ("NOT small", "y")))
    assert {(8, 10), (100, 125)} <= {(r["x"], r["y"]) for r in x.join(y, ["h", "bin"]).collect()}


def test_near_stage_keeps_one_of_a_component(spark):
    docs = near_documents()
    table = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], SCHEMA)
    assert sorted(r["doc_id"] for r in drop_near_copies(spark, table, "").collect()) == sorted(set(near_components(docs).values()))
    odd = drop_near_copies(spark, spark.createDataFrame(AWKWARD, SCHEMA), "")
    assert {r["doc_id"] for r in odd.collect()} == {None, 1, 3, 6, 7, 8, 9, -3}
    assert near.near_copies(empty(spark)).count() == 0


# --- repeated byte strings --------------------------------------------------------------------------------------------


def without_repeats(docs: list[tuple]) -> list[tuple]:
    """By a set of all strings seen so far, in the order of the documents."""
    seen, done, out = set(), {}, []
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        data = (t or "").encode()
        if (d, data) not in done:
            gone, fresh = bytearray(len(data)), set()
            for i in range(len(data) - LENGTH + 1):
                piece = data[i : i + LENGTH]
                if piece in seen or piece in fresh:
                    gone[i : i + LENGTH] = b"\x01" * LENGTH
                fresh.add(piece)
            seen |= fresh
            left = bytes(b for b, g in zip(data, gone) if not g)
            spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
            done[d, data] = (d, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
        out.append(done[d, data])
    return sorted(out, key=repr)


def noisy_documents(seed: int, ids=lambda i: i) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "x", "the", "of"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([20, 30, 90]))) for _ in range(6)]
    line = "this very common line of nearly one hundred bytes stands in all of the documents here"
    docs = []
    for i in range(120):
        own = [" ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(rng.randrange(60))) for _ in range(3)]
        parts = own + rng.sample(passages, rng.randrange(3)) + [line] + (["ab" * 120] if i % 10 == 0 else [])
        rng.shuffle(parts)
        docs.append((ids(i), " ".join(parts)))
    return docs + [(ids(500 + i), docs[i][1]) for i in range(10)] + [(ids(600), ""), (ids(601), None), (ids(602), "short")]


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_repeats_equal_brute_force(spark, bucket_rows):
    docs = noisy_documents(1)
    got = rows(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bucket_rows))
    assert got == without_repeats(docs)
    assert sum(r[2] for r in got) > 10_000


def test_repeats_with_odd_ids_and_repeated_rows(spark):
    docs = noisy_documents(2, lambda i: i - 60)
    docs += docs[:5]
    assert rows(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == without_repeats(docs)


def test_repeats_of_awkward_rows_and_long_texts(spark):
    got = {r["doc_id"]: r for r in remove_repeats(awkward(spark)).collect() if r["doc_id"] is not None}
    want = {r[0]: r for r in without_repeats([(d, t) for d, t, *_ in AWKWARD if d is not None])}
    assert {d: tuple(r) for d, r in got.items()} == want


def test_stretches_cover_each_string_once(monkeypatch):
    text = LONG[:5000].encode()
    for block in (5000, 700):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        starts = [s + k for _, start, count, *_ in text_stretches([b"tiny", text]) for s, n in zip(start.tolist(), count.tolist()) for k in range(n)]
        assert sorted(starts) == list(range(len(text) - LENGTH + 1))


def test_suffix_order_equals_sorting():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice(["a", "ab", "abc", "\x00a", "abcdefghij"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))).encode() for _ in range(rng.randrange(1, 6))]
        data, starts = joined_texts(texts)
        order = suffix_order(data, starts, words_at(data)).tolist()
        ends = {p: e for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()) for p in range(s, e)}
        suffixes = [data[p : ends[p]].tobytes() for p in order]
        assert sorted(order) == list(range(len(data))) and suffixes == sorted(suffixes)


def test_parities_never_rule_a_similar_pair_out():
    rng = np.random.default_rng(3)
    for n in (1, 40, 600, 3000, 9000):
        for changed in (0, n // 20, n // 9, n // 2):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, np.uint64))))
            differ = len(np.setxor1d(a, b))
            assert sum(int(x).bit_count() for x in near.parities(a) ^ near.parities(b)) <= differ
            if len(a) > near.LONG_SET and len(b) > near.LONG_SET:
                found = near.long_difference(near.long_parities(a), near.long_parities(b))
                assert found <= differ and found >= min(differ, len(a) // 4) * 0.7


def test_shingles_are_those_of_the_words_in_order():
    text = b"One two  three four five six\tONE two three four five seven"
    words = text.lower().split()
    wanted = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(near.shingle_set(text)) == len(wanted)
    assert len(near.shingle_set(b"a b c")) == 1 and len(near.shingle_set(b" \n")) == 0
    assert near.shingle_set(b"a b c").tolist() != near.shingle_set(b"c b a").tolist()
    assert np.intersect1d(near.shingle_set(b"x " + text), near.shingle_set(text)).size == len(wanted)

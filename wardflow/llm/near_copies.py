"""Near-copies: documents whose sets of word shingles have a Jaccard similarity of a threshold or more, without misses.

SimHash proposes first: fingerprints of the sets meet by ball hashing, and what
meets is compared exactly. A SimHash radius cannot be made to hold for every pair
of that similarity, so a prefix filter completes the links: similar sets share a
shingle of their prefixes, whatever the order of shingles is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.llm.common import bounded_batches, byte_values, connected, forget, pick, stored
from wardflow.llm.simhash_dedup import ball_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
HASH_SEED = 42
#: Documents looked at for shingles that are common: at least so many, and one in so many. In how many of them a common one is, and how many are put last in the order.
#: This leaves none out. A share of the documents, so that what is not common is in as few of them whatever the table's size.
SAMPLE_DOCS = 4000
SAMPLE_WAYS = 16
COMMON_DOCS = 2
COMMON_SHINGLES = 500_000
#: Pairs listed for each row of a shared shingle before stars are tried first, and stars tried at most.
PAIRS_A_ROW = 4
STARS = 8
#: Hashes unpacked at once for a fingerprint.
PRINT_BLOCK = 1 << 13
#: Sets of more shingles have longer parities besides.
LONG_SET = 512
#: The columns of parities.
BITS = [f"bits{i}" for i in range(16)]


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, ascending.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space.
    A text of fewer words than a shingle is one shingle; without words it has none.
    """
    words = text.lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(line, HASH_SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, common ones last and the most common ones at the end: two sets that are similar enough have one of them in common.

    Of n shingles at least similarity * n are shared with a similar set, so
    one of the first n - similarity * n + 1 in any order that holds for all sets is.
    """
    keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    often, order = common
    if len(often) and len(hashes):
        place = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        is_common = often[place] == hashes
        last = hashes[is_common][np.argsort(order[place[is_common]])]
        hashes = np.concatenate((hashes[~is_common], last))
    return hashes[:keep]


def parities(hashes: np.ndarray) -> np.ndarray:
    """1,024 bits in 16 words: how many shingles of a set fall to a bit, modulo two. Sets differ in at least as many shingles as bits."""
    odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def long_parities(hashes: np.ndarray) -> bytes | None:
    """The same with two to four bits a shingle, for sets that are too large for ``parities`` to tell apart; None for others."""
    if len(hashes) <= LONG_SET:
        return None
    bits = (2 * len(hashes) - 1).bit_length()
    odd = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def long_difference(x: bytes, y: bytes) -> int:
    """How many shingles two sets differ in at least; the longer parities are folded to the length of the others."""
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y))
    while len(a) != len(b):
        a, b = (v.reshape(-1, 2).sum(1, dtype=np.uint8) & 1 if len(v) > min(len(a), len(b)) else v for v in (a, b))
    return int(np.count_nonzero(a != b))


def set_print(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PRINT_BLOCK):
        octets = hashes[at : at + PRINT_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``node`` (a hash of the set) and ``hashes``, the whole set."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([_signed([_node(s) for s in sets]), _lists(sets)], ["node", "hashes"])

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(cut, "node long, hashes array<long>")


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents of a sample, ascending, and their places in an order by how many they are in.

    They come last in the order of shingles, the rest keeps the order of hashes.
    """
    n = docs.count()
    ways = min(max(1, n // SAMPLE_DOCS), SAMPLE_WAYS)
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ways)) == 0)
    often = _sets(some, width).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    first = often.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    hashes, counts = first["h"].to_numpy().astype(np.int64).view(np.uint64), first["n"].to_numpy()
    order = np.empty(len(hashes), np.int64)
    order[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    ascending = np.argsort(hashes)
    return hashes[ascending], order[ascending]


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, node, n`` (the size of the set), its SimHash ``print``, its parities and, for a large set, longer ones."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [(_node(s), len(s), set_print(s), parities(s), long_parities(s)) for s in (shingle_set(t, width) for t in byte_values(batch.column("text")))]
            nodes, sizes, prints, odd, longer = zip(*facts) if facts else ((), (), (), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), _signed(list(nodes)), pa.array(sizes, pa.int32()), _signed(list(prints))]
            bits = np.array(odd, np.uint64).reshape(-1, len(BITS))
            columns += [pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(len(BITS))]
            columns.append(pa.array(longer, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "print", *BITS, "longer"])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(mark, "doc_id long, node long, n int, print long, " + ", ".join(f"{b} long" for b in BITS) + ", longer binary")


def _prefix_rows(docs: DataFrame, width: int, similarity: float, common) -> DataFrame:
    """``h, node, n, place``: a row for every shingle of a prefix."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [(_node(s), len(s), prefix(s, common.value, similarity).copy()) for s in (shingle_set(t, width) for t in byte_values(batch.column("text")))]
            nodes, counts, firsts = zip(*facts) if facts else ((), (), ())
            sizes = [len(f) for f in firsts]
            columns = [np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64), np.repeat(np.array(nodes, np.uint64).view(np.int64), sizes),
                       np.repeat(np.array(counts, np.int32), sizes), np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in sizes)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "n", "place"])

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(cut, "h long, node long, n int, place int")


def _shared(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The prefix rows whose shingle is in the prefixes of several nodes.

    A shingle has several nodes if the smallest and the largest differ; that
    is an aggregate with partial sums, and the join back may be split where a
    shingle is hot. Rows that repeat a node are merged.
    """
    spark: SparkSession = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    rows = stored(_prefix_rows(docs, width, similarity, common))
    several = stored(rows.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("h"))
    kept = stored(rows.join(several, "h").groupBy("h", "node").agg(F.first("n").alias("n"), F.first("place").alias("place")))
    forget(several), forget(rows)
    return kept


def _labelled(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The shared shingles with the component of each node so far."""
    if roots is None:
        return shared.withColumn("root", F.col("node"))
    names = roots.withColumnRenamed("root", "_root")
    return stored(shared.join(names, "node", "left").select(*shared.columns, F.coalesce("_root", "node").alias("root")))


def _binned(labelled: DataFrame, similarity: float) -> DataFrame:
    """The rows by classes of sizes, ``bin``: as the smaller set of a pair (``small``) in the class of the own size, as the larger one in every class of a partner.

    Where two similar sets first share a shingle, the rest of either holds all
    that can be shared. That bounds the places of the smaller set and the
    sizes that a partner of the larger one can have; the larger one is at most
    1 / similarity times as large.
    """
    step = math.log(max(1 / similarity, 1.01))
    n, left = F.col("n"), F.col("n") - F.col("place")
    small = labelled.filter(left >= F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9))
    low = F.floor(F.log(n * similarity) / step - 1e-6)
    most = F.least(n.cast("double"), left * ((1 + similarity) / similarity) - n)
    high = F.greatest(low, F.floor(F.log(most) / step + 1e-6))
    large = labelled.withColumn("bin", F.explode(F.sequence(low, high))).withColumn("small", F.lit(False))
    return small.withColumn("bin", F.floor(F.log(n) / step)).withColumn("small", F.lit(True)).unionByName(large)


def _crossing(binned: DataFrame) -> DataFrame:
    """``h, bin, pairs``: the classes that hold pairs of two components, and at most how many."""
    of_root = binned.groupBy("h", "bin", "root").agg(F.count_if("small").alias("i"), F.count_if(~F.col("small")).alias("j"))
    pairs = F.sum("i") * F.sum("j") - F.sum(F.col("i") * F.col("j"))
    return stored(of_root.groupBy("h", "bin").agg(pairs.alias("pairs")).filter("pairs > 0"))


class _Verifier:
    """Exact comparison of pairs of nodes; the sets that were read once are kept in the shared folder."""

    def __init__(self, docs: DataFrame, width: int, similarity: float, nodes: DataFrame) -> None:
        self.docs, self.width, self.similarity, self.nodes = docs, width, similarity, nodes
        self.sets: list[DataFrame] = []

    def least(self, x, y):
        """How many shingles two similar sets of these sizes share at least."""
        return F.ceil((x + y) * (self.similarity / (1 + self.similarity)) - 1e-9)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs ``a``, ``b`` whose sizes and parities do not rule the similarity out."""
        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), *[F.col(b).alias(f"{s}_{b}") for b in BITS])
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct().join(side("a"), "a").join(side("b"), "b")
        return both.filter(self.may_be("a_", "b_")).select("a", "b")

    def may_be(self, left: str, right: str):
        n, m = F.col(f"{left}n"), F.col(f"{right}n")
        differ = sum(F.bit_count(F.col(f"{left}{b}").bitwiseXOR(F.col(f"{right}{b}"))) for b in BITS)
        return (F.least(n, m) >= self.similarity * F.greatest(n, m) - 1e-9) & (differ <= n + m - 2 * self.least(n, m))

    def close_enough(self, pairs: DataFrame) -> DataFrame:
        """The pairs that longer parities do not rule out. They are a thirty-second of the sets, and leave hardly another pair than the similar ones."""
        similarity = self.similarity

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_longer", "b_longer")))
                fits = [x is None or y is None or long_difference(x, y) <= n + m - 2 * math.ceil((n + m) * similarity / (1 + similarity) - 1e-9) for n, m, x, y in rows]
                yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("longer").alias(f"{s}_longer"))
        bounded_batches(pairs.sparkSession)
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, by their whole sets."""
        pairs = stored(self.close_enough(pairs))
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for known in self.sets:
            asked = asked.join(known.select("node"), "node", "left_anti")
        asked = stored(asked)
        # One document stands for a node; that of a null id is met by its null.
        ids = stored(asked.join(self.nodes, "node").select(F.col("doc_id").alias("_id")).distinct())
        if not ids.isEmpty():
            again = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
            self.sets.append(stored(_sets(again, self.width).join(asked, "node", "left_semi").dropDuplicates(["node"])))
        forget(ids), forget(asked)
        if not self.sets:
            return pairs
        every = reduce(DataFrame.unionByName, self.sets)
        both = pairs
        for side in ("a", "b"):
            both = both.join(every.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_set")), side)
        same = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - same
        found = stored(both.filter(same >= F.lit(self.similarity) * union - 1e-9).select("a", "b"))
        forget(pairs)
        return found

    def close(self) -> None:
        for table in self.sets:
            forget(table)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that ball hashing proposes: of equal fingerprints with the first of them, and the first ones of linked fingerprints."""
    first = nodes.groupBy("print").agg(F.min("node").alias("first"))
    alike = nodes.join(first, "print").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = ball_links(first.select("print"))
    of = lambda side: first.select(F.col("print").alias(side), F.col("first").alias(f"{side}_node"))
    near = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return alike.unionByName(near)


def near_links(docs: DataFrame, width: int, similarity: float, marked: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect exactly the nodes whose sets have the similarity or more.

    The pairs that SimHash proposes are compared first. Of the pairs that share
    a shingle of their prefixes, those inside one component need no comparison.
    They meet by classes of sizes, and a class whose rows are all of one
    component is left out from then on. Where many are left, the nodes of a
    class are compared with one of them alone, in turn by several orders; then
    all pairs that still cross components are. Sizes, places and parities,
    which lose no similar pair, rule pairs out before any set is read.
    """
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "print", *BITS, "longer")]))
    verifier = _Verifier(docs, width, similarity, nodes)
    links = verifier.similar(verifier.possible(simhash_pairs(nodes)))
    shared = _shared(docs, width, similarity)
    rows = shared.count()
    labelled, before = _labelled(shared, connected(links)), None
    binned = _binned(labelled, similarity)
    for turn in range(STARS + 1):
        crossing = _crossing(binned)
        left = crossing.agg(F.sum("pairs")).first()[0] or 0
        rest = stored(binned.join(crossing.select("h", "bin"), ["h", "bin"]))
        forget(crossing), forget(labelled)
        if left <= PAIRS_A_ROW * rows or turn == STARS or (before is not None and left > 0.9 * before):
            break
        centre = rest.groupBy("h", "bin").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "root")).alias("centre"))
        star = rest.join(centre, ["h", "bin"]).filter("root <> centre.root").filter(F.least("n", "centre.n") >= similarity * F.greatest("n", "centre.n") - 1e-9)
        links = links.union(verifier.similar(verifier.possible(star.select(F.col("node").alias("a"), F.col("centre.node").alias("b")))))
        before, binned = left, _labelled(rest.drop("root"), connected(links))
        forget(rest)
        labelled = binned
    # A pair is met at the first shingle it shares, where the rest of either set holds all that can be shared.
    rest = rest.join(nodes.select("node", *BITS), "node")
    x, y = (rest.filter(F.col("small") == (side == "x")).select("h", "bin", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "place", "root", *BITS)]) for side in "xy")
    met = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) >= verifier.least(F.col("x_n"), F.col("y_n"))
    once = "(x_n < y_n OR (x_n = y_n AND x_node < y_node)) AND x_root <> y_root"
    pairs = x.join(y, ["h", "bin"]).filter(once).filter(met & verifier.may_be("x_", "y_"))
    found = verifier.similar(pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())
    links = stored(links.union(found))
    verifier.close()
    forget(shared), forget(nodes)
    return links


def near_copies(docs: DataFrame, width: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id of the documents it is linked with.

    Documents link if the Jaccard similarity of their sets of word shingles is
    at least ``similarity``; components are those of the links. No pair is
    missed (see ``prefix``) and none is linked without comparing the sets.

    * equal sets are one node, so null texts and texts without words are copies of each other.
    * rows with a null id take part; a component of nothing else has a null id.
    * repeated rows give repeated rows; an empty table gives an empty result.
    """
    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = stored(_marked(base, width))
    roots = connected(near_links(base, width, similarity, marked))
    member = marked.groupBy("node").agg(F.min("doc_id").alias("first_id")).join(roots, marked["node"] == roots["node"], "left")
    member = member.select(marked["node"], "first_id", F.coalesce("root", marked["node"]).alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "node").join(member.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")

"""Hard-negative mining: exact inner-product search through cover trees over norm-augmented candidates.

Candidates are dealt to blocks of a bounded size by their nearest pivot, and a
cover tree is built for each block once. Anchors, in chunks, descend every
tree: first for their positives, then for the negatives inside the windows
that the positives' scores define.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardflow.llm.common import bounded_batches, pick, stored

#: Candidates of a block, anchors of a chunk, and pivots that deal candidates to blocks. All are bounds, at every size.
BLOCK_ROWS = 8192
CHUNK_ROWS = 4096
PIVOTS = 1024
#: Rows of a node that is not divided, children of a node, and the share of its rows the largest child may hold.
LEAF_ROWS = 256
CHILDREN = 16
LARGEST_SHARE = 0.75
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 52)
#: Scores held at once when a leaf is verified, and the score of no row.
SCORED_CELLS = 1 << 20
LEAST = -(1 << 62)

TREE = "block long, dim int, ids binary, labels binary, vectors binary, wide boolean, centres binary, radii binary, begins binary, ends binary, below binary, top double"
HIT = "anchor_id long, variant long, label int, query long, other_id long, score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, q`` and ``dim``: rows that take part, components as ``floor(256 x)``."""
    rows = pick(embeddings, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.cast("int").alias("label"), F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("q"), F.size("x").alias("dim"))


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the norm ``top``: the nearest to a query is then the one of largest inner product."""
    x = vectors.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def _net(points: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Centres that are further apart than they reach, and the centre of every point; None if a few centres do not divide the node.

    The first centre is the parent's. Each next one is the point furthest
    from those before it, until the radius is halved.
    """
    nearest, owner, chosen = _distances(points, centre), np.zeros(len(points), np.int64), [centre]
    while len(chosen) < CHILDREN and nearest.max() > radius / 2:
        chosen.append(points[nearest.argmax()])
        away = _distances(points, chosen[-1])
        closer = away < nearest
        owner[closer], nearest[closer] = len(chosen) - 1, away[closer]
    if np.bincount(owner).max() > LARGEST_SHARE * len(points):
        return None
    return np.array(chosen), owner


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree: nodes with a centre, a covering radius and a range of ``order``; the children of a node follow each other.

    Children's centres form a net of the parent's rows, the parent's centre
    among them, and their radii are those that cover their own rows. A node
    is a leaf if it is small, has radius zero, or is not divided by a few
    centres; so the depth is at most logarithmic. ``below`` holds the first
    child and the number of children.
    """
    order = np.arange(len(points))
    centre = points[_distances(points, points.mean(0)).argmin()]
    centres, radii, begins, ends, below = [centre], [float(_distances(points, centre).max())], [0], [len(points)], [(0, 0)]
    at = 0
    while at < len(centres):
        begin, end = begins[at], ends[at]
        split = None
        if end - begin > LEAF_ROWS and radii[at] > 0:
            split = _net(points[order[begin:end]], centres[at], radii[at])
        if split is not None:
            chosen, owner = split
            rows, sizes = order[begin:end][np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(chosen))
            order[begin:end] = rows
            used = np.flatnonzero(sizes)
            below[at] = (len(centres), len(used))
            bounds = begin + np.concatenate(([0], np.cumsum(sizes)))
            for child in used:
                a, b = int(bounds[child]), int(bounds[child + 1])
                centres.append(chosen[child])
                radii.append(float(_distances(points[order[a:b]], chosen[child]).max()))
                begins.append(a)
                ends.append(b)
                below.append((0, 0))
        at += 1
    return {"order": order, "centres": np.array(centres), "radii": np.array(radii), "begins": np.array(begins), "ends": np.array(ends), "below": np.array(below)}


class Tree:
    """A block's tree, with its rows in tree order, those of a leaf by id."""

    def __init__(self, row: dict) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int32)
        self.vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int16).reshape(len(self.ids), row["dim"])
        self.radii, self.top = np.frombuffer(row["radii"], np.float64), row["top"]
        self.centres = np.frombuffer(row["centres"], np.float64).reshape(len(self.radii), row["dim"] + 1)
        self.begins, self.ends = np.frombuffer(row["begins"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.below = np.frombuffer(row["below"], np.int64).reshape(-1, 2)
        self.leaves = np.flatnonzero(self.below[:, 1] == 0)
        self.visited = 0

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest inner product of each query with the rows of each node.

        They come from the covering radius of the node and, level by level, of those above it.
        """
        q = queries.astype(np.float64)
        square = np.einsum("ij,ij->i", q, q)[:, None] + self.top * self.top
        away = np.sqrt(np.maximum(square - 2 * q @ self.centres[:, :-1].T, 0))
        # Room for rounding: scores are integers, and an unsafe magnitude opens all nodes.
        room = 0.5 + 1e-9 * square if square.size and square.max() < EXACT else np.full_like(square, np.inf)
        lower, upper = (square - (away + self.radii) ** 2) / 2 - room, (square - np.maximum(away - self.radii, 0) ** 2) / 2 + room
        for node, (first, children) in enumerate(self.below.tolist()):
            if children:
                part = slice(first, first + children)
                np.minimum(upper[:, part], upper[:, node, None], out=upper[:, part])
                np.maximum(lower[:, part], lower[:, node, None], out=lower[:, part])
        return lower, upper

    def scores(self, queries: np.ndarray, leaf: int) -> np.ndarray:
        rows = self.vectors[self.begins[leaf] : self.ends[leaf]]
        if float(np.abs(queries).max(initial=0)) * self.top * max(1, rows.shape[1]) < EXACT:
            return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return queries.astype(np.int64) @ rows.astype(np.int64).T

    def search(self, queries: np.ndarray, lows: np.ndarray, highs: np.ndarray, most: int, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and window [low, high] the ``most`` best rows in it that fit: scores, ids (best first, ties by id) and how many there are.

        All queries descend at once, each from its largest possible score
        down. A query skips a leaf if every window lies outside the leaf's
        bounds or is filled by scores that the leaf cannot reach any more;
        the rows of the others are scored exactly.
        """
        lower, upper = (x[:, self.leaves] for x in self.bounds(queries))
        n, windows = lows.shape
        score, ids = np.full((n, windows, most), LEAST), np.full((n, windows, most), np.iinfo(np.int64).max)
        order = np.argsort(-np.minimum(upper, highs.max(1, initial=-np.inf)[:, None]), axis=1, kind="stable")
        each = np.arange(n)
        for step in range(len(self.leaves)):
            leaf = order[:, step]
            lo, hi = lower[each, leaf][:, None], upper[each, leaf][:, None]
            wanted = np.flatnonzero(((hi >= lows) & (lo <= highs) & (np.minimum(hi, highs) >= score[:, :, -1])).any(1))
            wanted = wanted[np.argsort(leaf[wanted], kind="stable")]
            for group in np.split(wanted, np.flatnonzero(np.diff(leaf[wanted])) + 1):
                if not len(group):
                    continue
                self.visited += len(group)
                node = int(self.leaves[leaf[group[0]]])
                cells = len(group) * int(self.ends[node] - self.begins[node])
                for part in np.array_split(group, max(1, -(-cells // SCORED_CELLS))):
                    self._verify(queries, part, node, lows, highs, fits, score, ids)
        return score, ids, (score > LEAST).sum(2)

    def _verify(self, queries: np.ndarray, part: np.ndarray, leaf: int, lows: np.ndarray, highs: np.ndarray, fits, score: np.ndarray, ids: np.ndarray) -> None:
        """Score the rows of a leaf for some queries and merge what is better into their results."""
        a, b, most = int(self.begins[leaf]), int(self.ends[leaf]), score.shape[2]
        points = self.scores(queries[part], leaf)
        fit = fits(part, self.ids[a:b], self.labels[a:b])
        take = min(most, b - a)
        sort_all = b - a <= 2 * most or max(abs(int(points.min())), abs(int(points.max()))) >= 1 << 46
        points = np.where(fit, points, LEAST)
        for w in range(lows.shape[1]):
            inside = np.where((points >= lows[part, w, None]) & (points <= highs[part, w, None]), points, LEAST)
            better = np.flatnonzero(inside.max(1) >= np.maximum(score[part, w, -1], LEAST + 1))
            if not len(better):
                continue
            inside, rows = inside[better], part[better]
            best = np.argsort(-inside, axis=1, kind="stable")[:, :take] if sort_all else _first(inside, take)
            found, names = np.take_along_axis(inside, best, 1), self.ids[a:b][best]
            both, whose = np.concatenate((score[rows, w], found), 1), np.concatenate((ids[rows, w], names), 1)
            kept = np.lexsort((whose, -both), axis=1)[:, :most]
            score[rows, w], ids[rows, w] = np.take_along_axis(both, kept, 1), np.take_along_axis(whose, kept, 1)


def _first(values: np.ndarray, most: int) -> np.ndarray:
    """The columns of the largest values of each row, ties by the first column."""
    width = values.shape[1]
    key = np.where(values > LEAST, values * width, LEAST) - np.arange(width)
    return np.argpartition(-key, most - 1, axis=1)[:, :most]


def _pivots(rows: DataFrame, dim: int) -> np.ndarray:
    """Rows that deal the candidates to blocks: at most ``PIVOTS``, by the smallest hashes of their ids. Any choice gives the same result."""
    n = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(int(min(PIVOTS, max(1, n // BLOCK_ROWS))))
    found = [r["q"] for r in some.select("q").collect()]
    return np.array(found, np.float64).reshape(len(found), dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def _dealer(pivots):
    """Rows with the cell of their nearest pivot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("q"), pivots.value.shape[1]).astype(np.float64)
            p = pivots.value
            cell = ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("q"), pa.array(cell.astype(np.int64))], ["vec_id", "label", "q", "cell"])

    return deal


def _builder(dim: int, top: float):
    """The rows of a block to its tree, packed into one row."""

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("vec_id", "ascending")]))  # the rows of a leaf keep this order
        vectors = _matrix(table["q"].combine_chunks(), dim)
        tree = cover_tree(augmented(vectors, top))
        order, wide = tree["order"], bool(vectors.size and np.abs(vectors).max() >= 1 << 15)
        column = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        row = {
            "block": table["block"][0].as_py(), "dim": dim, "ids": column(table["vec_id"].to_numpy()[order], np.int64), "labels": column(table["label"].to_numpy()[order], np.int32),
            "vectors": column(vectors[order], np.int64 if wide else np.int16), "wide": wide, "top": top,
            "centres": column(tree["centres"], np.float64), "radii": column(tree["radii"], np.float64),
            "begins": column(tree["begins"], np.int64), "ends": column(tree["ends"], np.int64), "below": column(tree["below"], np.int64),
        }
        kinds = [("block", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors")), ("wide", pa.bool_()),
                 *((c, pa.binary()) for c in ("centres", "radii", "begins", "ends", "below")), ("top", pa.float64())]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    return build


def cover_trees(rows: DataFrame) -> DataFrame:
    """The cover trees of all candidates, one row for a block of rows of one dimension."""
    spark: SparkSession = rows.sparkSession
    trees = None
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    for found in rows.groupBy("dim").agg(F.max(square).alias("top")).orderBy("dim").collect():
        dim, top = found["dim"], float(np.sqrt(found["top"])) * (1 + 1e-12)
        of_dim = rows.filter(F.col("dim") == dim)
        pivots = spark.sparkContext.broadcast(_pivots(of_dim, dim))

        dealt = stored(of_dim.select("vec_id", "label", "q").mapInArrow(_dealer(pivots), "vec_id long, label int, q array<long>, cell long"))
        # A cell of more than a block's rows is cut into several, by the hash of the row.
        cuts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (BLOCK_ROWS / 2)).cast("long").alias("cuts"))
        block = F.xxhash64("cell", F.pmod(F.xxhash64("vec_id", "q"), F.col("cuts")))
        blocks = dealt.join(F.broadcast(cuts), "cell").withColumn("block", F.when(F.col("cuts") == 1, F.col("cell")).otherwise(block))

        built = blocks.select("block", "vec_id", "label", "q").groupBy("block").applyInArrow(_builder(dim, top), TREE)
        trees = built if trees is None else trees.unionByName(built)
    if trees is None:
        return spark.createDataFrame([], TREE)
    return stored(trees)


def _meet(trees: DataFrame, anchors: DataFrame, work) -> DataFrame:
    """Every chunk of anchors beside every block of its dimension; ``work(tree, anchors)`` yields the rows of ``HIT``.

    Chunks and blocks are single rows of a bounded size, and a task holds a few pairs of them at a time.
    """
    spark = trees.sparkSession
    packed = stored(anchors.groupBy("dim", "chunk").agg(F.collect_list(F.struct(*[c for c in anchors.columns if c not in ("dim", "chunk")])).alias("anchors")))
    pairs = trees.count() * max(1, packed.count())
    both = trees.join(packed.withColumnRenamed("dim", "_dim"), F.col("dim") == F.col("_dim")).drop("_dim")
    spread = both.repartition(min(pairs, 100_000) or 1, F.xxhash64("block", "chunk"))
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hits = list(work(Tree(row), row["anchors"]))
                if hits:
                    columns = list(zip(*hits))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in HIT.split(", ")])

    return spread.mapInArrow(run, HIT)


def _queries(tree: Tree, anchors: list[dict]) -> np.ndarray:
    return np.array([a["q"] for a in anchors], np.int64).reshape(len(anchors), tree.vectors.shape[1])


def _positives(most: int):
    def work(tree: Tree, anchors: list[dict]):
        name, label = np.array([a["anchor_id"] for a in anchors]), np.array([a["label"] for a in anchors])
        fits = lambda part, ids, labels: (labels == label[part, None]) & (ids != name[part, None])
        everything = np.full((len(anchors), 1), np.inf)
        score, ids, found = tree.search(_queries(tree, anchors), -everything, everything, most, fits)
        for i, a in enumerate(anchors):
            for k in range(found[i, 0]):
                yield a["anchor_id"], a["variant"], a["label"], 0, int(ids[i, 0, k]), int(score[i, 0, k])

    return work


def _negatives(most: int):
    def work(tree: Tree, anchors: list[dict]):
        label = np.array([a["label"] for a in anchors])
        fits = lambda part, ids, labels: labels != label[part, None]
        asked = [[s for s in sorted(set(a["windows"])) if s >= 0] for a in anchors]  # below zero a window is empty
        shape = (len(anchors), max(1, max(map(len, asked))))
        lows, highs = np.full(shape, np.inf), np.full(shape, -np.inf)
        for i, scores in enumerate(asked):
            lows[i, : len(scores)], highs[i, : len(scores)] = [-(-s // 2) for s in scores], [95 * s // 100 for s in scores]
        score, ids, found = tree.search(_queries(tree, anchors), lows, highs, most, fits)
        for i, a in enumerate(anchors):
            for w, s in enumerate(asked[i]):
                for k in range(found[i, w]):
                    yield a["anchor_id"], a["variant"], a["label"], s, int(ids[i, w, k]), int(score[i, w, k])

    return work


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. Anchors are the rows whose ``vec_id`` is divisible by
    ``every``; their positives are the first other rows of their label by
    inner product, ties by smaller id; the negatives of a pair are the first
    rows of other labels between 50 and 95 percent of the positive's score.

    * rows without a ``vec_id`` cannot be named and take no part.
    * rows that repeat an id are rows of their own, but never positives of an anchor of that id; anchors that repeat id, label and vector are one.
    * vectors of different lengths have no inner product and never meet.
    * a pair without negatives has no row; an empty table gives an empty result.
    * scores are exact; pivots, blocks and trees only decide how much is read.
    """
    rows = stored(prepared(embeddings))
    trees = cover_trees(rows)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "q").alias("variant"), "label", "q", "dim").distinct()
    chunks = int(max(1, -(-2 * anchors.count() // CHUNK_ROWS)))
    anchors = stored(anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor_id", "variant"), F.lit(chunks))))

    def best(hits: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "variant", "query").orderBy(F.desc("score"), "other_id")
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    found = stored(best(_meet(trees, anchors, _positives(positives)), positives))
    windows = found.groupBy("anchor_id", "variant").agg(F.collect_set("score").alias("windows"))  # at most one for each positive
    mined = best(_meet(trees, anchors.join(windows, ["anchor_id", "variant"]), _negatives(negatives)), negatives)
    mined = mined.select("anchor_id", "variant", F.col("query").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("anchor_id", "variant", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(mined, ["anchor_id", "variant", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

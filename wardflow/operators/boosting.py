"""Histogram gradient boosting with log, Poisson and absolute loss.

Features are binned once. Rows that agree in all bins and in the label are one
weighted cell, which is exact, since scores and gradients depend on nothing
else. Cells are packed into blocks, which stay persisted on the executors with
their scores; a tree brings the scores up to date in its first job. A level of a tree
is one job of one stage: each task adds up gradients and Hessians of its blocks by
(node, feature, bin), and the sums of the tasks, at most 255 numbers a node and
feature, are added in a tree of tasks if there are many. Of two siblings only the
smaller one is added up, the other is what is left of their parent. The driver holds bin
edges, trees and the sums of one level, and picks the best split of each node.

A tree sees of a row its bins only. Where few combinations of bins exist, a tree is one
job that adds up gradients and Hessians by combination, and its levels are added up from
these sums.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import add
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from wardflow.session import drop_stored, stored

LOSSES = ("log", "poisson", "absolute")
#: Cut points of a feature; a bin fits into a byte.
EDGES = 254
EDGE_ERROR = 0.0005  # of a percentile, as a share of the rows
BLOCK_CELLS = 32_768
#: Blocks are written with their scores after so many trees, so that lost ones are not made again from the first tree on.
REFRESH_TREES = 50
#: So many combinations of bins, a few MB of sums, are added up by combination; of more, the bins of each feature by node.
MOST_JOINT = 131_072
#: Sums of so many tasks are added on the driver; more are added by tasks first.
DIRECT_SUMS = 32
LEAST_HESSIAN = 1e-3
#: Medians of the leaves under absolute loss are found to this fraction of a unit.
MEDIAN_STEPS = 64
PARAMS = {"maxIter": 100, "maxDepth": 6, "numLeaves": 31, "stepSize": 0.05, "subsamplingRate": 1.0, "featureFraction": 1.0,
          "minInstancesPerNode": 20, "regLambda": 1.0}
BLOCK = StructType([StructField("block", LongType())] + [StructField(c, BinaryType()) for c in ("bins", "y", "w", "score")])


class Block(NamedTuple):
    """Cells of a task: bins (features by cells), label, rows and score, the number of their combination, and what the current tree sees of them: rows and sums of gradient and Hessian."""

    number: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    score: np.ndarray
    at: np.ndarray | None = None
    seen: np.ndarray | None = None
    g: np.ndarray | None = None
    h: np.ndarray | None = None


class Sums(dict):
    """Numbers by key, to be added up."""

    def __add__(self, other: dict) -> Sums:
        out = Sums(self)
        for key, value in (other or {}).items():
            out[key] = out.get(key, 0.0) + value
        return out

    def __radd__(self, other) -> Sums:
        return self + other


@dataclass
class Tree:
    """Nodes in arrays: ``child`` is the left child's number (0: a leaf), the right one follows it. Bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each column of ``bins`` (features by rows) ends in."""
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            inner = self.child[at] > 0
            if not inner.any():
                return at
            right = bins[self.feature[at], rows] > self.cut[at]
            at = np.where(inner, self.child[at] + right, at)


@dataclass
class Boosted:
    """A fitted ensemble; scores are on the scale of the label (a probability, a mean, a median)."""

    loss: str
    names: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the column ``name``; null features count as 0, as in the fit."""
        model = self

        def score(*columns: pd.Series) -> pd.Series:
            bins = to_bins([c.to_numpy(np.float64) for c in columns], model.edges)
            total = np.full(bins.shape[1], model.start)
            for tree in model.trees:
                total += tree.value[tree.leaves(bins)]
            return pd.Series(_link(model.loss, total))

        ready = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names]
        return df.withColumn(name, F.pandas_udf(score, "double")(*ready))

    def influence(self) -> list[float]:
        """Total gain of the splits on each feature."""
        total = np.zeros(len(self.names))
        for tree in self.trees:
            inner = tree.child > 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total.tolist()

    def to_json(self) -> str:
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]
        return json.dumps({"loss": self.loss, "names": self.names, "edges": [e.tolist() for e in self.edges], "start": self.start, "trees": trees})

    @staticmethod
    def from_json(line: str) -> Boosted:
        d = json.loads(line)
        kinds = {"feature": np.int64, "cut": np.int64, "child": np.int64, "value": np.float64, "gain": np.float64}
        trees = [Tree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in d["trees"]]
        return Boosted(d["loss"], d["names"], [np.array(e, np.float64) for e in d["edges"]], d["start"], trees)


def _link(loss: str, score: np.ndarray) -> np.ndarray:
    if loss == "log":
        return 1 / (1 + np.exp(-score))
    return np.exp(score) if loss == "poisson" else score


def _gradients(loss: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the score."""
    if loss == "absolute":
        return np.sign(score - y), np.ones_like(score)
    mean = _link(loss, score)
    return mean - y, mean * (1 - mean) if loss == "log" else mean


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """A row of bin numbers for each feature: how many edges lie below the value."""
    return np.array([np.searchsorted(e, c, side="left") for c, e in zip(columns, edges)], np.uint8).reshape(len(edges), -1)


def bin_edges(train: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Cut points of every feature: its values if they are few, else approximate percentiles of the rows."""
    ready = train.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    distinct = ready.agg(*[F.approx_count_distinct(n, 0.02).alias(n) for n in names]).first()
    few = [n for n in names if distinct[n] <= EDGES * 0.9]  # the count is off by a few percent at most
    exact = ready.agg(*[F.collect_set(n).alias(n) for n in few]).first() if few else {}
    many = [n for n in names if n not in few]
    cuts = dict(zip(many, ready.approxQuantile(many, [i / (EDGES + 1) for i in range(1, EDGES + 1)], EDGE_ERROR))) if many else {}
    return [np.array(sorted(exact[n])[:-1][:EDGES] if n in few else sorted(set(cuts[n])), np.float64) for n in names]


def _cells(train: DataFrame, names: list[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    """``bins`` (a byte a feature), ``y`` and the number of rows ``w`` that have them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins([batch.column(n).to_numpy(zero_copy_only=False) for n in names], edges).T.copy()
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column("_y")], ["bins", "y"])

    ready = train.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], F.col(label).cast("double").alias("_y"))
    return ready.filter(F.col("_y").isNotNull()).mapInArrow(cut, "bins binary, y double").groupBy("bins", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _packed(cells: DataFrame, features: int, start: float) -> DataFrame:
    """Cells in blocks: one row holds the bins, labels, weights and scores of up to ``BLOCK_CELLS`` cells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            table = pa.Table.from_batches(held)
            bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(-1, features).T
            y, w = table["y"].to_numpy(), table["w"].to_numpy()
            row = [number, *(np.ascontiguousarray(x).tobytes() for x in (bins, y, w, np.full(len(y), start)))]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], BLOCK.names)

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK_CELLS:
                yield block(waiting)
                waiting = []
        if waiting:
            yield block(waiting)

    return cells.mapInArrow(pack, BLOCK)


def _combinations(cells: DataFrame, features: int) -> np.ndarray | None:
    """The combinations of bins in order, or None if there are more than ``MOST_JOINT``."""
    found = cells.select("bins").distinct()
    if found.count() > MOST_JOINT:
        return None
    return np.sort(np.array([bytes(r["bins"]) for r in found.collect()], f"S{features}"))


def _joint(blocks: RDD, combinations: np.ndarray, features: int) -> Block:
    """One block with a cell for each combination: rows, and sums of gradient and Hessian, that the current tree sees."""
    n = len(combinations)

    def add_up(held: Iterator[Block]) -> Iterator[np.ndarray]:
        sums = 0.0
        for b in held:
            sums = sums + np.array([np.bincount(b.at, v, n) for v in (b.seen, b.g, b.h) if v is not None])
        yield sums

    total = _summed(blocks.mapPartitions(add_up))
    seen, g, *h = total if np.ndim(total) else np.zeros((2, n))
    bins = np.frombuffer(combinations.tobytes(), np.uint8).reshape(n, features).T
    return Block(0, bins, g, seen, g, seen=seen, g=g, h=h[0] if h else None)


def _opened(blocks: DataFrame, features: int, combinations: np.ndarray | None = None) -> RDD:
    """The stored blocks as arrays, with the number of each cell's combination."""
    known = None if combinations is None else blocks.sparkSession.sparkContext.broadcast(combinations)

    def read(row) -> Block:
        y, w, score = (np.frombuffer(row[c], np.float64) for c in ("y", "w", "score"))
        bins = np.frombuffer(row["bins"], np.uint8).reshape(features, len(y))
        at = None if known is None else np.searchsorted(known.value, np.ascontiguousarray(bins.T).view(f"S{features}").ravel()).astype(np.int32)
        return Block(row["block"], bins, y, w, score, at)

    return blocks.rdd.map(read)


def _closed(opened: RDD) -> DataFrame:
    """The blocks with their scores, stored."""
    from pyspark.sql import SparkSession

    rows = opened.map(lambda b: (b.number, *(bytearray(np.ascontiguousarray(x).tobytes()) for x in (b.bins, b.y, b.w, b.score))))
    return stored(SparkSession.active().createDataFrame(rows, BLOCK, verifySchema=False))


def _staged(blocks: RDD, last: Tree | None, loss: str, sampled: Callable[[int, np.ndarray], np.ndarray], keep: bool = True) -> RDD:
    """Blocks with the last tree added to their scores, and the weights and gradients the next tree sees."""

    def stage(b: Block) -> Block:
        score = b.score if last is None else b.score + last.value[last.leaves(b.bins)]
        seen = sampled(b.number, b.w)
        g, h = _gradients(loss, score, b.y)
        return Block(b.number, b.bins, b.y, b.w, score, b.at, seen, g * seen, None if loss == "absolute" else h * seen)

    staged = blocks.map(stage)
    return staged.persist(StorageLevel.MEMORY_AND_DISK) if keep else staged


def _summed(parts: RDD):
    """The sum of the partial results of all tasks (0 without any)."""
    return parts.treeAggregate(0, add, add, depth=1 if parts.getNumPartitions() <= DIRECT_SUMS else 2)


def _histograms(blocks: RDD | Block, grown: Tree, frontier: list[int], chosen: list[int], widths: list[int]) -> np.ndarray:
    """The sums of gradient, Hessian and weight by node of the frontier and bin, the bins of the chosen features side by side."""
    ends = np.cumsum([0, *(widths[f] for f in chosen)])

    def add_up(held: Iterator[Block]) -> Iterator[np.ndarray]:
        place = np.full(len(grown.child), -1, np.int64)
        place[frontier] = np.arange(len(frontier))
        sums = np.zeros((3, len(frontier), ends[-1]))
        for b in held:
            node = place[grown.leaves(b.bins)]
            at = np.flatnonzero((node >= 0) & (b.seen > 0))
            node, seen, g = node[at], b.seen[at], b.g[at]
            h = None if b.h is None else b.h[at]  # a Hessian of 1: the weights
            for i, f in enumerate(chosen):
                key = node * widths[f] + b.bins[f][at]
                size, place_of = len(frontier) * widths[f], slice(ends[i], ends[i + 1])
                of_bins = lambda v: np.bincount(key, v, size).reshape(len(frontier), -1)  # noqa: B023, E731
                weight = of_bins(seen)
                sums[0, :, place_of] += of_bins(g)
                sums[1, :, place_of] += weight if h is None else of_bins(h)
                sums[2, :, place_of] += weight
        yield sums

    total = next(add_up(iter([blocks]))) if isinstance(blocks, Block) else _summed(blocks.mapPartitions(add_up))
    return np.zeros((3, len(frontier), ends[-1])) + total


def best_splits(histograms: list[np.ndarray], frontier: list[int], chosen: list[int], least_rows: float, penalty: float) -> list[dict]:
    """The best split of every node that has one: ``feature, cut, gain`` and the sums of its left side and of the node.

    Ties (to six decimals of the gain) go to the first feature, then the lowest cut.
    """
    best: dict[int, dict] = {}
    for f, sums in zip(chosen, histograms):
        left, whole = np.cumsum(sums, axis=2), sums.sum(2, keepdims=True)
        (gl, hl, nl), (g, h, n) = left, whole
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
        able = (nl >= least_rows) & (n - nl >= least_rows) & (hl >= LEAST_HESSIAN) & (h - hl >= LEAST_HESSIAN) & (gain > 1e-9)
        cuts = np.argmax(np.round(np.where(able, gain, -1), 6), axis=1)
        for i, cut in enumerate(cuts):
            if not able[i, cut]:
                continue
            node = frontier[i]
            if node not in best or round(float(gain[i, cut]), 6) > round(best[node]["gain"], 6):
                found = (gain[i, cut], gl[i, cut], hl[i, cut], nl[i, cut], g[i, 0], h[i, 0], n[i, 0])
                best[node] = {"node": node, "feature": f, "cut": int(cut), **dict(zip(("gain", "gl", "hl", "nl", "g", "h", "n"), map(float, found)))}
    return [best[node] for node in sorted(best)]


def _pruned(tree: Tree, leaves: int) -> Tree:
    """The tree that splits the leaf of largest gain first, up to a number of leaves."""
    heap, opened = [(-tree.gain[0], 0)], set()
    while heap and len(opened) + 1 < leaves:
        _, node = heapq.heappop(heap)
        if tree.child[node]:
            opened.add(node)
            for side in (0, 1):
                heapq.heappush(heap, (-tree.gain[tree.child[node] + side], int(tree.child[node]) + side))
    order, number, at = [0], {0: 0}, 0
    while at < len(order):
        if order[at] in opened:
            for side in (0, 1):
                number[int(tree.child[order[at]]) + side] = len(order)
                order.append(int(tree.child[order[at]]) + side)
        at += 1
    kept = np.array(order)
    child = np.array([number[int(tree.child[i])] if i in opened else 0 for i in order], np.int64)
    return Tree(tree.feature[kept], tree.cut[kept], child, tree.value[kept], tree.gain[kept])


def _grown(blocks: RDD | Block, chosen: list[int], widths: list[int], settings: dict) -> Tree:
    """One tree, level by level."""
    feature, cut, child, value, gain, rows = [0], [0], [0], [0.0], [0.0], [0.0]
    frontier, penalty, least = [0], settings["regLambda"], settings["minInstancesPerNode"]
    ends = np.cumsum([0, *(widths[f] for f in chosen)])
    known: dict[int, np.ndarray] = {}  # the sums of the level before
    parent: dict[int, int] = {}

    def so_far() -> Tree:
        return Tree(np.array(feature), np.array(cut), np.array(child), np.array(value), np.array(gain))

    for _ in range(settings["maxDepth"]):
        if not frontier:
            break
        # Siblings have numbers that follow each other. The larger one is the rest of the parent.
        pairs = [(a, a + 1) for a in frontier if a + 1 in frontier and a in parent and parent[a] == parent[a + 1]]
        rest = {large: small for small, large in (sorted(pair, key=lambda n: rows[n]) for pair in pairs)}
        asked = [n for n in frontier if n not in rest]
        sums = dict(zip(asked, np.moveaxis(_histograms(blocks, so_far(), asked, chosen, widths), 1, 0)))
        sums |= {node: known[parent[node]] - sums[other] for node, other in rest.items()}
        level, known = np.stack([sums[n] for n in frontier], axis=1), sums
        found = best_splits([level[:, :, ends[i] : ends[i + 1]] for i in range(len(chosen))], frontier, chosen, least, penalty)
        frontier = []
        for s in found:
            node = s["node"]
            feature[node], cut[node], child[node], gain[node] = s["feature"], s["cut"], len(child), s["gain"]
            for g, h, n in ((s["gl"], s["hl"], s["nl"]), (s["g"] - s["gl"], s["h"] - s["hl"], s["n"] - s["nl"])):
                if n >= 2 * least:
                    frontier.append(len(child))
                parent[len(child)] = node
                feature.append(0), cut.append(0), child.append(0), gain.append(0.0), rows.append(n)
                value.append(-g / (h + penalty) * settings["stepSize"])
    return _pruned(so_far(), settings["numLeaves"])


def _medians(blocks: RDD, tree: Tree) -> dict[int, float]:
    """The lower weighted median of the residuals of every leaf: first the unit it lies in, then the step in that unit."""

    def steps(b: Block) -> tuple[np.ndarray, np.ndarray]:
        return tree.leaves(b.bins), np.round((b.y - b.score) * MEDIAN_STEPS).astype(np.int64)

    def by_unit(held: Iterator[Block]) -> Iterator[Sums]:
        found = Sums()
        for b in held:
            leaf, rest = steps(b)
            sums = pa.table({"leaf": leaf, "unit": rest // MEDIAN_STEPS, "w": b.seen}).group_by(["leaf", "unit"]).aggregate([("w", "sum")])
            found += dict(zip(zip(sums["leaf"].to_pylist(), sums["unit"].to_pylist()), sums["w_sum"].to_pylist()))
        yield found

    units: dict[int, list] = {}
    for (leaf, unit), w in sorted((_summed(blocks.mapPartitions(by_unit)) or {}).items()):
        units.setdefault(leaf, []).append((unit, w))
    middle, below, half = np.full(len(tree.child), np.iinfo(np.int64).min), {}, {}
    for leaf, parts in units.items():
        upto, half[leaf] = 0.0, sum(w for _, w in parts) / 2
        for unit, w in parts:
            if upto + w >= half[leaf]:
                middle[leaf], below[leaf] = unit, upto
                break
            upto += w

    def by_step(held: Iterator[Block]) -> Iterator[np.ndarray]:
        sums = np.zeros(len(middle) * MEDIAN_STEPS)
        for b in held:
            leaf, rest = steps(b)
            at = np.flatnonzero(rest // MEDIAN_STEPS == middle[leaf])
            sums += np.bincount(leaf[at] * MEDIAN_STEPS + rest[at] % MEDIAN_STEPS, b.seen[at], len(sums))
        yield sums

    if not half:
        return {}
    fine = _summed(blocks.mapPartitions(by_step)).reshape(-1, MEDIAN_STEPS)
    reached = {leaf: int(np.argmax(below[leaf] + np.cumsum(fine[leaf]) >= half[leaf])) for leaf in half}
    return {leaf: float(middle[leaf] + step / MEDIAN_STEPS) for leaf, step in reached.items()}


def _start(cells: DataFrame, loss: str) -> float:
    if loss == "absolute":
        by_value = cells.groupBy("y").agg(F.sum("w").alias("w"))
        middle = by_value.agg(F.expr("percentile(y, 0.5, cast(w as bigint))").alias("m")).first()[0]
        return float(middle or 0.0)
    total, weight = cells.agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).first()
    mean = (total or 0.0) / (weight or 1.0)
    if loss == "poisson":
        return float(np.log(max(mean, 1e-9)))
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    return float(np.log(mean / (1 - mean)))


def _sampler(seed: int, number: int, share: float):
    """The weights a tree sees: of every cell, a share of its rows, drawn alike whenever the block is read."""

    def sampled(block: int, weights: np.ndarray) -> np.ndarray:
        if share >= 1:
            return weights
        return np.random.default_rng([seed, number, block]).binomial(weights.astype(np.int64), share).astype(np.float64)

    return sampled


def fit_boosted(train: DataFrame, names: list[str], label: str, loss: str, *, seed: int = 42, params: dict | None = None) -> Boosted:
    """Fit ``maxIter`` trees of up to ``numLeaves`` leaves.

    ``log`` fits the probability of a 0/1 label, ``poisson`` the mean of a
    count, ``absolute`` the median. Leaves hold Newton steps, under absolute
    loss the median of their residuals. Rows with a null label take no part;
    without rows, or where no split is allowed, the model is a constant.
    """
    if loss not in LOSSES:
        raise ValueError(f"no loss {loss!r}, there are {LOSSES}")
    settings, names = {**PARAMS, **(params or {})}, list(names)
    edges = bin_edges(train, names)
    cells = stored(_cells(train, names, label, edges))
    model = Boosted(loss, names, edges, _start(cells, loss), [])
    combinations = _combinations(cells, len(names))
    blocks = stored(_packed(cells, len(names), model.start))
    drop_stored(cells)
    widths = [len(e) + 1 for e in edges]
    random, held, last = np.random.default_rng(seed), _opened(blocks, len(names), combinations), None
    for number in range(settings["maxIter"]):
        chosen = sorted(random.choice(len(names), max(1, round(settings["featureFraction"] * len(names))), replace=False).tolist())
        before, held = held, _staged(held, last, loss, _sampler(seed, number, settings["subsamplingRate"]))
        last, tree = None, _grown(held if combinations is None else _joint(held, combinations, len(names)), chosen, widths, settings)
        before.unpersist()
        if not tree.child[0]:
            if settings["subsamplingRate"] >= 1 and settings["featureFraction"] >= 1:
                break  # no later tree would find a split either
            continue
        if loss == "absolute":
            for leaf, middle in _medians(held, tree).items():
                tree.value[leaf] = middle * settings["stepSize"]
        model.trees.append(tree)
        last = tree
        if (number + 1) % REFRESH_TREES == 0:
            fresh = _closed(_staged(held, last, loss, _sampler(seed, number, 1.0), keep=False))
            held.unpersist(), drop_stored(blocks)
            blocks, last = fresh, None
            held = _opened(blocks, len(names), combinations)
    held.unpersist(), drop_stored(blocks)
    return model

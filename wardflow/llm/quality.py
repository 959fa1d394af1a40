"""Document quality by a byte-level convolutional network, trained and applied in numpy.

A text is read as bytes. Learned filters of ``WIDTH`` bytes are applied every
``STRIDE`` bytes in overlapping chunks that cover the whole text; each
filter's largest response over the document is kept, and a small dense layer
combines those, and the mean response, into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.common import bounded_batches, byte_values, pick, remainder, stored

EMBEDDING, WIDTH, STRIDE, FILTERS = 8, 12, 4, 24
#: Bytes of a chunk; neighbouring chunks overlap by what a filter needs, so none of its places is lost or counted twice.
CHUNK = 1 << 14
THRESHOLD = 0.3
#: Documents of each label, and bytes of text, that the network is trained on at most: a bounded sample by a hash of the id.
TRAIN_DOCUMENTS, TRAIN_BYTES = 2000, 20_000_000
EPOCHS, BATCH, RATE = 12, 32, 3e-3
#: Places of a document a training step looks at; scoring looks at all of them.
TRAIN_PLACES = 1024


@dataclass
class Network:
    """Weights: byte embedding, filters, and the dense layer over the largest and the mean responses."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.dense, self.offset]

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        return Network(
            rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32), scale(WIDTH * EMBEDDING, FILTERS), np.zeros(FILTERS, np.float32),
            scale(2 * FILTERS, 1)[:, 0], np.zeros(1, np.float32),
        )


def places(text: bytes) -> np.ndarray:
    """The bytes under each place of a filter, one row a place; 256 stands behind the end of the text."""
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    rows = max(1, -(-(len(data) - WIDTH) // STRIDE) + 1)
    padded = np.full((rows - 1) * STRIDE + WIDTH, 256, np.int64)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]


def responses(net: Network, data: np.ndarray) -> np.ndarray:
    """Rectified filter responses of the places of one chunk of bytes, which fills the last place."""
    embedded = net.embedding[data].ravel()
    rows = (len(data) - WIDTH) // STRIDE + 1
    step = embedded.itemsize
    view = np.lib.stride_tricks.as_strided(embedded, (rows, WIDTH * EMBEDDING), (STRIDE * EMBEDDING * step, step))
    return np.maximum(np.ascontiguousarray(view) @ net.filters + net.bias, 0)


def score(net: Network, text: bytes) -> float:
    """The probability that a text is good, from its whole length."""
    data = np.frombuffer(text, np.uint8)
    rows = max(1, -(-(len(data) - WIDTH) // STRIDE) + 1)
    most, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
    size = (rows - 1) * STRIDE + WIDTH
    for first in range(0, rows, CHUNK // STRIDE):
        end = min(size, first * STRIDE + CHUNK + WIDTH - STRIDE)
        chunk = np.full(end - first * STRIDE, 256, np.int16)
        piece = data[first * STRIDE : end]
        chunk[: len(piece)] = piece
        found = responses(net, chunk)
        most = np.maximum(most, found.max(0))
        total += found.sum(0)
    pooled = np.concatenate((most, total / rows))
    return float(1 / (1 + np.exp(-np.clip(pooled @ net.dense + net.offset[0], -30, 30))))


def _gradient(net: Network, text: bytes, label: int, weight: float, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
    under = places(text)
    if len(under) > TRAIN_PLACES:
        under = under[np.sort(rng.choice(len(under), TRAIN_PLACES, replace=False))]
    inputs = net.embedding[under].reshape(len(under), -1)
    linear = inputs @ net.filters + net.bias
    found = np.maximum(linear, 0)
    top = found.argmax(0)
    pooled = np.concatenate((found[top, np.arange(FILTERS)], found.mean(0)))
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.dense + net.offset[0], -30, 30)))
    error = np.float32(weight * (p - label))
    back = error * net.dense
    d_found = np.broadcast_to(back[FILTERS:] / len(under), found.shape).copy()
    d_found[top, np.arange(FILTERS)] += back[:FILTERS]
    d_linear = d_found * (linear > 0)
    d_filters = inputs.T @ d_linear
    d_inputs = (d_linear @ net.filters.T).reshape(-1, EMBEDDING)
    flat = under.ravel()
    d_embedding = np.stack([np.bincount(flat, d_inputs[:, k], 257) for k in range(EMBEDDING)], 1).astype(np.float32)
    loss = -weight * np.log(max(1e-9, p if label else 1 - p))
    return loss, [d_embedding, d_filters, d_linear.sum(0), error * pooled, np.array([error], np.float32)]


def train(texts: list[bytes], labels: list[int], seed: int = 5) -> Network:
    """Fit by Adam on the log loss, both labels weighing the same in sum."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    ones = sum(labels)
    if not texts or ones in (0, len(labels)):
        net.dense[:] = 0  # nothing to tell apart: the share of label 1 is the score of every text
        net.offset[:] = 4 if ones else -4 if labels else 0
        return net
    weights = {1: len(labels) / (2 * ones), 0: len(labels) / (2 * (len(labels) - ones))}
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            total = [np.zeros_like(p) for p in net.parts()]
            group = order[at : at + BATCH]
            for i in group.tolist():
                _, gradient = _gradient(net, texts[i], labels[i], weights[labels[i]], rng)
                for t, g in zip(total, gradient):
                    t += g / len(group)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.8)
            for part, t, m, v in zip(net.parts(), total, first, second):
                m += 0.1 * (t - m)
                v += 0.01 * (t * t - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of ``docs`` (``doc_id, text``) with ``labels`` (``doc_id, quality``), in one task.

    The sample is the first ``TRAIN_DOCUMENTS`` rows of each label by a hash
    of the id, until ``TRAIN_BYTES`` are reached. It is chosen by ids alone,
    and the chosen ids, whose number is bounded by that, are sent to the
    texts. Rows with a null text, id or label are not learned from.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL")
    place = F.xxhash64("doc_id", F.lit("quality"))
    ids = texts.select("doc_id").join(labels.filter("quality IN (0, 1)"), "doc_id").select("doc_id", "quality", place.alias("place"))
    ones, zeros = (ids.filter(F.col("quality") == q).orderBy("place", "doc_id").limit(TRAIN_DOCUMENTS) for q in (1, 0))
    chosen = stored(ones.union(zeros).distinct())
    sample = texts.join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id", "text").limit(2 * TRAIN_DOCUMENTS)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(byte_values(batch.column("text")), batch.column("quality").to_pylist()):
                if not texts or size + len(text) <= TRAIN_BYTES:
                    texts.append(text)
                    labels.append(int(label))
                    size += len(text)
        yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f4").tobytes() for p in train(texts, labels).parts()], pa.binary())], ["part"])

    parts = [bytes(r["part"]) for r in sample.select("text", "quality").coalesce(1).mapInArrow(fitted, "part binary").collect()]
    shapes = [p.shape for p in Network.new(0).parts()]
    if not parts:
        return train([], [])
    return Network(*[np.frombuffer(b, "<f4").reshape(s).copy() for b, s in zip(parts, shapes)])


def score_texts(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every document, from its whole text alone; null is empty."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(shared.value, t) for t in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())], ["doc_id", "score"])

    base = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(scored, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Held out are ids whose crc32 (of the id as text) is divisible by 5; their
    labels are not looked at. A null id is not held out and not learned from.

    * null and empty texts get the score of the empty text.
    * without labels every score is 0.5, with one kind of label it leans to it.
    * repeated rows give repeated rows; an empty table gives an empty result.
    """
    fold = remainder(F.col("doc_id"), 5)
    known = pick(labels, "doc_id", "quality").filter("doc_id IS NOT NULL").filter(fold != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    net = fit_quality(pick(docs, "doc_id", "text"), known)
    held_out = F.coalesce(fold == 0, F.lit(False))
    return score_texts(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

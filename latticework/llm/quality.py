"""A quality classifier: random-indexing word vectors, pooled for each document, and a small network on top.

Tokens are runs of letters and digits and runs of other signs, with their case. Each token falls into one of `BUCKETS`
buckets; a bucket has a fixed sparse index vector of +1 and -1, and its word vector is the sum of the index vectors of the
tokens within two places of it, over all texts. A document is pooled to the mean and the spread of its tokens' unit vectors
and the logarithm of its length. A network of two layers, fitted on a bounded sample of labelled rows, gives a logit that a
temperature, fitted on a part of that sample held back, turns into a probability.

Defined results: null and empty texts pool to zeros and get the network's score for those. Where labels of both values are
not there to learn from, every score is the share of ones among the usable labels (0.5 without any). Rows with the same
text get the same score; ids, languages, sources and further columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from . import labelled, shared, textscan

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 2, 2
#: Rows of word vectors that travel together.
SLICE = 256
#: Labelled documents of each label that the network is fitted on.
MOST_ROWS = 8000
HIDDEN, EPOCHS, RATE = 32, 60, 3e-3
WIDTH = 2 * DIM + 2


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64).reshape(BUCKETS, NONZERO) * np.uint64(0x9E3779B97F4A7C15)
    h = textscan.mix(seed)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


PLACES, SIGNS = _index_vectors()


def tokens(chunk: textscan.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token of a chunk and the text that it is in."""
    kind = textscan.classes()[chunk.cp]
    word = (kind == textscan.LETTER) | (kind == textscan.NUMBER)
    firsts = chunk.bounds[:-1]
    a, b = textscan.runs(word, firsts)
    c, d = textscan.runs(kind == textscan.OTHER, firsts)
    starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return (textscan.span_hashes(chunk.cp, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), chunk.row_of(starts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one partition's texts, as slices."""
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for chunk in textscan.chunks(batch.column(0).to_pylist()):
            bucket, row = tokens(chunk)
            for step in range(1, min(REACH, len(bucket) - 1) + 1):
                near = row[step:] == row[:-step]
                left, right = bucket[:-step][near], bucket[step:][near]
                for k in range(NONZERO):
                    total += np.bincount(left * DIM + PLACES[right, k], SIGNS[right, k], BUCKETS * DIM)
                    total += np.bincount(right * DIM + PLACES[left, k], SIGNS[left, k], BUCKETS * DIM)
    parts = total.astype(np.float32).reshape(-1, SLICE * DIM)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["slice", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices added up as they stream by; a worker holds one array for each slice it meets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, np.float32)
            sums[i] = sums[i] + part if i in sums else part.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["slice", "sums"])


def word_vectors(spark: SparkSession, docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets from all texts: BUCKETS * DIM floats (2 MB), whatever the input's size."""
    shared.small_batches(spark)
    parts = docs.select(docs[text].alias("text")).filter("text != ''").mapInArrow(_gathered, "slice int, sums binary")
    out = np.zeros((BUCKETS // SLICE, SLICE * DIM), np.float64)
    for r in parts.repartition(min(BUCKETS // SLICE, int(spark.conf.get("spark.sql.shuffle.partitions"))), "slice").mapInArrow(_added, "slice int, sums binary").collect():
        out[r["slice"]] += np.frombuffer(r["sums"], np.float32)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    sums, squares, n = np.zeros((len(texts), DIM)), np.zeros((len(texts), DIM)), np.zeros(len(texts))
    for chunk in textscan.chunks(texts):
        bucket, row = tokens(chunk)
        if not len(bucket):
            continue
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        x = vectors[bucket]
        who = row[first]
        np.add.at(n, row, 1)
        sums[who] += np.add.reduceat(x, first, axis=0, dtype=np.float32)
        squares[who] += np.add.reduceat(x * x, first, axis=0, dtype=np.float32)
    some = np.maximum(n, 1)[:, None]
    mean = sums / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    return np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), np.log1p(n)])


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _loss(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(np.average(np.logaddexp(0, np.where(y == 1, -logit, logit)), weights=weight))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Adam on the weighted cross entropy; then the temperature that suits a fifth of the rows held back for it."""
    random = np.random.default_rng(seed)
    if len(np.unique(y)) < 2:
        share = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    order = random.permutation(len(y))
    back, rest = order[: len(y) // 5], order[len(y) // 5 :]
    shift, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-6
    z, t, g = (x[rest] - shift) / scale, y[rest].astype(float), weight[rest] / weight[rest].mean()
    p = [random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(random.permutation(len(t)), max(1, len(t) // 128)):
            hidden = np.maximum(z[rows] @ p[0] + p[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3][0], -40, 40))) - t[rows]) * g[rows] / len(rows)
            back_error = np.outer(error, p[2]) * (hidden > 0)
            step += 1
            for i, d in enumerate([z[rows].T @ back_error + 1e-4 * p[0], back_error.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                p[i] = p[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(back):
        logit = net.logit(x[back])
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 60))
        net.temperature = float(grid[np.argmin([_loss(logit / t, y[back], weight[back]) for t in grid])])
    return net


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_ROWS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(spark, docs, text)
    sent = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), sent.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "y", "weight", "x"])

    chosen = labelled.sample(docs, labels, label, usable, most, key, text)
    rows = chosen.select("key", "text", "y", "weight").mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, y int, weight double, x binary").toPandas().sort_values(["key", "x"])
    x = np.array([np.frombuffer(b, np.float32) for b in rows.x], np.float64).reshape(-1, WIDTH)
    return vectors, fit(x, rows.y.to_numpy(), rows.weight.to_numpy(float))


def score(spark: SparkSession, docs: DataFrame, vectors: np.ndarray, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    sent = spark.sparkContext.broadcast((vectors, net))
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(pooled(batch.column(1).to_pylist(), vectors)), pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)

"""Small models trained here with numpy: gradient-boosted trees and isotonic calibration; labelled samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch, held_out

#: Labelled rows from which models are learned, at most (those with the smallest hashes of their id), and bytes of their
#: texts, at most (in the same order; a text that would pass the bound is left out whole).
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 64 << 20
FOLDS = 4

#: Runs ``work(k, shared)`` for k below n and returns what it gave.
Runner = Callable[[Callable, object, int], list]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents, and ``most`` bytes, that are not held out.

    Ids are chosen from the labels alone, so the documents are only filtered by a bounded broadcast. Of several
    texts under one id the one with the smallest hash is taken; null texts are empty.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    scratch = Scratch(docs.sparkSession, "sample")
    kept = scratch.write(found.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")), "texts")
    held, ids = 0, []
    for doc_id, size in kept.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", F.octet_length("_text.text")).collect():  # at most ``rows``
        if held + size <= most:
            held += size
            ids.append(doc_id)
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema)
    table = kept.join(F.broadcast(wanted), "doc_id").select("doc_id", "_text.text", "_label").toArrow().sort_by("doc_id")
    scratch.close()
    return [t.encode() for t in table["text"].to_pylist()], np.array(table["_label"].to_pylist(), np.float64).reshape(-1)


def here(work: Callable, shared: object, n: int) -> list:
    return [work(k, shared) for k in range(n)]


def in_tasks(spark: SparkSession) -> Runner:
    """A runner that gives each k a Spark task; ``shared`` is broadcast, so it must be bounded like the sample."""

    def runner(work: Callable, shared: object, n: int) -> list:
        sent = spark.sparkContext.broadcast(shared)

        def run(batches):
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(work(k, sent.value))], pa.binary())], ["id", "found"])

        found = spark.range(0, n, 1, n).mapInArrow(run, "id long, found binary").collect()
        sent.unpersist()
        return [pickle.loads(r.found) for r in sorted(found, key=lambda r: r.id)]

    return runner


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """Histogram gradient boosting with logistic loss; trees are complete binary arrays."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 48, least: int = 8, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)] if n else []
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
        mean = (y.sum() + 0.5) / (n + 1.0)
        self.start = float(np.log(mean / (1 - mean)))
        z, self.model = np.full(n, self.start), []
        inner = (1 << self.depth) - 1
        for _ in range(self.trees if n and 0 < y.sum() < n else 0):
            p = sigmoid(z)
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(1 << self.depth)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first, here = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(here, 1e-6)
                total_g, total_h = np.bincount(local, g, here), np.bincount(local, h, here)
                base = total_g**2 / (total_h + self.ridge)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    key = local * size + binned[:, j]
                    left = [np.bincount(key, w, here * size).reshape(here, size).cumsum(1)[:, :-1] for w in (g, h, None)]
                    count = np.bincount(local, minlength=here)[:, None]
                    gain = left[0] ** 2 / (left[1] + self.ridge) + (total_g[:, None] - left[0]) ** 2 / (total_h[:, None] - left[1] + self.ridge) - base[:, None]
                    gain[(left[2] < self.least) | (count - left[2] < self.least)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(here), k]
                    better = top > best
                    best[better], feature[first:][:here][better], cut[first:][:here][better] = top[better], j, e[k[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            at = node - inner
            leaf = self.rate * np.bincount(at, g, 1 << self.depth) / (np.bincount(at, h, 1 << self.depth) + self.ridge)
            z = z + leaf[at]
            self.model.append((feature, cut, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.model:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        return z


class Isotonic:
    """Pool-adjacent-violators; between the blocks' centres values are interpolated. Outside 0 to 1 nothing occurs."""

    def fit(self, x: np.ndarray, y: np.ndarray, prior: float = 0.5) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of labels, sum of x
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([1.0, b, a])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                w, s, t = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + t]
        self.at = np.array([t / w for w, _, t in blocks])
        self.value = np.maximum.accumulate([(s + prior * 0.02) / (w + 0.02) for w, s, _ in blocks]) if blocks else np.array([])
        self.prior = prior
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), self.prior)
        return np.clip(np.interp(x, self.at, self.value), 0.0, 1.0)


def folds(n: int, k: int = FOLDS) -> np.ndarray:
    return np.random.default_rng(7).permutation(n) % k

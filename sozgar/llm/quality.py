"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad. Emissions are linear in a line's own features and those of the lines before
and after it; transitions are learned. Forward-backward marginals, weighted by line length, give the
share of good text in a document, which isotonic calibration turns into the probability of label 1. In
training the lines of a document carry its label, and lines of bad documents that the first fit finds
good are taken as good in the second. The calibration sees only texts that the field has not seen.

Defined results: null and empty texts are one empty line; blank lines are lines of length 0 (weight 1);
very long texts are scored whole; without usable labels every score is the prior; repeated rows get
equal scores; an empty table gives an empty result; extra columns are ignored by the query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sozgar.llm.common import held_out
from sozgar.llm.learning import FOLDS, Isotonic, Runner, folds, here, in_tasks, labelled_sample
from sozgar.llm.toxicity import CLASS, CLASSES, score
from sozgar.llm.words import BLANK, CHUNK, LOWER, hash_runs, lay, runs

THRESHOLD = 0.7
WIDTH = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bytes of each line, and where each text's lines begin."""
    buffer, at = lay(texts)
    stops = np.flatnonzero(buffer == 0x0A)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else np.zeros(0, np.int64)
    first = np.searchsorted(begins, at)
    n = len(begins)
    size = (stops - begins).astype(float)
    line = np.repeat(np.arange(n), stops - begins + 1)
    counts = np.bincount(line * len(CLASSES) + CLASS[buffer], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    starts, ends = runs(~BLANK[buffer])
    hashes, owner = hash_runs(LOWER[buffer], starts, ends), line[starts] if len(starts) else np.zeros(0, int)
    words = np.bincount(owner, minlength=n).astype(float)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], fresh, n)
    upto = np.zeros((2, len(buffer) + 1))
    np.cumsum(np.isin(CLASS[buffer], (4, 6, 7)), out=upto[0, 1:])
    np.cumsum(CLASS[buffer] <= 2, out=upto[1, 1:])
    marked, lettered = upto[:, ends] - upto[:, starts]
    repeated = np.zeros(n)
    if n:
        whole = hash_runs(LOWER[buffer], begins, stops)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        by = np.lexsort((whole, text))
        same = (whole[by][1:] == whole[by][:-1]) & (text[by][1:] == text[by][:-1]) & (size[by][1:] > 0)
        repeated[by[1:][same]] = 1
        repeated[by[:-1][same]] = 1
    letters, safe, w = counts[:, 0] + counts[:, 1] + counts[:, 2], np.maximum(size, 1), np.maximum(words, 1)
    rows = np.stack([
        counts[:, 0] / np.maximum(letters, 1), (counts[:, 0] > 0.6 * np.maximum(counts[:, 0] + counts[:, 1], 1)).astype(float), counts[:, 6] / safe, counts[:, 7] / w, counts[:, 4] / w,
        counts[:, 3] / safe, counts[:, 8] / w, letters / safe, np.bincount(owner[1:], again, n) / w if len(owner) else np.zeros(n), distinct / w, np.minimum(size / w, 30) / 10,
        np.log1p(words), np.bincount(owner, (marked > 0) & (lettered > 0), n) / w, np.bincount(owner, (marked > 0) & (lettered == 0), n) / w, repeated, (size == 0).astype(float), counts[:, 2] / safe,
    ], axis=1) if n else np.zeros((0, WIDTH))
    return rows, size, first


def chunked_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, worked out chunk by chunk."""
    parts, some, held, at = [], [], 0, 0
    for t in [*texts, None]:
        if some and (t is None or held >= CHUNK):
            rows, size, first = line_features(some)
            parts.append((rows.astype(np.float32), size, first[:-1] + at))
            at += len(rows)
            some, held = [], 0
        if t is not None:
            some.append(t)
            held += len(t)
    if not parts:
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.append(np.concatenate([p[2] for p in parts]), at)


def observations(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after (zero beyond the text), and whether these exist."""
    n = len(rows)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    if n:
        before[1:], after[:-1] = rows[:-1], rows[1:]
    starts, lasts = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[starts], after[lasts] = 0, 0
    edge = np.zeros((n, 3))
    edge[:, 0] = 1
    edge[starts, 1], edge[lasts, 2] = 1, 1
    return np.concatenate([rows, before, after, edge], axis=1)


def _times(rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows of two by a 2 by 2 matrix. Each result depends on its row alone, to the last bit; a library product may not."""
    return np.stack([rows[:, 0] * m[0, k] + rows[:, 1] * m[1, k] for k in (0, 1)], axis=1)


def forward_backward(emission: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for every line, and summed pair marginals (2 by 2). ``emission``: score of state 1 against 0.

    All texts advance together; texts are ordered by their number of lines, so those still running are a prefix.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[:-1][order], lengths[order]
    good = np.exp(np.clip(emission, -40, 40))
    m = np.exp(step)
    n = len(emission)
    alpha, beta, norm = np.ones((n, 2)), np.ones((n, 2)), np.ones(n)
    top = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(1, top + 1), "right")
    for t in range(top):
        at = begin[: running[t]] + t
        prior = _times(alpha[at - 1], m) if t else np.ones((len(at), 2))
        prior[:, 1] *= good[at]
        norm[at] = prior.sum(1)
        alpha[at] = prior / norm[at][:, None]
    for t in range(top - 2, -1, -1):
        at = begin[: running[t + 1]] + t
        ahead = beta[at + 1].copy()
        ahead[:, 1] *= good[at + 1]
        beta[at] = _times(ahead, m.T) / norm[at + 1][:, None]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(1)
    inner = np.ones(n, bool)
    inner[first[:-1][lengths > 0]] = False
    here = np.flatnonzero(inner)
    ahead = beta[here].copy()
    ahead[:, 1] *= good[here]
    pairs = m * (alpha[here - 1].T @ (ahead / norm[here][:, None]))
    return marginal, pairs


class LineField:
    """The random field: standardised observations, emission weights, transition scores."""

    def fit(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 100, ridge: float = 1e-3, rate: float = 0.1) -> LineField:
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.mean[-3:], self.spread[-3:] = 0, 1
        z = (x - self.mean) / self.spread
        self.weight, self.step = np.zeros(x.shape[1]), np.zeros((2, 2))
        inner = np.ones(len(x), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        here = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1)
        moments = [np.zeros(len(self.weight) + 4), np.zeros(len(self.weight) + 4)]
        for k in range(1, steps + 1 if len(x) else 1):
            marginal, pairs = forward_backward(z @ self.weight, self.step, first)
            slope = np.concatenate([z.T @ (y - marginal) / len(x) - ridge * self.weight, ((seen - pairs) / len(x) - ridge * self.step).ravel()])
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.99 * moments[1] + 0.01 * slope**2
            move = rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
            self.weight, self.step = self.weight + move[:-4], self.step + move[-4:].reshape(2, 2)
        return self

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        emission = np.zeros(len(x))
        for k, w in enumerate(self.weight):  # column by column: the same to the last bit whatever lines stand beside
            emission += (x[:, k] - self.mean[k]) / self.spread[k] * w
        return forward_backward(emission, self.step, first)[0]


def good_share(marginal: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight, n = size + 1.0, len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    total = lambda v: np.bincount(text, v, n)
    return total(weight * marginal) / np.maximum(total(weight), 1e-9)


def _fit(rows: np.ndarray, first: np.ndarray, good: np.ndarray) -> LineField:
    x, y = observations(rows, first), np.repeat(good, np.diff(first))
    field = LineField().fit(x, y, first, steps=60)
    if len(x):
        y = np.where((y == 0) & (field.marginals(x, first) > 0.8), 1.0, y)
        field.fit(x, y, first)
    return field


def _fold(k: int, sample: tuple[list[bytes], np.ndarray]) -> dict | np.ndarray:
    """Good shares of the texts of fold k by a field of the others; beyond the folds, the field of all."""
    texts, good = sample
    if k == FOLDS:
        rows, _, first = chunked_features(texts)
        return vars(_fit(rows, first, good))  # plain values: workers need not have the package on their path
    inside = folds(len(texts)) != k
    if not inside.any() or inside.all():
        return np.zeros((~inside).sum())
    rows, _, first = chunked_features([t for t, i in zip(texts, inside, strict=True) if i])
    field = _fit(rows, first, good[inside])
    rows, size, first = chunked_features([t for t, i in zip(texts, inside, strict=True) if not i])
    return good_share(field.marginals(observations(rows, first), first), size, first)


class QualityModel:
    def fit(self, texts: list[bytes], good: np.ndarray, runner: Runner = here) -> QualityModel:
        *shares, field = runner(_fold, (texts, good), FOLDS + 1)
        self.field = LineField()
        vars(self.field).update(field)
        part, share = folds(len(texts)), np.zeros(len(texts))
        for k in range(FOLDS):  # the calibration sees only shares of texts that the field has not seen
            share[part == k] = shares[k]
        self.calibration = Isotonic().fit(share, good, prior=float(good.mean()) if len(good) else 0.5)
        return self

    def lines(self, texts: list[bytes]) -> list[np.ndarray]:
        """Probability of being good for every line of every text."""
        rows, _, first = line_features(texts)
        return np.split(self.field.marginals(observations(rows, first), first), first[1:-1])

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        rows, size, first = line_features(texts)
        share = good_share(self.field.marginals(observations(rows, first), first), size, first)
        return np.clip(0.999 * self.calibration(share) + 0.001 * share, 0.0, 1.0)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found, some, held = [], [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= CHUNK:
                found.append(self._chunk(some))
                some, held = [], 0
        if some:
            found.append(self._chunk(some))
        return np.concatenate(found) if found else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return QualityModel().fit(*labelled_sample(docs, labels, "quality"), in_tasks(docs.sparkSession))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: words, word pairs and byte n-grams, hashed to a fixed
number of features. Every feature is scaled by its log-count ratio between the classes (naive
Bayes, smoothed), texts are scaled to unit length, and a linear hinge-loss model is fitted on
them by dual coordinate descent. A logistic curve, fitted on training rows the linear model has
not seen, turns the margin into a score from 0 to 1.

The fit reads a bounded sample of labelled rows (``max_labelled``, by hash of the id); scoring
reads every whole text. Null and empty texts have no feature and get the score of the margin's
intercept. Rows with a null id are scored, never learned from. With labels of one class, or
none, the score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import WordHash, ascii_lower_words, hashes, texts
from wardlake.llm.toxicity import sample

BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20  # bytes of a text whose byte n-grams are made at once


@dataclass
class Model:
    weights: np.ndarray  # margin weight by feature, the log-count ratio included
    ratios: np.ndarray  # log-count ratio by feature
    bias: float
    slope: float
    intercept: float

    def score(self, features: np.ndarray) -> float:
        r = self.ratios[features]
        length = math.sqrt(float(r @ r))
        margin = (float(self.weights[features].sum()) / length if length else 0.0) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * margin + self.intercept))))


def features_of(memo: WordHash, text: str | None) -> np.ndarray:
    """The distinct features of a whole text, ascending."""
    words = ascii_lower_words(text)
    if not words:
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    h = hashes(memo, words)
    parts = [h * MIX >> shift, ((h[:-1] * np.uint64(3) ^ h[1:]) * MIX) >> shift]
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    for start in range(0, max(len(raw) - 2, 1), CHUNK):  # overlapping by the n-gram length
        b = raw[start:start + CHUNK + 3].astype(np.uint64)
        g = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
        parts.append(np.unique(g * MIX >> shift))
    return np.unique(np.concatenate(parts)).astype(np.int64)


def dual_coordinate_descent(rows: list[np.ndarray], value, y: np.ndarray, n: int,
                            cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model: min |w|^2/2 + sum cost_i max(0, 1 - y_i (w x_i + b)); the bias is
    a feature of value 1. ``value(i)`` has the values of the features ``rows[i]``."""
    w, b, alpha = np.zeros(n), 0.0, np.zeros(len(rows))
    q = np.array([float(v @ v) + 1.0 for v in map(value, range(len(rows)))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = value(i)
            g = y[i] * (float(w[rows[i]] @ x) + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def train(rows: list[np.ndarray], y01: np.ndarray, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    n = 1 << BITS
    if len(rows) == 0 or y01.min() == y01.max():
        p = (y01.sum() + 0.5) / (len(y01) + 1) if len(rows) else 0.5
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 0.0, math.log(p / (1 - p)))
    hold = np.arange(len(rows)) % 4 == 3  # for the curve
    if len(set(y01[hold])) < 2 or len(set(y01[~hold])) < 2:
        hold = np.zeros(len(rows), bool)
    fit = np.flatnonzero(~hold)
    counts = np.full((2, n), smoothing)
    for i in fit:
        counts[y01[i], rows[i]] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # a feature the sample has not shown says nothing
    ratios[(counts.sum(0) - 2 * smoothing) < 0.5] = 0.0

    def scaled(i: int) -> np.ndarray:
        r = ratios[rows[i]]
        return r / max(float(np.sqrt(r @ r)), 1e-12)

    y = np.where(y01 == 1, 1.0, -1.0)
    share = y01[fit].mean()
    costs = cost * np.where(y01[fit] == 1, 0.5 / share, 0.5 / (1 - share))
    w, b = dual_coordinate_descent([rows[i] for i in fit], lambda k: scaled(fit[k]), y[fit], n, costs)
    on = np.flatnonzero(hold) if hold.any() else fit
    margin = np.array([float(w[rows[i]] @ scaled(i)) + b for i in on])
    a, c = 1.0, 0.0
    design = np.stack([margin, np.ones_like(margin)], 1)
    v = np.array([a, c])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ v, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3,
                               design.T @ (y01[on] - p) - 1e-3 * v)
        v += step
        if np.abs(step).max() < 1e-8:
            break
    return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), float(b), float(max(v[0], 0.0)), float(v[1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = 8_000) -> Model:
    """Learn from at most about ``max_labelled`` labelled rows outside fold 0. Their features come
    to the driver, a few kB a row: bounded by ``max_labelled``. Copies of a text count once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            for start, values in texts(batch.column(2)):
                got = [features_of(memo, t).astype("<u4").tobytes() for t in values]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(start, len(got)) for c in (0, 1)]
                                                 + [pa.array(got, pa.binary())], ["id", "y", "f"])

    data = (sample(docs, labels, label_col, id_col, text_col, max_labelled)
            .mapInArrow(run, "id bigint, y int, f binary").groupBy("f", "y").agg(F.min("id").alias("id")).select("id", "y", "f").toArrow().sort_by("id"))
    rows = [np.frombuffer(x.as_buffer(), "<u4") for x in data.column("f")]  # views, no copies
    return train(rows, np.array(data.column("y").to_pylist(), np.int64))


def _scores(model: Model):
    memo = WordHash()

    def of(values: list) -> list[float]:
        return [model.score(features_of(memo, t)) for t in values]

    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``: one narrow map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a feature, 2^BITS features

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(shared.value)
        for batch in batches:
            for start, values in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(values)), pa.array(of(values), pa.float64())],
                                                 ["id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text").mapInArrow(run, "id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(shared.value)
        for batch in batches:
            for start, values in texts(batch.column(at)):
                yield batch.slice(start, len(values)).filter(pa.array([s >= threshold for s in of(values)]))

    return docs.mapInArrow(run, docs.schema)

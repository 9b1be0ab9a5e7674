"""Toxicity by maximum-scoring segments.

Every token has a log-odds score of the toxic against the clean labelled documents, with an
informative Dirichlet prior (the pooled counts) and a test of significance; tokens without
significant odds cost a small drift. A linear scan (all maximal scoring subsequences) finds
every toxic passage of a whole text. The segments' scores are turned into an expect value by
extreme-value statistics for the text's length, and a logistic curve fitted on the training
rows turns that into a score from 0 to 1.

Learning reads a bounded sample of labelled rows (``max_labelled``, the rows with the smallest
hash of their id); scoring reads every whole text. Null and empty texts have no token, no
segment and the score of a text without toxic passage. Rows with a null id are scored, never
learned from. An empty label table gives a model that finds nothing.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import fold, texts
from wardlake.llm.licenses import words_of

DRIFT = -0.5  # a token without significant odds
PRIOR = 0.1  # prior counts per pooled count
SIGNIFICANT_Z = 1.96
MIN_SEGMENT = 3.0  # natural-log odds a reported passage needs at least

SCHEMA = ("id bigint, score double, n_words bigint, expect double, "
          "segments array<struct<start:int,stop:int,score:double>>")


@dataclass
class Model:
    odds: dict[bytes, float] = field(default_factory=dict)
    positive: frozenset = frozenset()
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = -3.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def maximal_segments(scores: Iterable[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop exclusive, score) in one pass over the scored
    places; the tokens between two places cost ``drift`` each."""
    # left and right: cumulative score before and behind each candidate; below: the last candidate
    # before it with a smaller left. Those between have larger ones, so no search visits them again.
    out: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, s in scores:
        total += drift * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        start, left, j = at, total, len(out) - 1
        total += s
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, at + 1, left, total, j))
                break
            start, _, left, _, below = out[j]
            del out[j:]
            j = below
    return [(a, b, right - left) for a, b, left, right, _ in out]


def segments_of(model: Model, words: list[bytes]) -> list[tuple[int, int, float]]:
    if model.positive.isdisjoint(words):
        return []
    odds = model.odds
    return [s for s in maximal_segments((i, odds[w]) for i, w in enumerate(words) if w in odds) if s[2] >= MIN_SEGMENT]


def evidence_of(model: Model, n: int, scores: list[float]) -> float:
    """Minus the natural log of the expect value of the best r segments together (the r that
    says most), 0 without segments."""
    best, total = 0.0, 0.0
    space = math.log(model.k * max(n, 1))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += model.lam * s - space
        best = max(best, total + math.lgamma(r + 1))
    return best


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str,
           max_labelled: int, learn: int = 0) -> DataFrame:
    """(id, y, text) of at most about ``max_labelled`` labelled rows outside fold ``learn``.

    The share is taken by hash of the id, so it does not depend on order or partitions. A label
    row is used once per id (the larger label of repeated ones); null labels and ids are left out."""
    lab = (labels.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{label_col}` as int) y")
           .where("id is not null and y in (0, 1)").where(fold("id") != learn).groupBy("id").agg(F.max("y").alias("y")))
    share = min(1.0, max_labelled / max(lab.count(), 1))
    if share < 1:
        lab = lab.where(F.xxhash64("id") < int((2 * share - 1) * 2**63))
    # bounded by max_labelled rows of 12 bytes
    return (docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text")
            .join(F.broadcast(lab), "id").where("text is not null").select("id", "y", "text"))


def _counts(train: DataFrame) -> DataFrame:
    """(word, toxic documents, clean documents), each different text counted once per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_pylist()
            by: tuple[Counter, Counter] = (Counter(), Counter())
            for start, values in texts(batch.column(2)):
                for i, t in enumerate(values):
                    by[y[start + i]].update(set(words_of(t)))
            words = list(set(by[0]) | set(by[1]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([by[1][w] for w in words], pa.int64()),
                                              pa.array([by[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    one = train.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("id").alias("id"))
    return (train.join(F.broadcast(one.select("id")), "id").mapInArrow(run, "word binary, toxic bigint, clean bigint")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = 20_000, min_docs: int = 5) -> Model:
    """Learn from at most about ``max_labelled`` labelled rows outside fold 0. What comes to the
    driver is bounded by them: the significant words, and one row of figures per sampled text."""
    train = sample(docs, labels, label_col, id_col, text_col, max_labelled).cache()
    try:
        n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not n.get(1) or not n.get(0):
            return Model(intercept=-3.0 if not n.get(1) else 0.0)
        counts = _counts(train)
        total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
        nt, nc = float(total[0] or 0), float(total[1] or 0)
        a0 = PRIOR * (nt + nc)
        prior = (F.col("toxic") + F.col("clean")) * PRIOR
        scored = (counts.where(F.col("toxic") + F.col("clean") >= min_docs).withColumn("a", prior)
                  .withColumn("odds", F.log((F.col("toxic") + F.col("a")) / (nt + a0 - F.col("toxic") - F.col("a")))
                              - F.log((F.col("clean") + F.col("a")) / (nc + a0 - F.col("clean") - F.col("a"))))
                  .withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + F.col("a")) + 1 / (F.col("clean") + F.col("a")))))
        # for more tokens than a text of the sample can hold, z must be larger to mean anything
        rows = scored.where(F.abs("z") >= SIGNIFICANT_Z).select("word", "odds", "z", "toxic", "clean").collect()
        tests = max(counts.count(), 1)
        need = max(SIGNIFICANT_Z, math.sqrt(2 * math.log(tests)) * 0.75)
        odds = {bytes(r["word"]): r["odds"] for r in rows if r["z"] >= need or (r["odds"] < 0 and r["z"] <= -need)}
        model = Model(odds, frozenset(w for w, v in odds.items() if v > 0))
        figures = [json.loads(r["f"]) for r in train.mapInArrow(_figures(model), "f string").collect()]
    finally:
        train.unpersist()
    _calibrate(model, figures)
    return model


def _figures(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, out = batch.column(1).to_pylist(), []
            for start, values in texts(batch.column(2)):
                for i, t in enumerate(values):
                    words = words_of(t)
                    out.append(json.dumps([y[start + i], len(words), [round(s[2], 4) for s in segments_of(model, words)]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["f"])

    return run


def _calibrate(model: Model, figures: list) -> None:
    """Extreme-value parameters from the clean rows' best segments, then the logistic curve."""
    clean = [(n, max(s)) for y, n, s in figures if y == 0 and s]
    n_clean = max(sum(y == 0 for y, _, _ in figures), 1)
    # tail of the best score: its rate from the mean excess, its frequency K from the share of clean rows
    # with a segment; natural-log odds are their own scale, so one excess of 1 and half a row stand beforehand
    model.lam = 1 / max((sum(v - MIN_SEGMENT for _, v in clean) + 1) / (len(clean) + 1), 0.25)
    places = max(np.mean([n for _, n, _ in figures]), 1)
    model.k = min(1.0, (len(clean) + 0.5) / n_clean / places * math.exp(model.lam * MIN_SEGMENT))
    x = np.array([min(evidence_of(model, n, s), 20.0) for _, n, s in figures])
    y = np.array([f[0] for f in figures], float)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-6, 0.05])
        step = np.linalg.solve(h, design.T @ (y - p) - np.array([0.0, 0.05]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))


def score_words(model: Model, words: list[bytes]) -> tuple[float, float, list]:
    found = segments_of(model, words)
    e = evidence_of(model, len(words), [s[2] for s in found])
    return model.probability(min(e, 20.0)), math.exp(-min(e, 700.0)), found


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, n_words, expect value and every passage found
    (word positions and score). One narrow map over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for start, values in texts(batch.column(1)):
                words = [words_of(t) for t in values]
                got = [score_words(shared.value, w) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(got)), pa.array([g[0] for g in got], pa.float64()),
                     pa.array([len(w) for w in words], pa.int64()), pa.array([g[1] for g in got], pa.float64()),
                     pa.array([[dict(zip(("start", "stop", "score"), s)) for s in g[2]] for g in got], kind)],
                    ["id", "score", "n_words", "expect", "segments"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, values in texts(batch.column(at)):
                stay = [score_words(shared.value, words_of(t))[0] < threshold for t in values]
                yield batch.slice(start, len(values)).filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)

"""Centroid clustering of integer vectors by scalar lookup tables.

A component x becomes the integer floor(``scale`` * x), x as double. In each round every task
tabulates, for each dimension, each integer value that occurs in its batch and each centroid, the
squared difference; a vector's distances to all centroids are then gathers from that table and
sums, without a multiplication per vector. The centroids begin as the vectors whose ids have the
smallest SHA-256 and move, for a fixed number of rounds, to the exact floor of their members'
mean; a centroid without members stays. Distances and sums are exact integers.

Only centroids and sums per centroid and dimension (clusters x dim rows) come to the driver,
never vectors. A task adds up its own sums first, so a cluster that holds most rows is no hot key.

Vectors that are null, have another length than ``dim``, or hold null or non-finite components
are left out and get no row; so are those with a component of 2**27 or more after scaling, whose
distances a long could not hold. Rows with a null id are clustered, but never start a centroid.
Rows that repeat an id are vectors of their own; where they tie for a start, the smaller vector
comes first. With fewer vectors than ``clusters`` there are fewer centroids; with ids all null or
an empty table there are none and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import keep

LIMIT = 1 << 27  # 64 * (2 * LIMIT) ** 2 stays within a long
ROWS = 4096  # vectors whose distances a task holds at once


def quantize(vectors: DataFrame, id_col: str, emb_col: str, dim: int, scale: int) -> DataFrame:
    """Rows (id, q): the vectors that can be clustered, as integers."""
    emb = F.col(emb_col)
    scaled = F.transform(emb, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(emb, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT), F.lit(False)))
    return vectors.where((F.size(emb) == dim) & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(scaled, lambda x: x.cast("int")).alias("q"))


def tables(x: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension: the squared differences, a row for each value that occurs there and a
    column for each centroid, and the row of each vector's value."""
    for d in range(x.shape[1]):
        values, place = np.unique(x[:, d], return_inverse=True)
        gap = values[:, None] - centroids[:, d][None, :]
        yield gap * gap, place


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each row of ``x``."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for table, place in tables(x, centroids):
        total += table[place]
    near = total.argmin(1)
    return near, total[np.arange(len(x)), near]


def _matrix(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        yield part.column(0), part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Members and component sums of every centroid: rows (cluster, d, n, s)."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, seen = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0

        def out() -> pa.RecordBatch:
            c, d = np.divmod(np.arange(k * dim), dim)
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (c, d, n[c], s.ravel())], ["cluster", "d", "n", "s"])

        for batch in batches:
            for _, x in _matrix(batch, dim):
                near, _ = assign(x, centroids)
                n += np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                cuts = np.flatnonzero(np.diff(near[order], prepend=-1))
                s[near[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
                seen += len(x)
                if seen >= 1 << 33:  # long before a sum could leave 64 bits
                    yield out()
                    n, s, seen = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        if seen:
            yield out()

    part = points.mapInArrow(run, "cluster bigint, d bigint, n bigint, s bigint")
    return part.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"),
                                            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def fit(points: DataFrame, clusters: int, rounds: int, seed: int, dim: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds over all ``points``, a row each."""
    start = (points.where("id is not null").select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"))
             .orderBy("h", "q").limit(clusters).collect())
    centroids = np.array([r.q for r in start], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(points, centroids).collect():  # clusters x dim rows
            if r.n:
                centroids[r.cluster, r.d] = int(r.s) // int(r.n)
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", emb_col: str = "embedding", clusters: int = 16,
            rounds: int = 3, seed: int = 1, dim: int = 64, scale: int = 64) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per vector
    that takes part; see the module."""
    spark = vectors.sparkSession
    points = keep(quantize(vectors, id_col, emb_col, dim, scale), "points")
    centroids = fit(points, clusters, rounds, seed, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _matrix(batch, dim):
                if len(centroids):
                    near, far = assign(x, centroids)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    found = keep(points.mapInArrow(run, "id bigint, cluster int, distance bigint"), "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # a row per centroid, so ``clusters`` bounds what is broadcast
    facts = spark.createDataFrame([(i, per[i], sum(per.values()), digest) for i, digest in digests if i in per],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Approximate nearest neighbours by inner product: multi-index hashing over learned binary codes.

Vectors get one more component that gives all the same length, so the largest inner product is
the smallest angle; queries get a zero there. Codes are the signs of several learned rotations
(principal axes, then iterative quantization), fitted on a bounded sample of at most about
``sample_rows`` vectors. Every row is indexed. A block of the index cuts its codes into substrings
of one byte; each substring's table holds, for each byte, which rows of the block lie within the
substring radius, so a query collects from its own byte of each table every row with a substring
that near. By the pigeonhole principle these are all rows within the Hamming radius; the others
are dropped by the full code, and what is left is ranked by the inner product in double precision.

The radius is not guessed: ``calibration`` queries are compared with all rows, and the radius
reaches ``coverage`` of their true neighbours. A query that still finds fewer than k rows is
searched again without a radius, so no query comes back short.

Blocks of rows and blocks of queries are dealt out by a hash and meet block by block: the query
set is part of the call, each task holds two bounded blocks, and k rows a query leave it.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part; nor do
rows with a null id. Vectors of different length don't meet. Rows that repeat an id: the smallest
vector is the query, every row is a candidate of other ids. Ties go to the smaller id. An empty
table, or no query, gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlake.llm.common import keep
from wardlake.llm.rp_forest import matrix, usable

BITS = 256
BLOCK = 4096  # rows or queries in a block, about
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)[None, :]]  # distance of two bytes


@dataclass
class Codes:
    """Rotations for one vector length. ``longest``: the length all rows are brought to."""

    mean: np.ndarray
    planes: np.ndarray
    longest: float

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.packbits((self._lift(x, query) - self.mean) @ self.planes > 0, axis=1)

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        scale = np.sqrt((x * x).sum(1, keepdims=True)) if query else self.longest
        x = x / scale
        rest = np.zeros((len(x), 1)) if query else np.sqrt(np.clip(1 - (x * x).sum(1, keepdims=True), 0, None))
        return np.hstack([x, rest])


def learn(x: np.ndarray, longest: float, bits: int = BITS, rounds: int = 10, seed: int = 5) -> Codes:
    """Rotations by iterative quantization on the sample ``x``: as many as make ``bits`` signs."""
    codes = Codes(np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, 0)), longest)
    lifted = codes._lift(x, False)
    # the origin stays the centre, for queries are not spread as the rows are
    _, axes = np.linalg.eigh(lifted.T @ lifted)
    rng = np.random.default_rng(seed)
    planes, dim = [], lifted.shape[1]
    while sum(p.shape[1] for p in planes) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        v = lifted @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        planes.append(axes @ r)
    codes.planes = np.hstack(planes)[:, :bits]
    return codes


class Index:
    """The codes of a block with a table for each substring (byte): a bitmap of the rows whose
    substring lies within ``radius`` bits, for each value."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, n = codes, len(codes)
        self.tables = []
        near = _NEAR <= radius
        for j in range(codes.shape[1]):
            bucket = np.zeros((256, n), bool)
            bucket[codes[:, j], np.arange(n)] = True
            held = np.flatnonzero(np.bincount(codes[:, j], minlength=256))  # values that occur
            packed = np.packbits(bucket[held], axis=1)
            table = np.zeros((256, packed.shape[1]), np.uint8)
            for v in range(256):
                own = packed[near[v, held]]
                if len(own):
                    table[v] = np.bitwise_or.reduce(own, axis=0)
            self.tables.append(table)

    def probe(self, code: np.ndarray) -> np.ndarray:
        """Rows with at least one substring within the radius of the query's."""
        found = self.tables[0][code[0]].copy()
        for j in range(1, len(code)):
            found |= self.tables[j][code[j]]
        return np.flatnonzero(np.unpackbits(found, count=len(self.codes)))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(codes: dict[int, Codes], radius: dict[int, int], k: int):
    """Each query's k best rows of the block within the radius."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x, q = matrix(left.column("emb")), matrix(right.column("emb"))
            ids, qids = left.column("vec").to_numpy(), right.column("qid").to_numpy()
            r = radius[dim]
            width = codes[dim].planes.shape[1]
            code, qcode = codes[dim].of(x), codes[dim].of(q, query=True)
            index = Index(code, r // code.shape[1]) if r < width else None
            for i in range(len(q)):
                at = index.probe(qcode[i]) if index else np.arange(len(x))
                at = at[_POP[code[at] ^ qcode[i]].sum(1, dtype=np.int64) <= r]
                at = at[ids[at] != qids[i]]
                if not len(at):
                    continue
                s = (x[at] * q[i]).sum(1)
                best = _best(ids[at], s, k)
                out_q.append(np.full(len(best), qids[i]))
                out_v.append(ids[at][best])
                out_s.append(s[best])
        flat = [np.concatenate(o) if o else np.zeros(0, t) for o, t in
                ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64))]
        return pa.table({"query_id": pa.array(flat[0]), "vec_id": pa.array(flat[1]), "score": pa.array(flat[2])})

    return run


def _calibrate(rows: DataFrame, queries: DataFrame, codes: dict[int, Codes], k: int, calibration: int,
               coverage: float) -> dict[int, int]:
    """The Hamming radius, by vector length, that reaches ``coverage`` of the true neighbours of
    a few queries (``calibration``, by hash of the id), found among all rows."""
    n = max(queries.count(), 1)
    few = queries.where(F.pmod(F.xxhash64("qid"), F.lit(1 << 30)) < int(min(1.0, calibration / n) * (1 << 30))).toArrow()
    held = {d: few.filter(pc.equal(few.column("dim"), d)) for d in codes}

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                mine = held[d]
                if not len(mine):
                    continue
                x, q = matrix(pa.chunked_array([part.column("emb")])), matrix(mine.column("emb"))
                ids, qids = part.column("vec").to_numpy(), mine.column("qid").to_numpy()
                far = _POP[codes[d].of(x)[None, :, :] ^ codes[d].of(q, query=True)[:, None, :]].sum(2, dtype=np.int32)
                for i in range(len(q)):
                    at = np.flatnonzero(ids != qids[i])
                    s = (x[at] * q[i]).sum(1)
                    best = at[_best(ids[at], s, k)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d] * len(best), pa.int32()), pa.array([int(qids[i])] * len(best), pa.int64()),
                         pa.array(ids[best], pa.int64()), pa.array((x[best] * q[i]).sum(1)),
                         pa.array(far[i, best], pa.int32())], ["dim", "qid", "vec", "score", "far"])

    w = Window.partitionBy("dim", "qid").orderBy(F.desc("score"), "vec")
    true = (rows.mapInArrow(run, "dim int, qid bigint, vec bigint, score double, far int")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    got = true.groupBy("dim").agg(F.percentile("far", coverage).alias("r")).collect()
    radius = {d: c.planes.shape[1] for d, c in codes.items()}
    radius.update({r["dim"]: int(np.ceil(r["r"])) for r in got})
    return radius


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = BITS, sample_rows: int = 8192,
            calibration: int = 64, coverage: float = 0.985, block: int = BLOCK, id_col: str = "vec_id",
            emb_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product found for each
    query, nearest first. ``is_query`` is a condition on the column ``id``."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(emb_col).cast("array<double>").alias("emb"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("emb"))).withColumn("dim", F.size("emb"))
    rows = keep(rows.withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1 << 30))), "mih")
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v * v))
    sizes = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("m")).collect()}
    codes = {}
    for d, r in sizes.items():
        # bounded: sample_rows vectors
        some = rows.where(F.col("dim") == d).where(F.col("u") < int(min(1.0, sample_rows / r["n"]) * (1 << 30)))
        x = matrix(some.orderBy("id").select("emb").toArrow().column("emb"))
        codes[d] = learn(x if len(x) else np.eye(d) * r["m"], r["m"], bits)
    queries = keep(rows.where(is_query).groupBy("id", "dim").agg(F.min("emb").alias("emb"))
                   .withColumnRenamed("id", "qid"), "queries")
    vecs = rows.withColumnRenamed("id", "vec")
    radius = _calibrate(vecs, queries, codes, k, calibration, coverage)

    n_rows, n_queries = sum(r["n"] for r in sizes.values()), queries.count()
    nb, nq = max(1, -(-n_rows // block)), max(1, -(-n_queries // block))
    out = "query_id bigint, vec_id bigint, score double"

    def meet(asked: DataFrame, n_asked: int, reach: dict[int, int]) -> DataFrame:
        left = (vecs.withColumn("b", F.pmod(F.xxhash64("vec", "emb"), F.lit(nb)))
                .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))))
        right = (asked.withColumn("c", F.pmod(F.xxhash64("qid"), F.lit(n_asked)).cast("int"))
                 .withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint")))))
        return left.groupBy("dim", "b", "c").cogroup(right.groupBy("dim", "b", "c")).applyInArrow(_search(codes, reach, k), out)

    found = keep(meet(queries, nq, radius), "found")
    # fewer than k within the radius: all rows are asked, without one
    own = F.broadcast(vectors.sparkSession.createDataFrame([(int(d), int(r["n"])) for d, r in sizes.items()] or [(0, 0)],
                                                           "dim int, n bigint"))  # a row for each vector length
    got = found.groupBy(F.col("query_id").alias("qid")).agg(F.count("*").alias("got"))
    short = keep(queries.join(got, "qid", "left").join(own, "dim")
                 .where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("qid", "dim", "emb"), "short")
    n_short = short.count()
    if n_short:
        again = meet(short, max(1, -(-n_short // block)), {d: c.planes.shape[1] for d, c in codes.items()})
        found = found.join(short.select(F.col("qid").alias("query_id")), "query_id", "left_anti").unionByName(again)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

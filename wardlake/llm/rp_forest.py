"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Every tree splits its points again and again by a random direction at the sampled median;
points within ``spill`` of the threshold go to both sides, so a pair at the cosine bound is
seldom torn apart, and a pair torn apart in one tree meets in another. Leaves are compared
whole. A pair that meets in several leaves counts in the one with the smallest number only.

Trees grow in rounds: in each, every node above ``leaf`` points fits a subtree of a few levels on
a bounded sample of its points, where the points are; nodes and thresholds stay in tables. A
node that no direction divides (very many near copies) stays one leaf; leaves are compared in
blocks of at most about ``leaf`` points against each other, a task for each two blocks, so no
leaf is ever one task's work. What leaves a task is linear in its points: link counts and a
spanning star of its links, never pairs. Equal vectors are one point with a weight.

Vectors that are null, empty or zero, or hold null or non-finite components, have no links; nor
have vectors with a null label. Vectors of different length are never compared. Rows with a null
id take no part and get no component. Rows that repeat an id are vectors of their own under that
id. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import components, keep

TREES = 6
LEAF = 1024
SAMPLE = 4096  # points a node's thresholds are fitted on
LEVELS = 6  # of a subtree fitted at once


def usable(emb: Column) -> Column:
    """The vector can be compared: not null, finite throughout, not zero."""
    fine = F.forall(emb, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(emb) > 0) & fine & F.exists(emb, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of equally long vectors as a float64 matrix."""
    flat = column.combine_chunks()
    values = np.asarray(flat.flatten(), np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _direction(seed: int, dim: int) -> np.ndarray:
    v = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF).standard_normal(dim)
    return v / np.linalg.norm(v)


def fit_subtree(x: np.ndarray, size: int, seed: int, spill: float, leaf: int) -> np.ndarray:
    """Thresholds of a subtree (heap order, NaN: leaf) for a node of ``size`` points. ``spill`` is the
    overlap of vectors of one component; longer ones lie closer along a direction."""
    thresholds = np.full(2 ** LEVELS - 1, np.nan)
    spill /= math.sqrt(x.shape[1])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if len(own) < 16 or size * len(own) / max(len(x), 1) <= leaf:
            continue
        p = x[own] @ _direction(seed + node, x.shape[1])
        at = float(np.median(p))
        left, right = own[p <= at + spill], own[p >= at - spill]
        if max(len(left), len(right)) > 0.9 * len(own):
            continue
        thresholds[node] = at
        if 2 * node + 2 < len(thresholds):
            todo += [(2 * node + 1, left), (2 * node + 2, right)]
    return thresholds


def route(x: np.ndarray, thresholds: np.ndarray, seed: int, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, grows): the leaves of the subtree each point falls into. ``grows``: the leaf
    lies at the subtree's last level, so it may be split further."""
    rows, places, grows = [], [], []
    spill /= math.sqrt(x.shape[1])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node >= len(thresholds) or np.isnan(thresholds[node]):
            rows.append(own)
            places.append(np.full(len(own), node, np.int64))
            grows.append(np.full(len(own), node >= len(thresholds)))
            continue
        p = x[own] @ _direction(seed + node, x.shape[1])
        todo += [(2 * node + 1, own[p <= thresholds[node] + spill]), (2 * node + 2, own[p >= thresholds[node] - spill])]
    return np.concatenate(rows), np.concatenate(places), np.concatenate(grows)


def _child(node: int, place: np.ndarray) -> np.ndarray:
    z = (np.uint64(node & 0xFFFFFFFFFFFFFFFF) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


POINT = "nid bigint, label bigint, dim int, tree int, node bigint, open boolean, emb array<double>"


def leaves(points: DataFrame, trees: int, leaf: int, spill: float) -> DataFrame:
    """(nid, label, dim, tree, node, open, emb): every point in every leaf it falls into."""
    t = (points.withColumn("tree", F.explode(F.array(*map(F.lit, range(trees)))))
         .withColumn("node", F.xxhash64("label", "dim", "tree")).withColumn("open", F.lit(True))
         .select("nid", "label", "dim", "tree", "node", "open", "emb"))

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        x = matrix(rows.column("emb"))
        th = fit_subtree(x, rows.column("size")[0].as_py(), key[1].as_py(), spill, leaf)
        return pa.table({"label": [key[0].as_py()], "node": [key[1].as_py()], "model": pa.array([th.tobytes()], pa.binary())})

    def rows(part: pa.RecordBatch, node: np.ndarray, grows: np.ndarray) -> pa.RecordBatch:
        new = {"node": pa.array(node, pa.int64()), "open": pa.array(grows, pa.bool_())}
        names = ["nid", "label", "dim", "tree", "node", "open", "emb"]
        return pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names)

    def send(batches):
        for batch in batches:
            model = batch.column("model").to_pylist()
            node = batch.column("node").to_numpy()
            rest = np.array([m is None for m in model], bool)
            yield rows(batch.filter(pa.array(rest)), node[rest], np.zeros(rest.sum(), bool))
            for n in np.unique(node[~rest]):
                own = np.flatnonzero((node == n) & ~rest)
                part = batch.take(pa.array(own))
                x = matrix(pa.chunked_array([part.column("emb")]))
                r, place, grows = route(x, np.frombuffer(model[own[0]], np.float64), int(n), spill)
                yield rows(part.take(pa.array(r)), _child(int(n), place), grows)

    while True:
        t = keep(t, "forest")
        sizes = (t.where("open").groupBy("label", "node").agg(F.count("*").alias("size")).where(F.col("size") > leaf))
        if sizes.isEmpty():
            return t
        some = t.where("open").join(sizes, ["label", "node"]).where(
            F.pmod(F.xxhash64("nid", "node"), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("size"))
        models = some.groupBy("label", "node").applyInArrow(fit, "label bigint, node bigint, model binary")
        t = (t.join(models, ["label", "node"], "left")
             .select("nid", "label", "dim", "tree", "node", "open", "emb", "model").mapInArrow(send, POINT))


def _local_components(a: np.ndarray) -> np.ndarray:
    """Smallest index of each point's component under the symmetric links ``a``."""
    label = np.arange(len(a))
    while True:
        low = np.minimum(label, np.where(a, label[None, :], len(a)).min(1, initial=len(a)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(cosine: float):
    """Link counts and a spanning star of the links between the two blocks of a leaf."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        node, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        t = t.sort_by("nid")
        chunk = t.column("chunk").to_numpy()
        x = unit(matrix(t.column("emb")))
        one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        near = x[one] @ x[two].T >= cosine
        if i == j:
            np.fill_diagonal(near, False)
        # pairs that also meet in a leaf of a smaller number count there
        r, c = near.nonzero()
        involved = np.unique(np.concatenate([one[r], two[c]]))
        marks: dict[int, int] = {}
        cells = []
        member = t.column("leaves")
        for p in involved.tolist():
            for leaf in member[p].as_py():
                if leaf < node:
                    cells.append((p, marks.setdefault(leaf, len(marks))))
        if cells:
            m = np.zeros((len(x), len(marks)), np.float32)
            m[tuple(np.array(cells).T)] = 1
            near &= m[one] @ m[two].T == 0
        weight = t.column("weight").to_numpy()
        links = np.zeros(len(x), np.int64)
        links[one] += near @ weight[two]
        if i != j:
            links[two] += near.T @ weight[one]
        full = np.zeros((len(x), len(x)), bool)
        full[np.ix_(one, two)] = near
        low = _local_components(full | full.T)
        nid = t.column("nid").to_numpy()
        some = np.flatnonzero(links)
        return pa.table({"nid": pa.array(nid[some]), "links": pa.array(links[some]), "root": pa.array(nid[low[some]])})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF,
                    spill_share: float = 0.65, id_col: str = "vec_id", emb_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``: links join vectors of one
    label with a cosine of ``cosine`` or more, in double precision. The overlap of a split is
    ``spill_share`` of the standard deviation that a pair at the bound has along a direction, for
    vectors of that length."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                          F.col(emb_col).cast("array<double>").alias("emb"))
    rows = rows.withColumn("part", F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("emb")))
    for k in (1, 2):  # 128 bits name a vector
        rows = rows.withColumn(f"k{k}", F.xxhash64(F.lit(k), "label", "emb"))
    dim = F.size("emb")
    classes = (rows.where("part").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("emb").alias("emb")))
    classes = keep(classes.withColumn("dim", dim).withColumn("nid", F.monotonically_increasing_id()), "vectors")
    spill = spill_share * math.sqrt(max(2 - 2 * cosine, 0.0))
    points = classes.select("nid", "label", "dim", F.col("emb"))
    # directions apply to unit vectors
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, v: s + v * v))
    placed = leaves(points.withColumn("emb", F.transform("emb", lambda v: v / norm)), trees, leaf, spill)

    member = placed.groupBy("nid").agg(F.collect_set("node").alias("leaves"))  # trees x overlap, bounded
    sizes = placed.groupBy("label", "dim", "node").agg(F.ceil(F.countDistinct("nid") / leaf).cast("int").alias("m"))
    blocks = (placed.select("nid", "label", "dim", "node").distinct().join(sizes, ["label", "dim", "node"])
              .withColumn("chunk", F.pmod(F.xxhash64("nid", "node"), F.col("m")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
              .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")))
    compared = (blocks.join(classes.select("nid", "emb", "weight"), "nid").join(member, "nid")
                .select("label", "node", "i", "j", "dim", "chunk", "nid", "emb", "weight", "leaves"))
    found = keep(compared.groupBy("label", "node", "i", "j", "dim").applyInArrow(
        _compare(cosine), "nid bigint, links bigint, root bigint"), "links")

    label = components(found.selectExpr("nid a", "root b"), "vec").withColumnRenamed("node", "nid")
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    known = (classes.select("k1", "k2", "nid", "rep", "weight").join(links, "nid", "left").join(label, "nid", "left")
             .withColumn("c", F.coalesce("component", "nid")))
    known = known.join(known.groupBy("c").agg(F.min("rep").alias("component_id")), "c")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id",
                         F.lit(True).alias("part"))
    return (rows.select("id", "k1", "k2", "part").join(known, ["k1", "k2", "part"], "left")
            .select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))

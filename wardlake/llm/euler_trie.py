"""The prefix trie of conversations, with subtree totals by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text); its members are the conversations that
start with it. Nodes come from rolling hashes of 2 x 64 bits of the turns' SHA-256 along each
conversation. Each node then gets an enter and an exit arc, every arc the arc that follows it on
the tour around the trie, and the tour is list-ranked: in rounds, arcs whose random number is
smaller than both neighbours' are spliced out and put back in reverse order, until a list of at
most ``RESIDUAL`` arcs is left that one task walks. Subtree leaves and savings are differences of
prefix sums between the places of a node's two arcs. A node's name is (smallest member, depth).

Each round is one equi-join whose keys are unique, on a list a third shorter than before, so no
conversation, parent or depth is a hot key and the depth of the trie costs nothing. Turns are
ranked and hashed by ``scans.running``, which splits a conversation of any length. The one
sequential step is a digest over the ids that end at a node: SHA-256 is defined from front to
back; sorted ids arrive as few joined chunks and are hashed one by one, in constant memory.

Null roles and texts are empty; null turns come first; turns that tie are ordered by role and
digest, so repeated rows are repeated turns. Rows with a null conversation id take no part. A
conversation without turns after the rebuilding belongs to the root. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import drop_kept, keep
from wardlake.llm.scans import running

RESIDUAL = 1 << 15  # arcs that one task walks
CHUNK = 1 << 20  # characters of joined ids in a row
NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string")


def ranked_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, rank, l0, l1, n): each turn's place, 2 x 60 bits of its digest, its length."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        *[F.conv(F.substring(sha, at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "l0"), (16, "l1"))],
        F.char_length(text).cast("long").alias("n"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "l0", "l1", "n"]
    return running(rows, order, ["conv_id"], [], "turns").select("conv_id", "rank", "l0", "l1", "n")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, h, src), one per conversation, and the turns (conv_id, part, place, l0, l1, n) of
    the rebuilt ones: the first h turns of the conversation src, then the own ones after the first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    convs = turns.where("rank = 1").select("conv_id", h.alias("h"), F.expr("conv_id - conv_id % 100").alias("src"))
    lent = turns.where("rank <= 5 and conv_id % 100 = 0").withColumnRenamed("conv_id", "src")
    # a conversation lends five turns at most, to a hundred others at most
    first = convs.where("h > 0").join(lent, "src").where("rank <= h").select("conv_id", F.lit(0).alias("part"), "rank", "l0", "l1", "n")
    own = turns.where(F.col("rank") > h).select("conv_id", F.lit(1).alias("part"), "rank", "l0", "l1", "n")
    return convs, first.unionByName(own).withColumnRenamed("rank", "place")


def list_rank(arcs: DataFrame, residual: int = RESIDUAL) -> DataFrame:
    """Rows (id, dist) for a linked list (id, nxt; the last nxt is null): the steps to its end."""
    spark = arcs.sparkSession
    cur = arcs.select("id", "nxt", F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long").alias("w"))
    rounds, n = [], arcs.count()
    while n > residual:
        falls = F.coalesce(F.xxhash64("id", F.lit(len(rounds))) > F.xxhash64("nxt", F.lit(len(rounds))), F.lit(False)) & F.col("nxt").isNotNull()
        p = cur.where(falls).select(F.col("id").alias("p"), F.col("nxt").alias("key"), F.col("w").alias("pw"))
        v = cur.where(~falls).select(F.col("id").alias("key"), F.col("nxt").alias("vn"), F.col("w").alias("vw"))

        def row(a: str, nxt: str, w: str, gone: str = "false") -> str:
            return f"struct({a} as id, {nxt} as nxt, {w} as w, {gone} as gone)"

        spliced = F.expr(f"""explode(case
            when p is not null and vn is not null then array({row('p', 'vn', 'pw + vw')}, {row('key', 'vn', 'vw', 'true')})
            when p is not null and vw is not null then array({row('p', 'key', 'pw')}, {row('key', 'vn', 'vw')})
            when p is not null then array({row('p', 'key', 'pw')}) else array({row('key', 'vn', 'vw')}) end)""")
        table = keep(p.join(v, "key", "full").select(spliced.alias("r")).select("r.*"), "ranking")
        rounds.append(table)
        cur = table.where("not gone").select("id", "nxt", "w")
        n = cur.count()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        if rows:
            before = {nxt: (a, w) for a, nxt, w in rows}
            ids, dists, at, dist = [], [], None, 0
            while at in before:  # from the end back
                at, w = before[at]
                dist += w
                ids.append(at)
                dists.append(dist)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dists, pa.int64())], ["id", "dist"])

    ranked = keep(cur.repartition(1).mapInArrow(walk, "id bigint, dist bigint"), "ranked")
    for table in reversed(rounds):
        back = table.where("gone").select(F.col("id").alias("v"), F.col("nxt").alias("id"), "w").join(ranked, "id")
        more = keep(ranked.unionByName(back.selectExpr("v id", "dist + w dist")), "ranked")
        drop_kept(spark, ranked, table)
        ranked = more
    return ranked


def joined_digests(ids: DataFrame) -> DataFrame:
    """Rows (k0, k1, sha) from (k0, k1, conv_id): the digest of a key's ids in ascending order, as
    decimals joined by commas. The ids are sorted and joined into chunks by all tasks."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                               pa.array([first], pa.int64()), pa.array([",".join(held)])], ["k0", "k1", "first", "chunk"])

        for batch in batches:
            made = []
            for k0, k1, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (k0, k1) or size >= CHUNK:
                    if held:
                        made.append(out())
                    key, first, held, size = (k0, k1), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["k0", "k1", "sha"])

        for batch in batches:
            rows = []
            for k0, k1, chunk in zip(*(batch.column(i) for i in (0, 1, 3))):
                mine = (k0.as_py(), k1.as_py())
                if mine == key:
                    sha.update(b"," + chunk.as_buffer())
                else:
                    if key:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = mine, hashlib.sha256(chunk.as_buffer())
            if rows:
                yield out(rows)
        if key:
            yield out([(*key, sha.hexdigest())])

    rows = keep(ids, "ends")
    parts = (rows.select("k0", "k1", "conv_id").repartitionByRange("k0", "k1", "conv_id").sortWithinPartitions("k0", "k1", "conv_id")
             .mapInArrow(chunks, "k0 bigint, k1 bigint, first bigint, chunk string"))
    return (parts.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first")
            .mapInArrow(digest, "k0 bigint, k1 bigint, sha string"))


def trie(turns: DataFrame, convs: DataFrame, residual: int = RESIDUAL) -> DataFrame:
    """The nodes over the turns (conv_id, part, place, l0, l1, n) of the conversations ``convs``."""
    spark = turns.sparkSession
    n_convs, smallest = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not n_convs:
        return spark.createDataFrame([], NODE)
    path = running(turns, ["conv_id", "part", "place"], ["conv_id"], ["l0", "l1"], "path", rolling=True).selectExpr(
        "conv_id", "rank depth", "run_l0 k0", "run_l1 k1", "before_l0 p0", "before_l1 p1", "n")
    nodes = path.groupBy("depth", "k0", "k1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                                  F.min("n").alias("n"), F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    # siblings lie side by side in this order, so the next one is the next number; 0 is the root
    nodes = keep(running(nodes, ["p0", "p1", "conv_id"], [], [], "numbers").withColumn("nid", F.col("row") + 1).drop("row", "rank"), "nodes")
    kids = nodes.groupBy("p0", "p1").agg(F.min("nid").alias("first"), F.count("*").alias("n_children"))
    top = kids.where("p0 = 0 and p1 = 0").first()
    nodes = nodes.join(kids.withColumnsRenamed({"p0": "k0", "p1": "k1"}), ["k0", "k1"], "left").fillna(0, ["n_children"])
    above = nodes.where("n_children > 0").selectExpr("k0 p0", "k1 p1", "nid parent", "conv_id parent_conv_id", "first + n_children - 1 last")
    # the root, whose children may be a large part of all nodes, needs no join
    at_root = nodes.where("p0 = 0 and p1 = 0").selectExpr("*", "0L parent", f"{smallest}L parent_conv_id", f"{top.first + top.n_children - 1 if top else 0}L last")
    deeper = nodes.where("not (p0 = 0 and p1 = 0)").join(above, ["p0", "p1"])
    root = spark.range(1).selectExpr("0L nid", "0L k0", "0L k1", "0L depth", f"{smallest}L conv_id", "cast(null as bigint) parent",
                                     "cast(null as bigint) parent_conv_id", f"{n_convs}L n_convs", "0L n",
                                     f"{top.first if top else 'cast(null as bigint)'} first", f"{top.n_children if top else 0}L n_children", "0L last")
    tree = keep(at_root.unionByName(deeper).drop("p0", "p1").unionByName(root), "tree")

    arcs = keep(tree.selectExpr("""inline(array(
        struct(2 * nid as id, if(n_children > 0, 2 * first, 2 * nid + 1) as nxt, if(n_children > 0, 0L, 1L) as leaves, (n_convs - 1) * n as saved),
        struct(2 * nid + 1 as id, case when nid = 0 then null when nid = last then 2 * parent + 1 else 2 * nid + 2 end as nxt, 0L as leaves, 0L as saved)))"""), "arcs")
    tour = arcs.select("id", "leaves", "saved").join(list_rank(arcs, residual), "id").withColumn("place", -F.col("dist"))
    sums = running(tour.drop("dist"), ["place"], [], ["leaves", "saved"], "tour")
    # up to and with the exit, less what lies before the enter
    per = [F.sum(F.expr(f"if(id % 2 = 1, run_{c}, {c} - run_{c})")).alias(c) for c in ("leaves", "saved")]
    totals = sums.groupBy(F.expr("id div 2").alias("nid")).agg(*per)

    last = path.groupBy("conv_id").agg(F.max(F.struct("depth", "k0", "k1")).alias("e")).select("conv_id", "e.k0", "e.k1")
    ends = joined_digests(convs.select("conv_id").join(last, "conv_id", "left").fillna(0, ["k0", "k1"]))
    return tree.join(totals, "nid").join(ends, ["k0", "k1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", residual: int = RESIDUAL) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node; see the module."""
    convs, turns = rebuild(ranked_turns(conversations, conv_col, turn_col, role_col, text_col))
    return trie(turns, convs, residual)

"""Near-duplicate documents by an exact Jaccard join on word shingles: a grouped prefix join.

1. Copies of a text become one class. Classes are dealt out to blocks of text by a hash.
2. Every block sends short fingerprints of its shingles to counting tasks, which send back the
   fingerprints that occur in two or more classes, with their counts.
3. Every class orders its shingles by (count, hash), rarest first, and takes the prefix that any
   partner at the threshold must share a shingle with. Prefix shingles that occur in one class
   only can't match and are left out; most classes end here.
4. Classes with the same size and prefix form one group. Groups that share a prefix shingle are
   candidates if their sizes and the positions of the shingle allow the threshold.
   A signature of 512 bits, the parity of the shingles by hash, bounds the common shingles from
   above (two sets differ in at least as many shingles as their signatures in bits) and drops
   most of the rest.
5. Verification counts common shingles. Each group's members are compared with the group's head,
   and the groups of a prefix shingle with two of them (a star, not all pairs); what then is one
   component needs no more comparing. Where a shingle still has several components, what isn't in
   its main one is compared with a few members of that and of the others; and at last, what isn't in a shingle's main component is
   compared with every candidate of another component, so no link between components is missed.

Shingles are 64-bit hashes; within a pair of texts two different shingles meet by chance less
than once in 10^11 pairs.

Null and empty texts have no shingle and link with nothing. Rows with a null id take the
component of their text's class. Rows that repeat are all returned; rows that share an id but not
a text are told apart by their text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wardlake.llm.common import HASH, block_count, blocked, components, drop_kept, from_blobs, keep, word_hashes

WORDS = 4
PERCENT = 85
SIGNATURE = 8  # longs
KEY = "__row_key"
WIDE = 32  # longs of the signature that only members of shingles with several components carry

_C = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(29)


def distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.concatenate([[True], ascending[1:] != ascending[:-1]])] if len(ascending) else ascending


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct ``k``-word shingles as ascending 64-bit hashes; a shorter text is one shingle."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    span = min(k, n)
    acc = h[:n - span + 1] + np.uint64(span)
    for j in range(1, span):
        acc = (acc ^ (acc >> _S)) * _C + h[j:n - span + 1 + j]
    acc = (acc ^ (acc >> _S)) * _C
    return distinct(np.sort(acc ^ (acc >> np.uint64(32))))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _block(blobs: pa.ChunkedArray, k: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Digests, numbers of shingles and the shingles one after another, each class once."""
    digs, sets = [], []
    seen: set[bytes] = set()
    for t in from_blobs(blobs):
        for dig, text in zip(t.column("dig").to_pylist(), t.column("text").to_pylist()):
            if dig not in seen:
                seen.add(dig)
                digs.append(dig)
                sets.append(shingles(text, k))
    order = sorted(range(len(digs)), key=digs.__getitem__)
    sets = [sets[i] for i in order]
    return ([digs[i] for i in order], np.array([len(s) for s in sets], np.int64),
            np.concatenate(sets) if sets else np.zeros(0, np.uint64))


def _send(k: int, bits: int):
    """A block's fingerprints, by counting bucket (the hash's first bits)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, _, h = _block(t.column("blob"), k)
        f = np.sort(h >> np.uint64(32 - bits))
        cuts = np.searchsorted(f >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        low = f.astype(np.uint32)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({"bucket": pa.array(full, pa.int64()), "blk": pa.array([key[0].as_py()] * len(full), pa.int64()),
                         "fps": pa.array([low[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary())})

    return run


def _count(key: tuple, t: pa.Table) -> pa.Table:
    """Counts of a bucket's fingerprints; to every block those of its own that occur twice or more."""
    own = [np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("fps")]
    whole = np.sort(np.concatenate(own))
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    counts = np.diff(first, append=len(whole))
    often, times = whole[first[counts > 1]], counts[counts > 1].astype(np.uint32)
    blks, fps, dfs = [], [], []
    for blk, f in zip(t.column("blk").to_pylist(), own):
        f = distinct(f)
        at = np.searchsorted(often, f)
        hit = at < len(often)
        hit[hit] = often[at[hit]] == f[hit]
        if hit.any():
            blks.append(blk)
            fps.append(f[hit].tobytes())
            dfs.append(times[at[hit]].tobytes())
    return pa.table({"blk": pa.array(blks, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blks), pa.int64()),
                     "fps": pa.array(fps, pa.binary()), "dfs": pa.array(dfs, pa.binary())})


CLASS = "dig binary, n bigint, gid binary, toks array<bigint>, pos array<int>, shared array<bigint>, sig array<bigint>, wide array<bigint>"


def _prefixes(k: int, bits: int, percent: int):
    """Every class of a block with its size and, if its prefix holds a shingle that another class
    may have, its group, those prefix shingles with positions, and all its shingles of that kind."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        digs, n, h = _block(left.column("blob"), k)
        df = np.ones(len(h), np.int64)
        if right.num_rows and len(h):
            fps = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(f.as_buffer(), np.uint32).astype(np.uint64)
                                  for b, f in zip(right.column("bucket").to_pylist(), right.column("fps"))])
            dfs = np.concatenate([np.frombuffer(d.as_buffer(), np.uint32) for d in right.column("dfs")])
            order = np.argsort(fps)
            fps, dfs = fps[order], dfs[order]
            f = h >> np.uint64(32 - bits)
            at = np.minimum(np.searchsorted(fps, f), len(fps) - 1)
            df = np.where(fps[at] == f, dfs[at], 1).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort((doc << 32) | df, kind="stable")  # a class has its hashes in ascending order
        h, df = h[order], df[order]
        starts = np.concatenate([[0], np.cumsum(n)])
        plen = prefix_length(n, percent)
        gid, toks, pos, shared, sig, wide = [], [], [], [], [], []
        for i in range(len(n)):
            a = starts[i]
            p = h[a:a + plen[i]] if n[i] else h[:0]
            hit = np.flatnonzero(df[a:a + len(p)] > 1)
            if len(hit):
                own = h[a:starts[i + 1]]
                gid.append(xxhash.xxh3_128_digest(np.int64(n[i]).tobytes() + p.tobytes()))
                toks.append(p[hit].view(np.int64))
                pos.append(hit.astype(np.int32))
                shared.append(own[df[a:starts[i + 1]] > 1].view(np.int64))
                odd = np.bincount((own & np.uint64(WIDE * 64 - 1)).astype(np.int64), minlength=WIDE * 64) & 1
                wide.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                folded = np.bitwise_xor.reduce(odd.reshape(-1, SIGNATURE * 64), axis=0)  # the parity of fewer, larger buckets
                sig.append(np.packbits(folded.astype(np.uint8)).view(np.int64))
            else:
                for column in (gid, toks, pos, shared, sig, wide):
                    column.append(None)
        return pa.table({"dig": pa.array(digs, pa.binary()), "n": pa.array(n), "gid": pa.array(gid, pa.binary()),
                         "toks": pa.array(toks, pa.list_(pa.int64())), "pos": pa.array(pos, pa.list_(pa.int32())),
                         "shared": pa.array(shared, pa.list_(pa.int64())), "sig": pa.array(sig, pa.list_(pa.int64())),
                         "wide": pa.array(wide, pa.list_(pa.int64()))})

    return run


def _postings(sets: DataFrame) -> DataFrame:
    """A row for each prefix shingle another class may have: (nid, n, s, sig, tok, p), s being how
    many of the n shingles another class may have, p the shingle's place in the order."""
    return sets.select("nid", "n", F.size("shared").alias("s"), "sig", F.explode(F.arrays_zip("toks", "pos")).alias("x")).select(
        "nid", "n", "s", "sig", F.col("x.toks").alias("tok"), F.col("x.pos").alias("p"))


def _marked(stats: DataFrame) -> DataFrame:
    """The chosen members ``m`` of each shingle, as the second side of a star."""
    stats = stats.select("tok", F.explode("m").alias("m")).where("m is not null")
    return stats.select("tok", *[F.col(f"m.{c}").alias(f"{c}2") for c in ("nid", "n", "s", "p", "sig")])


def _apart(a: str, b: str, longs: int) -> Column:
    """In how many bits two signatures differ; the sets differ in as many shingles at least."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(longs)), F.lit(0))


def _possible(percent: int, longs: int = SIGNATURE) -> Column:
    """The sizes n, n2, the numbers s, s2 of shingles that can be common at all, and the places of a
    common shingle allow the threshold: before it at most the smaller q can be common."""
    need = F.col("n") + F.col("n2")
    most = F.least("s", "s2", F.col("n") - F.col("p"), F.col("n2") - F.col("p2"))
    apart = _apart("sig", "sig2", longs)
    return ((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (most * (100 + percent) >= need * percent)
            & ((need - apart) * (100 + percent) >= need * (2 * percent)))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) at the threshold, by the exact number of common shingles."""
    one = pairs.join(sets.selectExpr("nid a", "n", "shared"), "a")
    both = one.join(sets.selectExpr("nid b", "n n2", "shared shared2"), "b")
    common = F.size(F.array_intersect("shared", "shared2"))
    return both.where(common * (100 + percent) >= (F.col("n") + F.col("n2")) * percent).select("a", "b")


def linked(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes with links: exactly what the threshold connects."""
    spark = classes.sparkSession
    some = classes.where("gid is not null")
    sets = some.select("nid", "n", "shared")
    mark = F.struct("nid", "n", "s", "p", "sig")
    pair = ("least(nid, nid2) a", "greatest(nid, nid2) b")

    groups = (some.groupBy("gid").agg(F.min(F.struct("nid", "n", "toks", "pos", "shared", "sig")).alias("g"))
              .select("gid", "g.*"))
    post = _postings(groups)
    ends = post.groupBy("tok").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo.nid <> hi.nid")
    stars = (post.join(_marked(ends.select("tok", F.array("lo", "hi").alias("m"))), "tok").where("nid <> nid2")
             .where(_possible(percent)).selectExpr(*pair).distinct())
    inside = (some.select("gid", F.col("nid").alias("b")).join(groups.select("gid", F.col("nid").alias("a")), "gid")
              .where("a <> b").select("a", "b"))
    label = components(_verify(stars.unionByName(inside), sets, percent), "near1")

    def still_open(label: DataFrame, name: str) -> DataFrame:
        """Postings of the shingles with several components, with the wide signature: ``c`` the
        component, ``main`` the shingle's most frequent one."""
        label = label.withColumnRenamed("node", "nid")
        post = _postings(some).drop("sig").join(label, "nid", "left").withColumn("c", F.coalesce("component", "nid")).drop("component")
        main = (post.groupBy("tok", "c").agg(F.count("*").alias("k")).groupBy("tok")
                .agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("cs")).where("cs > 1")
                .select("tok", F.col("m.c").alias("main")))
        return keep(post.join(main, "tok").join(some.selectExpr("nid", "wide sig"), "nid"), name)

    # a few members of the main component and a few outside it, others for each shingle: what is not
    # in the main component meets both, the main component those outside it
    open_ = still_open(label, "open1")
    member = F.struct(F.xxhash64("nid", "tok").alias("h"), mark.alias("m"))

    def picked(rows: DataFrame) -> DataFrame:
        few = rows.groupBy("tok").agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
        return _marked(few.select("tok", F.array_distinct(F.array("lo.m", "hi.m")).alias("m")))

    met = open_.join(picked(open_.where("c <> main")), "tok").unionByName(
        open_.where("c <> main").join(picked(open_.where("c = main")), "tok"))
    more = met.where("nid <> nid2").where(_possible(percent, WIDE)).selectExpr(*pair).distinct()
    label = components(label.selectExpr("node a", "component b").unionByName(_verify(more, sets, percent)), "near2")
    drop_kept(spark, open_)

    open_ = still_open(label, "open2")
    rest = open_.where("c <> main").drop("main")
    other = open_.selectExpr("tok", "nid nid2", "n n2", "s s2", "p p2", "sig sig2", "c c2", "main")
    cross = (rest.join(other, "tok").where("c <> c2 and (c2 = main or nid < nid2)").where(_possible(percent, WIDE))
             .selectExpr(*pair).distinct())
    cross = keep(_verify(cross, sets, percent), "cross")
    drop_kept(spark, open_)
    if not cross.limit(1).count():
        return label
    return components(label.selectExpr("node a", "component b").unionByName(cross), "near3")


def _by_text(base: DataFrame, percent: int, k: int) -> DataFrame:
    """(dig, n, c) for every distinct text of ``base`` (dig, text): its shingles and its component's number."""
    n_blocks = block_count(base, "text")
    bits = max(1, (n_blocks - 1).bit_length())
    texts_ = blocked(base.select(F.xxhash64("dig").alias(HASH), "dig", "text"), n_blocks, once="dig")
    counted = (texts_.groupBy("blk").applyInArrow(_send(k, bits), "bucket bigint, blk bigint, fps binary")
               .groupBy("bucket").applyInArrow(_count, "blk bigint, bucket bigint, fps binary, dfs binary"))
    found = texts_.groupBy("blk").cogroup(counted.groupBy("blk")).applyInArrow(_prefixes(k, bits, percent), CLASS)
    classes = keep(found.withColumn("nid", F.monotonically_increasing_id()), "classes")
    label = linked(classes, percent).withColumnRenamed("node", "nid")
    return classes.select("dig", "nid", "n").join(label, "nid", "left").select("dig", "n", F.coalesce("component", "nid").alias("c"))


def clusters(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, text_col: str = "text") -> DataFrame:
    """(dig, cluster): the MD5 of every distinct text of ``docs`` that has words, and a number that
    the texts of its component share."""
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("dig", F.unhex(F.md5("text")))
    return _by_text(base, percent, k).where("n > 0").select("dig", F.col("c").alias("cluster"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``: documents are linked when
    100 * common shingles >= percent * all shingles of the two; component_id is the smallest id
    reachable by links, the document's own included. See the module for nulls and repeats."""
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("dig", F.unhex(F.md5("text")))
    ids = base.select("id", "dig").groupBy("dig").agg(F.min("id").alias("rep"))
    known = _by_text(base, percent, k).join(ids, "dig")
    small = known.where("n > 0").groupBy("c").agg(F.min("rep").alias("m"))
    known = known.join(small, "c", "left").select("dig", "n", "m")
    return (base.select("id", "dig").join(known, "dig")
            .select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("m")).otherwise(F.col("id")).alias("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of linked documents keeps the one with
    the smallest id, among rows of that id the one whose text has the smallest MD5. Documents without
    words stay. Of rows that repeat both id and text one stays; unlike texts under one id are
    different documents; rows with a null id all stay."""
    base = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("dig", F.unhex(F.md5("text")))
    rows = base.select("id", "dig").distinct().join(_by_text(base, percent, k), "dig")
    first = rows.where("n > 0").groupBy("c").agg(F.min(F.struct("id", "dig")).alias("f")).select("f.id", "f.dig")
    kept = first.unionByName(rows.where("n = 0").select("id", "dig"))

    def row_key(i: Column, dig: Column) -> Column:
        return F.concat(dig, F.encode(i.cast("string"), "utf-8"))

    n_blocks = block_count(docs, text_col)
    named = docs.where(F.col(id_col).isNotNull())
    named = named.withColumn(KEY, row_key(F.col(id_col).cast("bigint"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))))
    named = named.withColumn(HASH, F.xxhash64(KEY))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        stay = set(right.column("k").to_pylist())
        parts = []
        for t in from_blobs(left.column("blob")):
            mask = []
            for i in t.column(KEY).to_pylist():
                mask.append(i in stay)
                stay.discard(i)
            parts.append(t.drop_columns([KEY]).filter(pa.array(mask, pa.bool_())))
        return pa.concat_tables(parts) if parts else empty

    schema = docs.schema
    empty = pa.Table.from_batches([], to_arrow_schema(schema))
    kept = kept.select(row_key(F.col("id"), F.col("dig")).alias("k"))
    one = (blocked(named, n_blocks, once=KEY).groupBy("blk")
           .cogroup(kept.withColumn("blk", F.pmod(F.xxhash64("k"), F.lit(n_blocks))).groupBy("blk")).applyInArrow(run, schema))
    return one.unionByName(docs.where(F.col(id_col).isNull()))

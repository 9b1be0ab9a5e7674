"""Conflict-constrained best-fit packing of documents into sequences of a fixed length.

Documents longer than a bin are cut into full bins and a rest; the rests and the shorter
documents are packed by best fit in decreasing length. Open bins stand ordered by their free
room and carry a bitmap of the sources and one of the duplicate clusters they hold; the search
starts at the tightest bin that has room and goes on to the next larger one until it meets a
bin without a conflict. Two rows conflict when they share a duplicate cluster (one the caller
gives by text, as ``ngram_join.clusters`` finds them; else texts with the same lower-cased words),
or when a bin already holds ``max_per_source`` rows of the source.

Rows are dealt over shards by a hash of the row, at most about ``shard_rows`` to a shard, and
shards are packed on their own, so no source, cluster or copied row makes a hot task. Only
(id, length, source, cluster) moves; texts don't.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import ascii_lower_words, keep, texts, word_count

CAPACITY = 2048
SHARD_ROWS = 8192
MAX_PER_SOURCE = 2

SCHEMA = "id long, row long, piece int, offset long, n_words long, shard long, bin long, bin_offset long"


class Bins:
    """Open bins, ordered by free room. Sources and clusters are small numbers, -1 for none."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.max_per_source = capacity, max_per_source
        self.rooms: list[int] = []  # free rooms that occur, ascending
        self.at: dict[int, list[int]] = {}  # free room -> its bins, oldest first
        self.full: dict[int, int] = {}  # free room -> bitmap of the sources that no bin there takes
        self.sources: list[list[int]] = []  # bin -> bitmaps of the sources with 1, 2, ... rows in it
        self.clusters: list[int] = []  # bin -> bitmap of the clusters in it
        self.free: list[int] = []

    def closed(self) -> int:
        """A bin that takes nothing more."""
        self.sources.append([])
        self.clusters.append(0)
        self.free.append(0)
        return len(self.free) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) of the tightest bin with room and no conflict, else of a new one."""
        src = 1 << source if source >= 0 else 0
        clu = 1 << cluster if cluster >= 0 else 0
        for r in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[r]
            if self.full[room] & src:
                continue
            bins = self.at[room]
            for k, b in enumerate(bins):
                if not self.sources[b][-1] & src and not self.clusters[b] & clu:
                    bins.pop(k)
                    if bins:
                        self._note(room)
                    else:
                        del self.at[room], self.full[room]
                        self.rooms.pop(r)
                    return self._put(b, size, src, clu)
        self.sources.append([0] * self.max_per_source)
        self.clusters.append(0)
        self.free.append(self.capacity)
        return self._put(len(self.free) - 1, size, src, clu)

    def _put(self, b: int, size: int, src: int, clu: int) -> tuple[int, int]:
        offset = self.capacity - self.free[b]
        levels = self.sources[b]
        for i, m in enumerate(levels):
            if not m & src:
                levels[i] |= src
                break
        self.clusters[b] |= clu
        room = self.free[b] = self.free[b] - size
        if room > 0:
            if room not in self.at:
                insort(self.rooms, room)
                self.at[room] = []
            insort(self.at[room], b)
            self._note(room)
        return b, offset

    def _note(self, room: int) -> None:
        full = -1
        for b in self.at[room]:
            full &= self.sources[b][-1]
        self.full[room] = full


def pack_shard(rows: pd.DataFrame, capacity: int, max_per_source: int) -> pd.DataFrame:
    """One shard (row, id, n_words, source, cluster), longest rest first, ties by row."""
    rows = rows.sort_values("row", kind="stable")
    source = pd.factorize(rows["source"])[0]  # null: -1, no conflict
    cluster, seen = pd.factorize(rows["cluster"])
    cluster = np.where(np.bincount(cluster[cluster >= 0], minlength=max(len(seen), 1))[cluster] > 1, cluster, -1)
    sizes, ids, row_ids = rows["n_words"].tolist(), rows["id"].tolist(), rows["row"].tolist()
    bins, out = Bins(capacity, max_per_source), []
    for i, n in enumerate(sizes):
        whole = n // capacity
        for piece in range(whole):
            out.append((i, piece, piece * capacity, capacity, bins.closed(), 0))
        if n == 0:
            out.append((i, 0, 0, 0, None, None))
    for i in sorted(range(len(sizes)), key=lambda i: (-(sizes[i] % capacity), row_ids[i])):
        rest, whole = sizes[i] % capacity, sizes[i] // capacity
        if rest:
            out.append((i, whole, whole * capacity, rest, *bins.place(rest, int(source[i]), int(cluster[i]))))
    at = [o[0] for o in out]
    return pd.DataFrame({
        "id": pd.array([ids[i] if ids[i] == ids[i] else None for i in at], "Int64"), "row": [row_ids[i] for i in at],
        "piece": [o[1] for o in out], "offset": [o[2] for o in out], "n_words": [o[3] for o in out],
        "shard": rows["shard"].iloc[0], "bin": pd.array([o[4] for o in out], "Int64"),
        "bin_offset": pd.array([o[5] for o in out], "Int64")})


def lengths(docs: DataFrame, id_col: str, text_col: str, source_col: str, by_text: bool = False) -> DataFrame:
    """(id, source, n_words, cluster): the cluster is a hash of the lower-cased word sequence, or
    ``by_text`` the MD5 of the text; texts without words have none."""

    def of_text(text: str | None) -> tuple[int, bytes | None]:
        n = word_count(text)
        return n, hashlib.md5(text.encode()).digest() if n else None

    def of_words(text: str | None) -> tuple[int, bytes | None]:
        words = ascii_lower_words(text)
        return len(words), xxhash.xxh3_128_digest(b" ".join(words)) if words else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, values in texts(batch.column(2)):
                found = [of_text(t) if by_text else of_words(t) for t in values]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(1).slice(start, n),
                     pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                    ["id", "source", "n_words", "cluster"])

    return (docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{source_col}` as string) source", f"`{text_col}` text")
            .mapInArrow(run, "id bigint, source string, n_words bigint, cluster binary"))


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard_rows: int = SHARD_ROWS,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None) -> DataFrame:
    """Rows (id, row, piece, offset, n_words, shard, bin, bin_offset): every word of every row of
    ``docs`` lies in exactly one piece, every piece in one bin (shard, bin) at ``bin_offset``.

    ``row`` numbers the rows, so repeated rows and null ids are packed each. A text without words
    (null, empty) gets one piece of 0 words in no bin. A null source never conflicts. An empty
    table gives no rows. Other columns are not read.

    ``clusters`` (dig, cluster): the duplicate cluster of a text by its MD5, each text once; a text
    that isn't in it conflicts with nothing. Without it exact copies are the clusters."""
    rows = keep(lengths(docs, id_col, text_col, source_col, clusters is not None).withColumn("row", F.monotonically_increasing_id()), "pack")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    if clusters is not None:
        rows = rows.withColumnRenamed("cluster", "dig").join(clusters.select("dig", F.col("cluster").cast("string")), "dig", "left").drop("dig")
    return (rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
            .groupBy("shard").applyInPandas(lambda g: pack_shard(g, capacity, max_per_source), SCHEMA))

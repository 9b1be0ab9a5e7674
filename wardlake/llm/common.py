"""Helpers shared by the operators of this subpackage.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir`` (see ``wardlake.session.checkpoint_dir``), as Parquet,
so a lost executor never loses a finished step and lineage is cut there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import checkpoint_dir

# Distinct words or pre-tokens one worker remembers before it starts afresh;
# this bounds memory and never changes a result.
MEMO_ENTRIES = 600_000


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; a cluster gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{path}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables written by ``keep`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5 (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


class WordHash(dict):
    """Word (bytes) -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(memo: WordHash, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


# A word's hash is the sum of its bytes' numbers times powers of an odd number, so that a whole text
# is hashed by one running sum; A-Z have the numbers of a-z. ``PIECE`` bytes are worked on at a time.
PIECE = 1 << 15
_M = 0x94D049BB133111EB
_POWER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, _M, np.uint64))])
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, pow(_M, -1, 1 << 64), np.uint64))])
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
_IN_WORD = bytes(not bytes([b]).isspace() for b in range(256))


def _edges(data: bytes) -> np.ndarray:
    """Where words start and end, in turn."""
    inside = np.frombuffer(b"\0" + data.translate(_IN_WORD) + b"\0", np.bool_)
    return np.flatnonzero(inside[1:] != inside[:-1])


def word_count(text: str | None) -> int:
    """How many words ``ascii_lower_words`` finds."""
    inside = np.frombuffer(b"\0" + (text or "").encode("utf-8", "surrogatepass").translate(_IN_WORD), np.bool_)
    return int(np.count_nonzero(inside[1:] > inside[:-1]))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word that ``ascii_lower_words`` finds, in order, without the words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found, begun, length = [], 0, 0  # sum and length of the word that the last piece left open
    for at in range(0, len(data), PIECE):
        b = data[at:at + PIECE]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE.take(np.frombuffer(b, np.uint8)) * _POWER[:len(b)], out=sums[1:])
        edges = _edges(b)
        starts, ends = edges[::2], edges[1::2]
        h = (sums[ends] - sums[starts]) * _INVERSE[starts]
        grown = length if len(h) and starts[0] == 0 else 0  # bytes of the open word that the first word goes on with
        if grown:
            h[0] = (begun + int(h[0]) * pow(_M, grown, 1 << 64)) % (1 << 64)
        elif length:
            found.append(np.array([begun], np.uint64))
        length = 0
        if len(h) and ends[-1] == len(b):
            begun, length = int(h[-1]), int(ends[-1] - starts[-1]) + (grown if len(h) == 1 else 0)
            h = h[:-1]
        found.append(h)
    if length:
        found.append(np.array([begun], np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, then the words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def texts(column: pa.ChunkedArray | pa.Array, rows: int = 512) -> Iterator[tuple[int, list]]:
    """The values of a text column in slices, so that few texts are Python objects at once."""
    for start in range(0, len(column), rows):
        yield start, column.slice(start, rows).to_pylist()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component), the
    smallest node id of each component, for every node of an edge.

    Alternates the large-star and small-star steps until the edges are stars. Each step
    is a grouped minimum, combined before the shuffle, and a join on the node whose skewed
    partitions AQE splits, so a node with very many links is no hot task. Empty in, empty out.
    """
    spark = edges.sparkSession
    e = keep(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), f"{name}-e")
    while True:
        # large star: neighbours above u hang on the smallest neighbour of u
        both = e.unionByName(e.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(low, "u").where("v > u").selectExpr("v u", "m v").distinct()
        large = keep(large, f"{name}-l")
        # small star: u and its neighbours below hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v"))
        nxt = keep(small.where("u <> v").distinct(), f"{name}-s")
        drop_kept(spark, e, large)
        e = nxt
        # stars throughout: no node hangs on two, and none on which others hang
        ends = e.selectExpr("u x", "1L up", "0L down").unionByName(e.selectExpr("v x", "0L up", "1L down"))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up = 1 and down = 1").limit(1).count():
            break
    return e.selectExpr("u node", "v component").unionByName(
        e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))


# --- blocks of whole texts -------------------------------------------------------------------

BLOCK_BYTES = 4 << 20  # text in a block, about; one task works on one block at a time
HASH = "__row_hash"
FLUSH_BYTES = 32 << 20  # text a map task gathers before it deals it out to blocks


def block_count(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def blocked(df: DataFrame, n_blocks: int, once: str | None = None) -> DataFrame:
    """Deal the rows of ``df`` out to blocks by its long column ``HASH`` (a hash of the row): rows
    (blk, blob), a blob being compressed Arrow data of several rows. Texts so cross the shuffle
    compressed and in a few large rows. ``once``: a key column of which each task passes on only
    the first row, so a text copied very often reaches its block once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            blk = np.mod(whole.column(HASH).to_numpy(), n_blocks)
            order = np.argsort(blk, kind="stable")
            cuts = np.flatnonzero(np.diff(blk[order])) + 1
            data = whole.drop_columns([HASH])
            for part in np.split(order, cuts):
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(blk[part[0]])], pa.int64()), pa.array([to_blob(data.take(part))], pa.binary())],
                        ["blk", "blob"])

        for batch in batches:
            if once:
                fresh = []
                for key in batch.column(batch.schema.get_field_index(once)).to_pylist():
                    fresh.append(key not in seen)
                    seen.add(key)
                batch = batch.filter(pa.array(fresh, pa.bool_()))
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return df.mapInArrow(run, "blk bigint, blob binary")


def to_blob(data: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(data)
    return sink.getvalue().to_pybytes()


def from_blobs(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for blob in blobs:
        yield pa.ipc.open_stream(blob.as_buffer()).read_all()

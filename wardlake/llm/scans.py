"""Running sums over a table sorted across all tasks, for groups of any size.

The rows are range-partitioned by the whole sort key, so a group that holds a third of all rows
lies in many partitions. Each task sums its own rows and writes them as a table; the first and
last row of each partition (two rows a partition, however many rows there are) tell the driver
what every partition takes over from those before it, and a second pass adds that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import keep

# Odd multipliers of the rolling hash, a lane each (fixed values, any odd numbers do).
LANES = np.array([0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F], np.uint64)


def _segments(group: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Places where another group begins; ``last``: the group of the row before the first."""
    n = len(group[0]) if group else 0
    new = np.zeros(n, bool)
    for g in group:
        new[1:] |= g[1:] != g[:-1]
    new[0] = last is None or tuple(g[0] for g in group) != last
    return new


class Running:
    """Ranks and running sums within groups over the batches of one sorted partition."""

    def __init__(self, sums: int):
        self.last, self.rank, self.carry = None, 0, [np.uint64(0)] * sums

    def step(self, group: list[np.ndarray], n: int, values: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ranks (from 1) and inclusive sums modulo 2**64 of the next ``n`` rows; ``values`` gives
        the summands from the ranks."""
        new = _segments(group, self.last) if group else np.zeros(n, bool)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        rank = np.where(begin < 0, self.rank + np.arange(n) + 1, np.arange(n) - begin + 1)
        out = []
        for i, v in enumerate(values(rank)):
            c = np.cumsum(v.astype(np.uint64), dtype=np.uint64)
            before = np.where(begin > 0, c[np.maximum(begin, 1) - 1], np.uint64(0))
            out.append(c - before + np.where(begin < 0, self.carry[i], np.uint64(0)))
            self.carry[i] = out[-1][-1]
        self.last, self.rank = tuple(g[-1] for g in group), int(rank[-1])
        return rank, out


def running(df: DataFrame, order: list, group: list[str], sums: list[str], name: str, rolling: bool = False) -> DataFrame:
    """``df`` with ``row`` (its number in the whole order, from 0), ``rank`` (in its group, from 1)
    and, for each of the long columns ``sums``, ``run_<column>``: the sum over its group up to and
    with the row. ``order`` begins with the ``group`` columns, which are longs without nulls; rows
    that tie in it are alike. ``rolling``: the sums are rolling hashes, sum of value * lane ** rank
    modulo 2**64, and ``before_<column>`` is the hash without the row."""
    spark = df.sparkSession
    columns = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.LongType()) for c in ("pid", "row", "rank")]
                          + [T.StructField(f"run_{c}", T.LongType()) for c in sums]
                          + [T.StructField(f"before_{c}", T.LongType()) for c in sums if rolling] + [T.StructField("edge", T.BooleanType())])
    fields = [f.name for f in schema]

    def ints(batch: pa.RecordBatch, cols: list[str]) -> list[np.ndarray]:
        return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, row, pid, held = Running(len(sums)), 0, TaskContext.get().partitionId(), None

        def terms(raw: list[np.ndarray]) -> Callable:
            if not rolling:
                return lambda rank: raw
            return lambda rank: [x.astype(np.uint64) * np.power(LANES[i], rank.astype(np.uint64)) for i, x in enumerate(raw)]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            raw = ints(batch, sums)
            rank, run = state.step(ints(batch, group), n, terms(raw))
            edge = np.zeros(n, bool)
            edge[0] = row == 0
            made = [np.full(n, pid), np.arange(row, row + n), rank, *[r.view(np.int64) for r in run]]
            if rolling:
                made += [(r - t).view(np.int64) for r, t in zip(run, terms(raw)(rank))]
            row += n
            held = pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m) for m in made], pa.array(edge)], fields)
        if held is not None:  # the last row of the partition
            edge = held.column(len(fields) - 1).to_numpy(zero_copy_only=False).copy()
            edge[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(edge)], fields)

    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = keep(part.mapInArrow(local, schema), name)
    mask = (1 << 64) - 1
    takes: dict[int, tuple] = {}
    offset, open_group, rank, run = 0, None, 0, [0] * len(sums)
    edges = {}
    for e in table.where("edge").select("pid", "row", "rank", *group, *[f"run_{c}" for c in sums]).collect():
        edges.setdefault(e.pid, []).append(e)
    for pid in sorted(edges):
        first, last = min(edges[pid], key=lambda e: e.row), max(edges[pid], key=lambda e: e.row)
        head = tuple(first[g] for g in group)
        taken = (rank, run) if offset and open_group == head else (0, [0] * len(sums))
        takes[pid] = (offset, head, *taken)
        offset += last.row + 1
        goes_on = tuple(last[g] for g in group) == head
        taken = taken if goes_on else (0, [0] * len(sums))
        own = [last[f"run_{c}"] & mask for c in sums]
        if rolling:
            own = [o * pow(int(LANES[i]), taken[0], 1 << 64) for i, o in enumerate(own)]
        open_group, rank, run = tuple(last[g] for g in group), last.rank + taken[0], [(o + t) & mask for o, t in zip(own, taken[1])]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, pids = batch.num_rows, ints(batch, ["pid"])[0]
            keys = ints(batch, group)
            row, rank = ints(batch, ["row", "rank"])
            runs = [r.view(np.uint64).copy() for r in ints(batch, [f"run_{c}" for c in sums])]
            befores = [r.view(np.uint64).copy() for r in ints(batch, [f"before_{c}" for c in sums])] if rolling else []
            row, rank = row.copy(), rank.copy()
            for pid in np.unique(pids):
                at, head, ranks, carried = takes[int(pid)]
                mine = pids == pid
                row[mine] += at
                if not ranks:
                    continue
                for key, h in zip(keys, head):
                    mine &= key == h
                rank[mine] += ranks
                for i, c in enumerate(carried):
                    for values in (runs, befores) if rolling else (runs,):
                        if rolling:
                            values[i][mine] *= np.power(LANES[i], np.uint64(ranks))
                        values[i][mine] += np.uint64(c)
            made = [row, rank, *[r.view(np.int64) for r in runs], *[b.view(np.int64) for b in befores]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], *[pa.array(m) for m in made]], out)

    out = [f for f in fields if f not in ("pid", "edge")]
    return table.mapInArrow(whole, T.StructType([f for f in schema if f.name not in ("pid", "edge")]))

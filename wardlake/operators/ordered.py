"""What came last before a row, and a row's place, per key, for keys of any size.

A window over the key would sort a hot key in one task. Here the rows are
range-partitioned by (key, order), so a hot key lies in several pieces; each
piece looks back within itself, and what a piece takes over from earlier
ones is looked up in a table that holds only the keys lying in more than one
piece: at most two keys per piece, so broadcasting it has a proven bound.
The pieces are checkpointed (reliably) before they are read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def last_before(df: DataFrame, key: str, order: Sequence[str], value: str, name: str,
                greatest: dict[str, str] | None = None) -> DataFrame:
    """Add ``name``: the last non-NULL ``value`` of the rows of the same
    ``key`` that come before this one in ascending ``order`` (NULL first), or
    NULL when there is none.  ``order`` must be unique per key.  ``greatest``:
    new column -> the column of which it is the greatest among these rows."""
    checkpoint_dir(df.sparkSession)
    greatest = greatest or {}
    asc = [F.col(c).asc_nulls_first() for c in order]
    pieces = (df.repartitionByRange(F.col(key), *asc).withColumn("_piece", F.spark_partition_id())
                .checkpoint(eager=True))
    within = Window.partitionBy("_piece", key).orderBy(*asc).rowsBetween(Window.unboundedPreceding, -1)
    spread = (pieces.groupBy(key).agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_b"))
                    .filter("_a < _b").select(key))
    tails = (pieces.join(F.broadcast(spread), on=key, how="left_semi").groupBy(key, "_piece")
                   .agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value].alias("_tail"),
                        *[F.max(c).alias(f"_tail_{n}") for n, c in greatest.items()]))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(key, "_piece", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"),
                         *[F.max(f"_tail_{n}").over(earlier).alias(f"_carry_{n}") for n in greatest])
    own = {"_own": F.last(value, ignorenulls=True).over(within)} | {f"_own_{n}": F.max(c).over(within) for n, c in greatest.items()}
    found = {name: F.coalesce("_own", "_carry")} | {n: F.greatest(f"_own_{n}", f"_carry_{n}") for n in greatest}
    return (pieces.withColumns(own).join(F.broadcast(carry), on=[key, "_piece"], how="left").withColumns(found)
                  .drop(*own, *[c for c in carry.columns if c != key]))


def place_in_key(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: how many rows of the same ``key`` come before this one in
    ascending ``order`` (NULL first), which must be unique per key.  A piece
    numbers its own rows; a key that goes on from earlier pieces adds their
    rows, counted per piece."""
    checkpoint_dir(df.sparkSession)
    asc = [F.col(c).asc_nulls_first() for c in order]
    pieces = (df.repartitionByRange(F.col(key), *asc).withColumn("_piece", F.spark_partition_id())
                .checkpoint(eager=True))
    within = Window.partitionBy("_piece", key).orderBy(*asc)
    spread = (pieces.groupBy(key).agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_b"))
                    .filter("_a < _b").select(key))
    sizes = pieces.join(F.broadcast(spread), on=key, how="left_semi").groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(key, "_piece", F.sum("_n").over(earlier).alias("_carry"))
    return (pieces.withColumn("_own", F.row_number().over(within) - 1)
                  .join(F.broadcast(carry), on=[key, "_piece"], how="left")
                  .withColumn(name, F.col("_own") + F.coalesce("_carry", F.lit(0))).drop("_own", "_carry", "_piece"))


CHUNK_ROWS = 1000


def list_chunks(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, chunk, name): the rows of each ``key`` as lists of structs of
    ``fields`` in ascending ``order`` (unique per key), cut after every
    ``chunk_rows`` rows and numbered from 0, so the list of a key of any size
    is never one value.  Rows whose key is NULL are in no list."""
    placed = place_in_key(df.filter(F.col(key).isNotNull()).select(key, *dict.fromkeys([*order, *fields])), key, order, "_place")
    rows = F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("v"))))
    lists = placed.groupBy(key, F.floor(F.col("_place") / chunk_rows).alias("chunk")).agg(rows.alias("_l"))
    return lists.select(key, "chunk", F.transform("_l", lambda x: x["v"]).alias(name))

"""Dense new ids for a batch without a global window.

A window without PARTITION BY runs in one task.  Instead the rows are
range-partitioned by the order key, each row gets its in-partition index
from ``monotonically_increasing_id`` (partition id in the upper bits), and
each partition's offset is the running total of the partition row counts:
a table with one row per partition, so broadcasting it has a proven bound.
The ordered rows are checkpointed (reliable, in the cluster's checkpoint
folder) so the count and the numbering read the same partitions even if an
executor is lost in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def assign_dense_ids(df: DataFrame, order: Sequence[str], name: str, base: Column | int = 0) -> DataFrame:
    """Add ``name`` = base + 1, base + 2, ... in ascending ``order`` (which
    must be unique).  ``base`` may be a scalar subquery column such as
    ``table.agg(F.max("id")).scalar()``."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    order_cols = [F.col(c).asc_nulls_first() for c in order]
    # Range partitioning samples its input in a job of its own; keep the input
    # cached so the sample and the shuffle do not both recompute it.  (A cache
    # is only a cache: if lost it is recomputed from the deterministic input.)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranged = (src.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                     .withColumn("_mono", F.monotonically_increasing_id()))
        ranged = ranged.checkpoint(eager=True)
    finally:
        src.unpersist()
    pid = F.shiftright(F.col("_mono"), _ROW_BITS)
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    local = F.col("_mono").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (ranged.withColumn("_pid", pid)
                  .join(F.broadcast(offsets), on="_pid", how="inner")
                  .withColumn(name, (F.coalesce(base_col, F.lit(0)) + F.col("_off") + local + 1).cast("bigint"))
                  .drop("_pid", "_off", "_mono"))

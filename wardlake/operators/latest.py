"""Newest row per key.

The source system ranks with ROW_NUMBER() over (key ORDER BY ... DESC) and
keeps rank 1.  We express the same choice as an aggregate: the greatest
struct of (order columns..., payload...) per key.  Unlike a window, an
aggregate is reduced on the map side before the shuffle, so a key that holds
a third of all rows still reaches the reducer as one row per map task.

Struct comparison is field by field with NULL lowest, which is exactly
``ORDER BY c1 DESC NULLS LAST, c2 DESC NULLS LAST, ...``.  Including the
payload in the struct makes the pick deterministic even for full ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   payload: Sequence[str] | None = None, newest: bool = True) -> DataFrame:
    """One row per ``keys``: the row greatest by ``order`` (``newest=True``)
    or least (``newest=False``, i.e. ascending with NULL first).

    Returns ``keys`` + ``order`` + ``payload`` columns.
    """
    keys, order = list(keys), list(order)
    if payload is None:
        payload = [c for c in df.columns if c not in keys]
    fields = order + [c for c in payload if c not in order and c not in keys]
    pick = F.max if newest else F.min
    top = pick(F.struct(*[F.col(c) for c in fields])).alias("_top")
    return (df.groupBy(*keys).agg(top)
              .select(*keys, *[F.col("_top").getField(c).alias(c) for c in fields]))


def flag_first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                       null_key_wins: bool = True) -> DataFrame:
    """Add boolean ``name``: is this row the first of its key group in
    ascending ``order``?  Every row is kept.

    The winner per key comes from a map-side-reduced aggregate, so a hot key
    never has to be sorted in one task (as a window over the key would).  The
    winners are joined back on ``order``, which must be unique over all rows,
    not on the key: a key that holds a third of the rows is no hot join key.
    Rows with a NULL key are not in contention: they get ``null_key_wins``.
    """
    keys, order = list(keys), list(order)
    tag = "_first_" + name
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    winners = (df.filter(~any_null).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_w"))
                 .select(*[F.col("_w").getField(c).alias(f"{tag}_{c}") for c in order], F.lit(True).alias(tag)))
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"{tag}_{c}"))
    joined = df.join(winners, same, "left").drop(*[f"{tag}_{c}" for c in order])
    flag = F.when(any_null, F.lit(null_key_wins)).otherwise(F.coalesce(F.col(tag), F.lit(False)))
    return joined.withColumn(name, flag).drop(tag)

"""Joins on a key of which one value may hold a large part of the rows.

A frequent-items sketch (``approx_top_k``, one narrow pass, merged on the way
up, a bounded answer) names the values with more than ``hot_rows`` rows on the
many side.  Only these are salted: their rows are dealt out over as many
parts as the sketch says they fill, and the single row of the other side is
copied once per part.  All other values keep their plain equi-join, and
without a hot value the plan is the plain join.  The sketch decides where
rows go, never which rows there are: a wrong estimate costs time, no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000  # rows of one value that a task may well sort and join
TRACKED = 10_000      # values a sketch keeps in mind
SALT = "_salt"


def hot_values(many: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> dict[str, dict]:
    """Per key column: value -> number of parts, for the values with more
    than ``hot_rows`` rows, null among them; all columns in one pass.  At
    most ``TRACKED`` / 10 values a column can come back."""
    aggs = [a for i, k in enumerate(keys) for a in (
        F.expr(f"approx_top_k(`{k}`, {TRACKED // 10}, {TRACKED}) filter (where `{k}` is not null)").alias(f"t{i}"),
        F.count_if(F.col(k).isNull()).alias(f"n{i}"))]
    row = many.agg(*aggs).first()
    found = {k: [(r["item"], r["count"]) for r in row[f"t{i}"] or []] + [(None, row[f"n{i}"])] for i, k in enumerate(keys)}
    return {k: {v: -(-n // hot_rows) for v, n in items if n > hot_rows} for k, items in found.items()}


def hot_keys(many: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> dict:
    """``hot_values`` of one key column."""
    return hot_values(many, [key], hot_rows)[key]


def join_split(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS,
               hot: dict | None = None) -> DataFrame:
    """``many`` joined (inner, left or left_semi) with ``one``, which has one
    row per ``key``; the rows of hot values meet it in several tasks.
    ``hot``: the answer of ``hot_values`` for the key, if it is known."""
    hot = hot_keys(many, key, hot_rows) if hot is None else hot
    if not hot:
        return many.join(one, on=key, how=how)
    named = {v: n for v, n in hot.items() if v is not None}
    parts = F.create_map(*[F.lit(x) for pair in named.items() for x in pair]) if named else None
    n = F.lit(1) if parts is None else F.coalesce(F.try_element_at(parts, F.col(key)), F.lit(1))
    # dealt out by the row's own content, so a task that runs again deals alike; a null key meets nothing anyway
    deal = F.when(F.col(key).isNull(), F.lit(hot.get(None, 1))).otherwise(n)
    salted = many.withColumn(SALT, F.pmod(F.xxhash64(*many.columns), deal))
    copies = one.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    return salted.join(copies, on=[key, SALT], how=how).drop(SALT)

"""Answer output: the JSON shapes the ward application returns, written by
Spark executors (never gathered on the driver).

NULL fields are kept (``ignoreNullFields=false``): a patient without a stay
answers ``"id_stay": null``, not a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def answer_json(df: DataFrame) -> Column:
    """One JSON object per row, NULLs kept."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]), _KEEP_NULLS)


def write_answers(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write rows as JSON lines (one answer object per line)."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def keyed_answers(df: DataFrame, key: str, list_name: str) -> DataFrame:
    """``{key: ..., list_name: [...]}`` documents, one per key, for answers
    that are a list per key (e.g. free beds per service).  The list of one
    key is built in one task, so use it for keys with bounded lists;
    ``operators.ordered.list_chunks`` cuts lists of any length."""
    rows = F.struct(*[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.collect_list(rows).alias(list_name))

"""A corpus pipeline of four operators: toxic documents go, documents of low quality go, one
document of each group of near copies stays, and what is left is packed into sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``, and each works on all rows its predecessor
kept. Rows with null texts count as empty texts: not toxic, of the quality an empty text gets.
Rows with a null id are kept by the filters and, having no place in a group, by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import nbsvm, ngram_join, packing, toxicity
from wardlake.llm.common import keep, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator scores below 0.5."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier scores 0.3 or more."""
    ship(spark)
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, similarity 0.8 or more) the one with
    the smallest id; of rows that repeat an id, one. Documents without words link with nothing
    and stay."""
    ship(spark)
    return ngram_join.keep_one(docs, percent=80, k=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: (doc_id, piece, offset, n_words, shard, bin, bin_offset)."""
    ship(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id").drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

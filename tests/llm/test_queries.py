"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from oracle_compare import compare
from pyspark.sql import functions as F

import corpus_pipeline
from wardlake.llm import nbsvm, ngram_join, queries, toxicity
from wardlake.llm.common import keep, ship

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res["cols_ok"] and res["rows"] == res["oracle_rows"] > 0 and res["values_ok"], res


def test_pipeline_stages(spark):
    ship(spark)
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), f"test-{name}")
        kept.append(docs)
    clean, good, one, packed = kept
    assert clean.columns == good.columns == one.columns == start.columns
    tox = toxicity.score(start, toxicity.fit(start, labels)).where("score < 0.5").select(F.col("id").alias("doc_id"))
    assert set(clean.select("doc_id").collect()) == set(tox.collect())
    qual = nbsvm.score(clean, nbsvm.fit(clean, labels)).where("score >= 0.3").select(F.col("id").alias("doc_id"))
    assert set(good.select("doc_id").collect()) == set(qual.collect())
    groups = ngram_join.near_duplicates(good, 80, 5).where("id = component_id").select(F.col("id").alias("doc_id"))
    assert set(one.select("doc_id").collect()) == set(groups.collect())
    assert ngram_join.near_duplicates(one, 80, 5).where("id <> component_id").count() == 0
    words = {r.doc_id: len((r.text or "").encode().split()) for r in one.collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == words
    labelled = clean.join(labels, "doc_id")
    assert labelled.where("quality = 1").count() <= 1.03 * good.join(labels, "doc_id").where("quality = 1").count()

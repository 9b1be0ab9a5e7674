"""The batch search: its product of askings and rows comes last, and a term is looked up by more than a trigram."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlake import schemas
from wardlake.functions.cleaning import literal_runs, run_grams
from wardlake.operators import reads


@pytest.mark.parametrize("wildcards", [False, True])
def test_askings_meet_the_matching_rows_last(spark, seed, wildcards):
    terms = spark.createDataFrame([(1, "a", 2), (2, "%p_r", 2)], "term_id long, term string, id_staff long")
    plan = reads.search_patients_batch(seed, terms, wildcards)._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join " in line)
    assert "_nterm" in last and "id_stay" not in last


def test_an_entry_holds_a_whole_run(spark):
    runs = literal_runs(F.col("t"), True)
    df = spark.createDataFrame([("#000000123%7",)], "t string").select(run_grams(runs, reads.ENTRY).alias("g"))
    assert df.first().g == ["#000000123", "7"]


def test_long_terms_equal_one_by_one(spark, seed):
    """Names that share all their trigrams, and terms that differ only behind an entry's length."""
    names = [f"Patient#{k:020d}" for k in (*range(12), 110, 1100)]
    patient = spark.createDataFrame([(k, n, "x", dt.date(1980, 1, 1), "homme", "a", "0", "A+") for k, n in enumerate(names)], seed.patient.schema)
    stay = spark.createDataFrame([(k, k, 2, dt.datetime(2025, 5, 1), None) for k in range(len(names))], schemas.STAY)
    t = seed.replace(patient=patient, stay=stay)
    service = t.room.where("id_room = 2").first().id_service
    nurse = 90
    staff = seed.staff.unionByName(spark.createDataFrame([(nurse, service, "N", "n@x", "nurse")], seed.staff.schema))
    texts = [*names, "0000000000011", "000000000000000000011", "00000000000000001", "#00", "11", "000000000000000000009x"]
    terms = spark.createDataFrame([(i, x, nurse) for i, x in enumerate(texts)], "term_id long, term string, id_staff long")
    want = sorted((i, k) for i, x in enumerate(texts) for k, n in enumerate(names) if x.lower() in n.lower())
    for wildcards in (False, True):
        got = reads.search_patients_batch(t.replace(staff=staff), terms, wildcards).collect()
        assert sorted((r.term_id, r.id_stay) for r in got) == want

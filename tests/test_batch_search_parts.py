"""The batch search's product in bounded pieces: askings as short lists, the rows of a frequent term in parts."""

from __future__ import annotations

from collections import Counter

import pytest

from wardlake import schemas
from wardlake.operators import reads

TERMS = "term_id long, term string, id_staff long"


@pytest.mark.parametrize("wildcards", [False, True])
def test_askings_are_opened_behind_the_last_join(spark, seed, wildcards):
    terms = spark.createDataFrame([(1, "a", 2), (2, "%p_r", 2)], TERMS)
    plan = reads.search_patients_batch(seed, terms, wildcards)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(plan) if "Join " in line)
    assert any("inline(_who" in line for line in plan[:last])
    assert "_part" in plan[last]


def test_lists_are_short_and_whole(spark):
    asks = spark.createDataFrame([(2, "a", i % 300, i % 7) for i in range(1000)] + [(3, "b", None, 1)],
                                 "_asked long, _nterm string, term_id long, id_staff long")
    lists = reads._ask_lists(asks, ["_asked", "_nterm"]).collect()
    assert max(len(r._who) for r in lists) <= reads.ASK_ROWS
    got = Counter((r._asked, r._nterm, w.term_id, w.id_staff) for r in lists for w in r._who)
    assert got == Counter(tuple(r) for r in asks.collect())


@pytest.mark.parametrize("wildcards", [False, True])
def test_parts_give_the_whole_product(spark, seed, monkeypatch, wildcards):
    monkeypatch.setattr(reads, "ASK_ROWS", 3)
    monkeypatch.setattr(reads, "HIT_ROWS", 2)
    stay = seed.stay.unionByName(spark.createDataFrame(
        [(100 + i, 1 + i % 7, 5, None, None) for i in range(9)], schemas.STAY))
    t = seed.replace(stay=stay)
    texts = ["a", "o", "", "Harry", "zzz", None]
    asked = [(i % 40 if i % 40 else None, texts[i % 6], 2 + i % 2) for i in range(90)]
    got = Counter((r.term_id, r.id_staff, r.id_stay) for r in reads.search_patients_batch(
        t, spark.createDataFrame(asked, TERMS), wildcards).collect())
    services = {r.id_staff: r.id_service for r in t.staff.collect()}
    census = reads.service_census(t, ordered=False).collect()
    want = Counter((i, staff, r.id_stay) for i, term, staff in asked if term is not None for r in census
                   if r.id_service == services[staff] and (term.lower() in r.full_name.lower() or term in r.nin))
    assert got == want and max(want.values()) > 1

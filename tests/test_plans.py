"""Plan guards: properties that must hold for the plans to survive scale."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from wardlake.plans import catalog
from wardlake.operators import reads
from wardlake.sources.standin import standin_tables

SF = "/root/testdata/sf0.001"

def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_pairs_and_no_windows(spark, name):
    plan = plan_text(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # newest-per-key and first-per-key are aggregates, never windows over a key: the only windows run over
    # the row counts of the partitions (new ids) or within one piece of a range-partitioned table
    for spec in re.findall(r"windowspecdefinition\(.*?specifiedwindowframe", plan):
        assert "_pid#" in spec or "_piece#" in spec, (name, spec)


def test_key_filter_reaches_scan(spark):
    t = standin_tables(spark, SF)
    plan = plan_text(reads.patient_card(t, "2005-02-28", patients=[7, 11]))
    assert "PushedFilters: [In(c_custkey, [11,7])" in plan or "PushedFilters: [In(c_custkey, [7,11])" in plan
    plan = plan_text(reads.stay_prescriptions(t, [5]))
    assert "EqualTo(l_orderkey,5)" in plan


def test_projection_is_pruned(spark):
    t = standin_tables(spark, SF)
    plan = plan_text(reads.roster(t))
    # the roster needs key, name and nation of customers, never balance or segment
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    assert "l_extendedprice" not in plan


def test_hot_key_newest_is_partial_aggregate(spark):
    t = standin_tables(spark, SF)
    plan = plan_text(reads.current_stay(t))
    assert "partial_max" in plan


def test_bucketed_snapshot_avoids_shuffle_on_stay_key(spark, seed):
    import tempfile

    from wardlake.sources.snapshot import read_catalog_snapshot, save_catalog_snapshot
    loc = tempfile.mkdtemp(prefix="wardlake-db-", dir="/tmp")
    save_catalog_snapshot(seed, "ward_bucketed", 4, location=loc)
    t = read_catalog_snapshot(spark, "ward_bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the large-table plan
    try:
        q = t.stay.join(reads.newest_observation(t), on="id_stay", how="left")
        plan = plan_text(q)
        assert "Exchange" not in plan, plan
        assert len(q.collect()) == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

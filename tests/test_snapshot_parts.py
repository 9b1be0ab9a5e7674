"""Snapshot versions in parts, and lists in chunks."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wardlake.operators import changes, ordered, reads
from wardlake.sources import snapshot
from wardlake.sources.snapshot import TABLE_NAMES

PARTS = {"stay": 8, "room": 8, "prescription": 4}


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


@pytest.fixture()
def v1(spark, seed):
    root = tempfile.mkdtemp(prefix="wardlake-parts-", dir="/tmp")
    snapshot.write_snapshot_parts(seed, f"{root}/v1", PARTS)
    return root


def transferred(spark, base):
    req = spark.createDataFrame([(1, "4", "9", "2")], "request_id bigint, id_stay string, id_room string, id_staff string")
    req = req.select("request_id", F.lit("2025-06-01 08:00:00").cast("timestamp_ntz").alias("requested_at"),
                     "id_stay", "id_room", "id_staff")
    res = changes.transfer(base, req)
    assert [r.reason for r in res.rejects.collect()] == []
    return res.tables


def test_a_transfer_writes_the_parts_it_changed(spark, seed, v1):
    base = snapshot.read_snapshot(spark, f"{v1}/v1")
    assert all(same(getattr(seed, n), getattr(base, n)) for n in TABLE_NAMES)
    after = transferred(spark, base)
    assert sorted(snapshot.write_version(after, base, f"{v1}/v1", f"{v1}/v2")) == ["room", "stay"]
    parts = [r for r in snapshot.manifest(spark, f"{v1}/v2") if r["part"] is not None]
    new = {n: [r["part"] for r in parts if r["name"] == n and r["path"].startswith(f"{v1}/v2/")] for n in PARTS}
    assert len(new["stay"]) == 1 and 1 <= len(new["room"]) <= 2 and new["prescription"] == []
    back = snapshot.read_snapshot(spark, f"{v1}/v2")
    assert all(same(getattr(after, n), getattr(back, n)) for n in TABLE_NAMES)
    assert not same(seed.stay, back.stay) and same(seed.stay, snapshot.read_snapshot(spark, f"{v1}/v1").stay)


def test_a_failed_write_leaves_the_old_version(spark, seed, v1):
    base = snapshot.read_snapshot(spark, f"{v1}/v1")
    broken = base.replace(stay=base.stay.withColumn("id_room", F.when(F.col("id_stay") > 2, F.raise_error(F.lit("lost")).cast("bigint"))))
    with pytest.raises(Exception, match="lost"):
        snapshot.write_version(broken, base, f"{v1}/v1", f"{v1}/v2")
    assert snapshot.child_names(spark, f"{v1}/v2/{snapshot.MANIFEST}") == []
    assert same(seed.stay, snapshot.read_snapshot(spark, f"{v1}/v1").stay)


def test_appended_rows_and_emptied_parts(spark, seed, v1):
    more = seed.prescription.withColumn("id_prescription", F.col("id_prescription") + 1000)
    for _ in range(2):
        snapshot.append_rows(more, f"{v1}/v1", "prescription", "b1")
    base = snapshot.read_snapshot(spark, f"{v1}/v1")
    assert same(base.prescription, seed.prescription.unionByName(more))
    after = base.replace(prescription=base.prescription.where("id_prescription <> 1001"), stay=base.stay.where("id_stay = 3"))
    snapshot.write_version(after, base, f"{v1}/v1", f"{v1}/v2")
    back = snapshot.read_snapshot(spark, f"{v1}/v2")
    assert same(back.prescription, after.prescription) and same(back.stay, after.stay)
    none = back.replace(stay=back.stay.where("false"))
    snapshot.write_version(none, back, f"{v1}/v2", f"{v1}/v3")
    assert snapshot.read_snapshot(spark, f"{v1}/v3").stay.count() == 0


def test_parts_differ_by_nulls_and_copies(spark, seed):
    stay = seed.stay.where("id_stay = 3")
    swapped = stay.withColumn("date_out", F.col("date_in")).withColumn("date_in", F.lit(None).cast("timestamp_ntz"))
    plain = stay.withColumn("date_out", F.lit(None).cast("timestamp_ntz"))
    assert snapshot.changed_parts(plain, plain, "stay", 4) == []
    assert len(snapshot.changed_parts(plain, swapped, "stay", 4)) == 1
    assert len(snapshot.changed_parts(plain, plain.unionByName(plain).unionByName(plain), "stay", 4)) == 1


def test_list_chunks_of_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice([7, 7, 7, 1, 2, 3, None]), i) for i in range(3000)]
    rng.shuffle(rows)
    got = ordered.list_chunks(spark.createDataFrame(rows, "k bigint, v bigint").repartition(6), "k", ["v"], ["v"], "l", 100).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.k, r.chunk)):
        assert r.chunk == len(lists.setdefault(r.k, [])) // 100 and 1 <= len(r.l) <= 100
        lists[r.k] += [x.v for x in r.l]
    assert lists == {k: sorted(v for q, v in rows if q == k) for k in (1, 2, 3, 7)}


def test_summary_chunks_name_every_stay(spark, seed):
    got = reads.stay_summary_chunks(seed, chunk_rows=1).collect()
    assert {r.id_stay for r in got if r.chunk == 0} == {r.id_stay for r in seed.stay.collect()}
    nested = {r.id_stay: r for r in reads.stay_summary_nested(seed, seed.stay).collect()}
    for stay, want in nested.items():
        own = sorted((r for r in got if r.id_stay == stay), key=lambda r: r.chunk)
        assert [p for r in own for p in r.prescriptions] == want.prescriptions
        assert own[0].latest_obs == want.latest_obs and all(r.latest_obs is None for r in own[1:])

"""Batch changes on the seed rows."""

from __future__ import annotations

from conftest import rows

from pyspark.sql import functions as F

from wardlake import schemas
from wardlake.operators import changes, checks, reads

BATCH = "2025-06-01 00:00:00"


def _req(spark, schema, data):
    names = [f.name for f in schema.fields]
    full = [dict(zip(names, [None] * len(names)), **d) for d in data]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in full], schema)


def test_discharge_stay_7(spark, seed):
    req = _req(spark, schemas.STATUS_REQ, [dict(request_id=1, id_stay="7", action="discharge", id_room="5",
                                                date_out="2025-06-01")])
    res = changes.apply_status(seed, req, BATCH)
    t = res.tables
    s7 = t.stay.filter("id_stay = 7").collect()[0]
    assert s7.id_room is None and s7.date_out is not None
    assert rows(reads.free_rooms(t, services=[2]), "id_room") == [(5,), (9,)]
    assert rows(reads.service_census(t, staff=[2]), "full_name") == [("Laura Palmer",)]
    assert reads.roster(t).count() == 7
    assert checks.bed_flag_mismatches(t).count() == 0
    assert res.rejects.count() == 0


def test_transfer(spark, seed):
    ok = _req(spark, schemas.TRANSFER_REQ, [dict(request_id=1, id_stay="4", id_room="9", id_staff="2")])
    t = changes.transfer(seed, ok).tables
    flags = dict((r.id_room, r.available) for r in t.room.collect())
    assert flags[9] is False and flags[8] is True
    assert checks.bed_flag_mismatches(t).count() == 0
    bad = _req(spark, schemas.TRANSFER_REQ, [dict(request_id=1, id_stay="4", id_room="6", id_staff="2")])
    assert rows(changes.transfer(seed, bad).rejects, "reason") == [("service mismatch",)]


def test_reactivate(spark, seed):
    taken = _req(spark, schemas.STATUS_REQ, [dict(request_id=1, id_stay="2", action="reactivate", id_room="1")])
    assert rows(changes.apply_status(seed, taken, BATCH).rejects, "reason") == [("bed not free",)]
    free = _req(spark, schemas.STATUS_REQ, [dict(request_id=1, id_stay="2", action="reactivate", id_room="11")])
    t = changes.apply_status(seed, free, BATCH).tables
    s2 = t.stay.filter("id_stay = 2").collect()[0]
    assert s2.date_out is None and s2.id_room == 11
    assert [r.available for r in t.room.filter("id_room = 11").collect()] == [False]


def test_admissions_conflict_rule(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    req = spark.createDataFrame([
        (1, t0, "1", "9", "2025-06-01"),   # first for bed 9: wins
        (2, t0, "3", "9", "2025-06-01"),   # second for bed 9: conflict
        (3, t0, "4", "1", "2025-06-01"),   # bed 1 taken
        (4, t0, "5", "0", "2025-06-01"),   # no bed
        (5, t0, "6", "11", "2025-02-31"),  # impossible date
        (6, t0, "99", "7", "2025-06-01"),  # unknown patient
    ], schemas.ADMIT_EXISTING_REQ)
    strict = rows(changes.admit_existing(seed, req).rejects, "request_id", "reason")
    assert strict[0] == (1, "already active")
    seed = seed.replace(stay=seed.stay.withColumn("date_out", F.coalesce("date_out", F.lit(t0).cast("timestamp_ntz"))))
    res = changes.admit_existing(seed, req)
    assert rows(res.rejects, "request_id", "reason") == [(2, "conflict"), (3, "bed not free"),
                                                         (5, "invalid: date_in"), (6, "unknown patient")]
    assert rows(res.accepted, "request_id", "id_stay", "id_room") == [(1, 9, 9), (4, 10, None)]
    assert changes.admit_existing(seed, req, check_free=False).rejects.filter("request_id = 3").count() == 0


def test_admit_new(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    req = spark.createDataFrame([
        (1, t0, "New One", "0001", "2000-01-01", "homme", "x", None, "A+", "9", "2025-06-01 09:00"),
        (2, t0, "New Two", "0002", "2000-01-01", "other", "x", None, "A+", "6", None),
    ], schemas.ADMIT_NEW_REQ)
    res = changes.admit_new(seed, req, BATCH)
    assert rows(res.rejects, "request_id", "reason") == [(2, "invalid: sex")]
    assert rows(res.accepted, "id_patient", "id_stay", "id_room") == [(8, 9, 9)]
    assert res.tables.patient.count() == 8
    assert checks.bed_flag_mismatches(res.tables).count() == 0


def test_update_patient_move(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    p = seed.patient.filter("id_patient = 4").collect()[0]
    req = spark.createDataFrame([(1, t0, "4", "Laura P.", p.nin, str(p.birth_date), p.sex, p.address, p.phone,
                                  p.blood_group, "9", None)], schemas.UPDATE_PATIENT_REQ)
    res = changes.update_patient(seed, req, BATCH)
    assert res.rejects.count() == 0
    t = res.tables
    assert t.patient.filter("id_patient = 4").collect()[0].full_name == "Laura P."
    assert t.stay.filter("id_stay = 4").collect()[0].id_room == 9
    assert checks.bed_flag_mismatches(t).count() == 0


def test_discharge_by_patient_and_availability(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    req = spark.createDataFrame([(1, t0, "7", None), (2, t0, "7", None)], schemas.DISCHARGE_PATIENT_REQ)
    res = changes.discharge_by_patient(seed, req, BATCH)
    assert rows(res.rejects, "request_id", "reason") == [(2, "conflict")]
    assert res.tables.stay.filter("id_stay = 7").collect()[0].date_out is not None
    req = spark.createDataFrame([(1, t0, "6", "no"), (2, t0 + dt.timedelta(1), "6", "yes"), (3, t0, "99", "1")],
                                schemas.AVAILABILITY_REQ)
    res = changes.set_availability(seed, req)
    assert rows(res.rejects, "request_id", "reason") == [(1, "superseded"), (3, "unknown bed")]
    assert res.tables.room.filter("id_room = 6").collect()[0].available is True


def test_observations(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    base = dict(id_stay="3", id_nurse="2", state="<b>Ok</b>", blood_pressure="120/80", temperature="38.456",
                heart_rate="80", spo2="97", glucose="5.5", weight="70", height="165.5",
                remark='a<b> & "q" \'s\'', observed_at="2025-05-01T08:30")
    rows_in = [dict(base, request_id=1, requested_at=t0),
               dict(base, request_id=2, requested_at=t0, temperature="1000.0"),
               dict(base, request_id=3, requested_at=t0, height="170cm", id_stay="99"),
               dict(base, request_id=4, requested_at=t0, height="0"),
               dict(base, request_id=5, requested_at=t0, height="17000cm")]
    req = _req(spark, schemas.OBSERVATION_REQ, rows_in)
    res = changes.ingest_observations(seed, req, BATCH)
    assert rows(res.rejects, "request_id", "reason") == [(2, "out of range: temperature"), (3, "unknown stay"),
                                                         (5, "out of range: height")]
    acc = {r.request_id: r for r in res.accepted.collect()}
    assert str(acc[1].height) == "1.66" and str(acc[1].temperature) == "38.46"
    assert acc[1].state == "Ok" and acc[1].remark == "a &amp; &quot;q&quot; &#039;s&#039;"
    assert acc[1].observed_at == dt.datetime(2025, 5, 1, 8, 30)
    assert str(acc[4].height) == "0.00"
    assert acc[1].id_obs == 9 and acc[4].id_obs == 10
    assert res.tables.observation.count() == 10
    strict = changes.ingest_observations(seed, req, BATCH, strict=True)
    assert (4, "missing: height") in rows(strict.rejects, "request_id", "reason")


def test_amend_and_prescriptions(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    amend = _req(spark, schemas.OBSERVATION_REQ, [dict(
        request_id=1, requested_at=t0, id_obs="3", id_stay="3", id_nurse="3", state="Better", blood_pressure="1",
        temperature="37", heart_rate="80", spo2="97", glucose="5", weight="80", height="1.80", remark="r",
        observed_at="2025-05-26 10:00:00")])
    again = amend.withColumn("request_id", F.lit(2).cast("bigint")).withColumn("state", F.lit("Later"))
    both = changes.amend_observations(seed, amend.unionByName(again))
    assert rows(both.rejects, "request_id", "reason") == [(1, "superseded")]
    assert both.tables.observation.filter("id_obs = 3").collect()[0].state == "Later"
    for col, value, why in (("id_stay", "999", "unknown stay"), ("id_nurse", "888", "unknown nurse"),
                            ("state", "x" * 40, "too long: state"), ("height", "300", "out of range: height")):
        bad = changes.amend_observations(seed, amend.withColumn(col, F.lit(value)))
        assert rows(bad.rejects, "reason") == [(why,)]
    assert changes.amend_observations(seed, amend).tables.observation.filter("id_obs = 3").collect()[0].state == "Better"
    own = changes.amend_observations(seed, amend, own_only=True)
    assert rows(own.rejects, "reason") == [("not found",)]  # nurse 3 did not write observation 3
    presc = _req(spark, schemas.PRESCRIPTION_REQ, [
        dict(request_id=1, requested_at=t0, action="insert", id_stay="3", drug="X", dose="1", frequency="2"),
        dict(request_id=2, requested_at=t0, action="update", id_prescription="1", drug="Y", dose="2", frequency="1"),
        dict(request_id=3, requested_at=t0, action="delete", id_prescription="2"),
        dict(request_id=4, requested_at=t0, action="update", id_prescription="77", drug="Z", dose="1",
             frequency="1")])
    res = changes.prescription_changes(seed, presc)
    assert rows(res.rejects, "request_id", "reason") == [(4, "unknown prescription")]
    p = {r.id_prescription: r for r in res.tables.prescription.collect()}
    assert 2 not in p and p[1].drug == "Y" and p[9].drug == "X"
    mixed = _req(spark, schemas.PRESCRIPTION_REQ, [
        dict(request_id=1, requested_at=t0, action="update", id_prescription="1", drug="A", dose="2", frequency="1"),
        dict(request_id=2, requested_at=t0, action="delete", id_prescription="1"),
        dict(request_id=3, requested_at=t0, action="update", id_prescription="1", drug="B", dose="2", frequency="1"),
        dict(request_id=4, requested_at=t0, action="update", id_prescription="3", drug="C", dose="2", frequency="1"),
        dict(request_id=5, requested_at=t0, action="update", id_prescription="3", drug="D", dose="2", frequency="1")])
    res = changes.prescription_changes(seed, mixed)
    assert rows(res.rejects, "request_id", "reason") == [(1, "superseded"), (3, "unknown prescription"), (4, "superseded")]
    assert rows(res.accepted, "request_id") == [(2,), (5,)]
    p = {r.id_prescription: r for r in res.tables.prescription.collect()}
    assert 1 not in p and p[3].drug == "D"


def test_strict_status_keeps_bed_flags(spark, seed):
    """What the source system would let through and what would break the bed flags."""
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    move = _req(spark, schemas.TRANSFER_REQ, [dict(request_id=1, requested_at=t0, id_stay="2", id_room="9", id_staff="2")])
    assert rows(changes.transfer(seed, move).rejects, "reason") == [("not active",)]
    status = _req(spark, schemas.STATUS_REQ, [
        dict(request_id=1, requested_at=t0, id_stay="1", action="reactivate", id_room="11"),
        dict(request_id=2, requested_at=t0, id_stay="3", action="discharge", id_room="3", date_out="2025-05-01 00:00:00")])
    res = changes.apply_status(seed, status, BATCH)
    assert rows(res.rejects, "request_id", "reason") == [(1, "already active"), (2, "end before entry")]
    two = seed.replace(stay=seed.stay.withColumn("id_patient", F.when(F.col("id_stay") == 7, F.lit(1).cast("bigint"))
                                                 .otherwise(F.col("id_patient"))))
    req = spark.createDataFrame([(1, t0, "1", None)], schemas.DISCHARGE_PATIENT_REQ)
    ended = changes.discharge_by_patient(two, req, BATCH)
    assert rows(ended.accepted, "id_stay") == [(1,), (7,)]
    for t in (changes.transfer(seed, move).tables, res.tables, ended.tables):
        assert checks.bed_flag_mismatches(t).count() == 0


def test_load_staff(spark, seed):
    import datetime as dt
    t0 = dt.datetime(2025, 6, 1, 8)
    req = spark.createDataFrame([
        (1, t0, "2", "Nina", "nina@h.com", "Nurse"), (2, t0, None, "Nora", "nora@h.com", "nurse"),
        (3, t0, None, "Adam", "adam@h.com", "admin"), (4, t0, "2", "Bob2", "BOB.N@hospital.com", "nurse"),
        (5, t0, "2", "Nina2", "NINA@h.com", "nurse"), (6, t0, "2", "Zed", "z@h.com", "doctor")],
        schemas.STAFF_REQ)
    res = changes.load_staff(seed, req)
    assert rows(res.rejects, "request_id", "reason") == [(2, "missing: id_service"), (4, "duplicate email"),
                                                         (5, "duplicate email"), (6, "unknown role")]
    assert rows(res.accepted, "request_id", "id_staff") == [(1, 4), (3, 5)]


def test_jobs_read_and_apply(spark, seed):
    import json
    import tempfile

    from wardlake.jobs import run
    from wardlake.sources.snapshot import read_snapshot, write_snapshot
    root = tempfile.mkdtemp(prefix="wardlake-snap-", dir="/tmp")
    write_snapshot(seed, f"{root}/v1")
    run(spark, ["read", "admin_overview", "--snapshot", f"{root}/v1", "--out", f"{root}/answers",
                "--as-of", "2025-06-01", "--format", "json"])
    assert spark.read.json(f"{root}/answers").count() == 7
    req_dir = f"{root}/incoming"
    import os
    os.makedirs(req_dir)
    with open(f"{req_dir}/r.json", "w") as f:
        f.write(json.dumps({"request_id": 1, "requested_at": "2025-06-01T08:00:00", "id_stay": "4",
                            "id_room": "9", "id_staff": "2"}) + "\n")
        f.write(json.dumps({"request_id": 2, "requested_at": "2025-06-01T08:00:00", "id_stay": "4",
                            "id_room": "6", "id_staff": "2"}) + "\n")
    run(spark, ["apply", "transfer", "--snapshot", f"{root}/v1", "--requests", req_dir, "--out", f"{root}/v2"])
    v2 = read_snapshot(spark, f"{root}/v2")
    assert v2.stay.filter("id_stay = 4").collect()[0].id_room == 9
    assert rows(spark.read.parquet(f"{root}/v2/_rejects"), "request_id", "reason") == [(2, "service mismatch")]

"""Constraint helpers not covered elsewhere: defaults, cascades, ranges,
timestamp parsing and the append path."""

from __future__ import annotations

import datetime as dt
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from wardlake.functions import cleaning as X
from wardlake.operators import checks
from wardlake.sources.snapshot import append_rows, read_snapshot, write_snapshot


def test_defaults_and_cascades(spark, seed):
    staff = checks.fill_defaults(seed.staff.withColumn("role", F.lit(None).cast("string")), {"role": "nurse"})
    assert {r.role for r in staff.collect()} == {"nurse"}
    gone = spark.createDataFrame([(2,)], "id_service long")
    after = checks.cascade_service_delete(seed.staff, gone)
    assert rows(after, "id_staff", "id_service") == [(1, None), (2, None), (3, 3)]
    renames = spark.createDataFrame([(3, 30)], "id_service long, new_id_service long")
    after = checks.cascade_service_rename(seed.staff, renames)
    assert rows(after, "id_staff", "id_service") == [(1, None), (2, 2), (3, 30)]


def test_range_rules(spark):
    df = spark.createDataFrame([(1, "12.345", "5"), (2, "1234.5", "99999999999"), (3, None, "-3")],
                               "id long, t string, n string")
    _, bad = checks.violations(df, [checks.fits_decimal("t", 5, 2), checks.int_range("n"),
                                    checks.domain("n", ["5", "-3"])])
    assert rows(bad, "id", "reason") == [(2, "decimal_range:t")]
    _, bad = checks.violations(df, [checks.int_range("n", 0, 10)])
    assert rows(bad, "id", "reason") == [(2, "int_range:n"), (3, "int_range:n")]


def test_timestamp_forms(spark):
    df = spark.createDataFrame([("2025-05-01T08:30",), ("2025-05-01 08:30:15",), ("2025-05-01",), ("tomorrow",),
                                (None,)], "s string")
    got = [r.t for r in df.select(X.parse_timestamp("s", "2025-06-01 00:00:00").alias("t")).collect()]
    assert got == [dt.datetime(2025, 5, 1, 8, 30), dt.datetime(2025, 5, 1, 8, 30, 15), dt.datetime(2025, 5, 1),
                   dt.datetime(2025, 6, 1), dt.datetime(2025, 6, 1)]


def test_append_path(spark, seed):
    root = tempfile.mkdtemp(prefix="wardlake-app-", dir="/tmp") + "/v1"
    write_snapshot(seed, root)
    good, _ = checks.violations(seed.prescription.withColumn("id_prescription", F.col("id_prescription") + 100),
                                checks.default_rules(seed)["prescription"])
    append_rows(good, root, "prescription", "b1")
    append_rows(good, root, "prescription", "b1")  # sent again: its rows stay once
    assert read_snapshot(spark, root).prescription.count() == 16


def test_half_written_append_is_not_read(spark, seed):
    import os
    import tempfile
    root = tempfile.mkdtemp(prefix="wardlake-app-", dir="/tmp") + "/v1"
    write_snapshot(seed, root)
    n = seed.prescription.count()
    append_rows(seed.prescription, root, "prescription", "b1")
    append_rows(seed.prescription.limit(1), root, "prescription", "b2")
    assert read_snapshot(spark, root).prescription.count() == 2 * n + 1
    os.remove(f"{root}/prescription-appends/b2/_SUCCESS")
    assert read_snapshot(spark, root).prescription.count() == 2 * n


def test_service_changes_equal_a_model(spark, seed):
    """Random batches of removals and renames, with swaps, chains and clashes, against a plain model."""
    import random

    from conftest import rows
    rng = random.Random(8)
    for _ in range(6):
        services = list(range(1, 9))
        beds, staff = {10 + i: rng.choice(services[:5]) for i in range(4)}, {i: rng.choice([*services, None]) for i in range(12)}
        reqs = [(i, rng.choice([*services, 77]), rng.choice([None, *range(1, 12)])) for i in range(rng.randrange(3, 9))]
        why, todo = {}, {}
        for i, s, new in reqs:
            why[i] = ("unknown service" if s not in services else "conflict" if s in todo.values() or any(s == q[1] for q in reqs if q[0] < i)
                      else "service has beds" if new is None and s in beds.values() else None)
            if why[i] is None:
                todo[i] = s
        moves = {i: (s, new) for i, s, new in reqs if why[i] is None}
        taken = {}
        for i, (s, new) in moves.items():
            if new is not None and taken.setdefault(new, i) != i:
                why[i] = "key taken"
        moves = {i: m for i, m in moves.items() if not why[i]}
        while True:
            leaving = {s for s, new in moves.values() if new != s}
            bad = [i for i, (s, new) in moves.items() if new not in (None, s) and new in services and new not in leaving]
            if not bad:
                break
            for i in bad:
                why[i] = "key taken"
                del moves[i]
        to = dict(moves.values())
        t = seed.replace(
            service=spark.createDataFrame([(s, "n", None) for s in services], seed.service.schema),
            room=spark.createDataFrame([(b, s, 1, 1, True) for b, s in beds.items()], seed.room.schema),
            staff=spark.createDataFrame([(k, s, "n", f"{k}@x", "nurse") for k, s in staff.items()], "id_staff long, id_service long, full_name string, email string, role string"))
        got, rejects = checks.change_services(t, spark.createDataFrame(reqs, "request_id long, id_service long, new_id_service long"))
        assert dict(rows(rejects, "request_id", "reason")) == {i: w for i, w in why.items() if w}
        assert sorted(r.id_service for r in got.service.collect()) == sorted(to.get(s, s) for s in services if to.get(s, s) is not None)
        assert dict(rows(got.room, "id_room", "id_service")) == {b: to.get(s, s) for b, s in beds.items()}
        assert dict((r.id_staff, r.id_service) for r in got.staff.collect()) == {k: to.get(s, s) for k, s in staff.items()}

"""Read operators on the seed rows, against the golden answers."""

from __future__ import annotations

import datetime as dt

from conftest import AS_OF, rows

from wardlake.operators import checks, reads


def test_roster(seed):
    out = rows(reads.roster(seed), "id_patient", "service_name")
    assert out == sorted([(1, "Cardiology"), (2, "Cardiology"), (2, "Cardiology"), (3, "Cardiology"),
                          (6, "Cardiology"), (4, "Neurology"), (7, "Neurology"), (5, "Pediatrics")])
    assert len(reads.roster(seed, active_only=True).collect()) == 7


def test_patient_card(seed):
    r = reads.patient_card(seed, AS_OF, patients=[2]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.id_stay, r.room_no, r.service_name, r.age) == (8, 102, "Cardiology", 30)
    assert r.birth_date == "1994-07-22" and r.date_in == "2025-05-22"


def test_patient_card_without_stay(spark, seed):
    from wardlake import schemas
    extra = spark.createDataFrame([(9, "No Stay", "1", dt.date(2000, 1, 1), "homme", "x", None, "A+")],
                                  schemas.PATIENT)
    t = seed.replace(patient=seed.patient.unionByName(extra))
    r = reads.patient_card(t, AS_OF, patients=[9]).collect()[0]
    assert r.id_stay is None and r.age == 25


def test_patient_detail(seed):
    out = {r.id_patient: r for r in reads.patient_detail(seed, AS_OF).collect()}
    assert len(out) == 7
    assert out[2].id_stay == 8 and out[2].state == "Recovering"  # stay 2 has ended
    assert out[3].room_no == 101 and out[3].state == "Critical" and out[3].age == 61


def test_admin_overview_order_and_values(seed):
    got = [(r.full_name, r.id_stay, r.room_no, r.bed_no, r.service_name, r.age)
           for r in reads.admin_overview(seed, AS_OF).collect()]
    assert got == [("Audrey Horne", 6, 101, 2, "Cardiology", 18), ("Dale Cooper", 5, 302, 1, "Pediatrics", 35),
                   ("Harry S. Truman", 7, 201, 1, "Neurology", 45), ("Jane Smith", 8, 102, 4, "Cardiology", 30),
                   ("John Doe", 1, 101, 1, "Cardiology", 46), ("Laura Palmer", 4, 202, 1, "Neurology", 18),
                   ("Tom Hanks", 3, 101, 3, "Cardiology", 61)]


def test_service_census(seed):
    out = reads.service_census(seed, staff=[1, 2, 3], per_staff=True).collect()
    by = {}
    for r in out:
        by.setdefault(r.id_staff, []).append((r.full_name, r.id_stay, r.room_no, r.latest_state))
    assert by[2] == [("Harry S. Truman", 7, 201, "Calm"), ("Laura Palmer", 4, 202, "Agitated")]
    assert by[3] == [("Dale Cooper", 5, 302, "Good")]
    assert 1 not in by
    # all-keys form: one row per active stay with a bed in a service that has a nurse
    assert rows(reads.service_census(seed), "id_service", "id_stay") == [(2, 4), (2, 7), (3, 5)]


def test_search(seed):
    assert rows(reads.search_patients(seed, "a", staff=[2]), "full_name") == [("Harry S. Truman",),
                                                                              ("Laura Palmer",)]
    assert rows(reads.search_patients(seed, "0712", staff=[2]), "full_name") == [("Laura Palmer",)]
    # case and accents ignored
    assert rows(reads.search_patients(seed, "LÁURA", staff=[2]), "full_name") == [("Laura Palmer",)]
    # wildcards only on request
    assert rows(reads.search_patients(seed, "L_ura", staff=[2]), "full_name") == []
    assert rows(reads.search_patients(seed, "L_ura", staff=[2], wildcards=True), "full_name") == [("Laura Palmer",)]


def test_free_rooms(seed):
    assert rows(reads.free_rooms(seed), "id_service", "id_room") == [(1, 11), (2, 9), (3, 6), (4, 7)]
    assert rows(reads.free_rooms_for_staff(seed, [1, 2, 3], per_staff=True), "id_staff", "id_room") == [(2, 9), (3, 6)]
    assert rows(reads.free_rooms_for_staff(seed, [1, 2, 3]), "id_service", "id_room") == [(2, 9), (3, 6)]
    assert rows(reads.service_census(seed, staff=[2, 2, 1]), "id_service", "id_stay") == [(2, 4), (2, 7)]


def test_prescriptions_and_summary(seed):
    assert rows(reads.stay_prescriptions(seed, [3]), "drug") == [("Metoprolol",)]
    assert rows(reads.stay_prescriptions_checked(seed, [3, 99]), "drug") == [("Metoprolol",)]
    s = reads.stay_summary(seed, [3]).collect()
    assert len(s) == 1 and s[0].drug == "Metoprolol" and s[0].last_state == "Critical"
    assert float(s[0].last_temperature) == 38.40 and s[0].last_obs_by == "Bob Nurse"
    n = reads.stay_summary_nested(seed, [3]).collect()[0]
    assert [(p.drug, p.dose, p.frequency) for p in n.prescriptions] == [("Metoprolol", 50, 2)]
    assert n.latest_obs.last_state == "Critical"


def test_lookups(spark, seed):
    req = spark.createDataFrame([(1, 4), (2, 99)], "request_id long, id_stay long")
    assert rows(reads.stay_room(seed, req), "request_id", "id_room") == [(1, 8), (2, None)]
    req = spark.createDataFrame([(1, 9), (2, 1), (3, 99)], "request_id long, id_room long")
    assert rows(reads.room_available(seed, req), "request_id", "available") == [(1, True), (2, False), (3, False)]
    assert rows(reads.room_service(seed, req), "request_id", "id_service") == [(1, 2), (2, 1), (3, None)]
    req = spark.createDataFrame([(1, 1), (2, 2)], "request_id long, id_staff long")
    assert rows(reads.staff_service(seed, req), "request_id", "id_service") == [(1, None), (2, 2)]
    assert rows(reads.current_stay(seed, [2]), "id_patient", "id_stay") == [(2, 8)]


def test_invariant_and_constraints(seed):
    assert checks.bed_flag_mismatches(seed).count() == 0
    assert checks.table_violations(seed).count() == 0


def test_search_batch(spark, seed):
    terms = spark.createDataFrame([(1, "a", 2), (2, "0712", 2), (3, "dale", 3), (4, "x", 1)],
                                  "term_id long, term string, id_staff long")
    got = rows(reads.search_patients_batch(seed, terms), "term_id", "full_name")
    assert got == [(1, "Harry S. Truman"), (1, "Laura Palmer"), (2, "Laura Palmer"), (3, "Dale Cooper")]


def test_batch_search_of_short_terms_and_patterns(spark, seed):
    """Every term against every row of its service, by hand."""
    import re

    from wardlake.operators.reads import service_census
    texts = ["a", "al", "LA", "", "x", "%", "_", "__%", "a%r", "%u_p%", "l_u", "0712", "07%2", "%%%", "zz%a", "é", "\\", "harry s. truman"]
    nurses = {r.id_staff: r.id_service for r in seed.staff.where("role = 'nurse'").collect()}
    asks = [(len(nurses) * i + j, t, n) for i, t in enumerate(texts) for j, n in enumerate(nurses)]
    terms = spark.createDataFrame([*asks, (9999, None, 2)], "term_id long, term string, id_staff long")
    census = [(r.id_service, r.id_stay, r.full_name.lower(), (r.nin or "").lower()) for r in service_census(seed, ordered=False).collect()]
    for wildcards in (False, True):
        def rule(t):
            parts = [{"%": ".*", "_": "."}.get(c, re.escape(c)) if wildcards else re.escape(c) for c in t.lower().replace("é", "e")]
            return re.compile("".join(parts), re.S)
        want = sorted((i, s) for i, t, n in asks for svc, s, name, nin in census if svc == nurses[n] and (rule(t).search(name) or rule(t).search(nin)))
        got = reads.search_patients_batch(seed, terms, wildcards)
        assert sorted((r.term_id, r.id_stay) for r in got.collect()) == want


def test_foreign_key_rule_finds_orphans(spark, seed):
    from wardlake import schemas
    bad_stay = spark.createDataFrame([(99, 42, 5, None, None)], schemas.STAY)
    t = seed.replace(stay=seed.stay.unionByName(bad_stay))
    got = rows(checks.table_violations(t), "table_name", "row_key", "reason")
    assert got == [("stay", "99", "foreign_key:id_patient")]
    bad_room = spark.createDataFrame([(50, 9, 1, 1, True)], schemas.ROOM)
    t = seed.replace(room=seed.room.unionByName(bad_room))
    got = rows(checks.table_violations(t), "table_name", "row_key", "reason")
    assert ("room", "50", "foreign_key:id_service") in got

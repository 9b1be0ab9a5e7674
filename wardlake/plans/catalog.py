"""Registered queries over the driver's tables, each with the equivalent
SQL (DuckDB dialect) on the same tables.

Every query reads whole tables through the stand-in views of
``sources.standin``; request-driven queries take their requests from the
``events`` table.  Output columns carry the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads
from ..sources.standin import STANDIN_AS_OF, read_table, standin_tables, with_standin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _events(spark, sf_dir, kind):
    return read_table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


# Age as whole calendar years, sign dropped (DuckDB form).
def _age_sql(col: str) -> str:
    return (f"CAST(abs(date_part('year', age(CAST(DATE '{STANDIN_AS_OF}' AS TIMESTAMP), "
            f"CAST({col} AS TIMESTAMP)))) AS INTEGER)")


_P = "p.id_patient, p.full_name, p.nin, p.birth_date, p.sex, p.address, p.phone, p.blood_group"
_P_NO_BIRTH = "p.id_patient, p.full_name, p.nin, p.sex, p.address, p.phone, p.blood_group"
_NEWEST_OBS = """newest_obs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT o.*, row_number() OVER (PARTITION BY id_stay ORDER BY observed_at DESC NULLS LAST,
           t_line DESC NULLS LAST, t_part DESC NULLS LAST, t_supp DESC NULLS LAST) AS rn
    FROM observation o) WHERE rn = 1)"""


# ------------------------------------------------------------------ Q1
@register("roster", with_standin("""
SELECT s.id_stay, s.id_patient, p.full_name, p.sex, sv.name AS service_name
FROM stay s JOIN room r ON r.id_room = s.id_room
JOIN service sv ON sv.id_service = r.id_service
JOIN patient p ON p.id_patient = s.id_patient"""))
def q_roster(spark, sf_dir):
    return reads.roster(standin_tables(spark, sf_dir))


# ------------------------------------------------------------------ Q2
@register("patient_card", with_standin(f"""
WITH last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY id_patient ORDER BY id_stay DESC) AS rn FROM stay s)
  WHERE rn = 1)
SELECT {_P_NO_BIRTH}, strftime(p.birth_date, '%Y-%m-%d') AS birth_date, l.id_stay,
       strftime(l.date_in, '%Y-%m-%d') AS date_in, l.date_out, l.id_room, r.room_no,
       sv.name AS service_name, r.id_service, {_age_sql('p.birth_date')} AS age
FROM patient p LEFT JOIN last l ON l.id_patient = p.id_patient
LEFT JOIN room r ON r.id_room = l.id_room LEFT JOIN service sv ON sv.id_service = r.id_service"""))
def q_patient_card(spark, sf_dir):
    return reads.patient_card(standin_tables(spark, sf_dir), STANDIN_AS_OF)


# ------------------------------------------------------------------ Q3
@register("patient_detail", with_standin(f"""
WITH {_NEWEST_OBS},
so AS (SELECT s.id_stay, s.id_patient, s.date_in, s.date_out, s.id_room, o.id_nurse, o.state,
              o.blood_pressure, o.temperature, o.heart_rate, o.observed_at, o.t_line, o.t_part, o.t_supp
       FROM stay s LEFT JOIN newest_obs o ON o.id_stay = s.id_stay WHERE s.date_out IS NULL),
pick AS (SELECT * EXCLUDE (rn) FROM (
  SELECT so.*, row_number() OVER (PARTITION BY id_patient ORDER BY observed_at DESC NULLS LAST,
         t_line DESC NULLS LAST, t_part DESC NULLS LAST, t_supp DESC NULLS LAST,
         date_in DESC NULLS LAST, id_stay DESC) AS rn FROM so) WHERE rn = 1)
SELECT {_P_NO_BIRTH}, strftime(p.birth_date, '%Y-%m-%d') AS birth_date, k.id_stay, k.date_in,
       k.date_out, r.room_no, sv.name AS service_name, k.id_nurse, k.state, k.blood_pressure,
       k.temperature, k.heart_rate, k.observed_at, {_age_sql('p.birth_date')} AS age
FROM patient p LEFT JOIN pick k ON k.id_patient = p.id_patient
LEFT JOIN room r ON r.id_room = k.id_room LEFT JOIN service sv ON sv.id_service = r.id_service"""))
def q_patient_detail(spark, sf_dir):
    return reads.patient_detail(standin_tables(spark, sf_dir), STANDIN_AS_OF)


# ------------------------------------------------------------------ Q4
ADMIN_OVERVIEW_SQL = with_standin(f"""
WITH last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT s.*, row_number() OVER (PARTITION BY id_patient ORDER BY date_in DESC NULLS LAST, id_stay DESC) AS rn
  FROM stay s) WHERE rn = 1)
SELECT {_P}, l.id_stay, l.date_in, l.date_out, l.id_room, r.room_no, r.bed_no, r.id_service,
       sv.name AS service_name, {_age_sql('p.birth_date')} AS age
FROM patient p LEFT JOIN last l ON l.id_patient = p.id_patient
LEFT JOIN room r ON r.id_room = l.id_room LEFT JOIN service sv ON sv.id_service = r.id_service
ORDER BY lower(strip_accents(p.full_name)), p.id_patient""")


@register("admin_overview", ADMIN_OVERVIEW_SQL)
def q_admin_overview(spark, sf_dir):
    return reads.admin_overview(standin_tables(spark, sf_dir), STANDIN_AS_OF)


# ------------------------------------------------------------------ Q5, Q6
_CENSUS_SQL = f"""
WITH {_NEWEST_OBS},
ns AS (SELECT DISTINCT id_service FROM staff WHERE role = 'nurse' AND id_service IS NOT NULL)
SELECT r.id_service, sv.name AS service_name, {_P}, s.id_stay, s.date_in, s.date_out, s.id_room,
       r.room_no, r.bed_no, o.state AS latest_state
FROM stay s JOIN room r ON r.id_room = s.id_room JOIN service sv ON sv.id_service = r.id_service
JOIN patient p ON p.id_patient = s.id_patient LEFT JOIN newest_obs o ON o.id_stay = s.id_stay
WHERE s.date_out IS NULL AND s.id_room IS NOT NULL AND r.id_service IN (SELECT id_service FROM ns)"""


@register("service_census", with_standin(_CENSUS_SQL + "\nORDER BY r.id_service, s.date_in DESC, s.id_stay"))
def q_service_census(spark, sf_dir):
    return reads.service_census(standin_tables(spark, sf_dir))


def _search_sql(term: str) -> str:
    t = term.lower()
    return with_standin(_CENSUS_SQL + f"""
  AND (contains(lower(strip_accents(p.full_name)), '{t}') OR contains(lower(strip_accents(p.nin)), '{t}'))""")


SEARCH_TERM_NIN = "Machin"          # hits national ids, case ignored
SEARCH_TERM_NAME = "CUSTOMER#00000012"  # hits names, case ignored


@register("search_patients", _search_sql(SEARCH_TERM_NIN))
def q_search_patients(spark, sf_dir):
    return reads.search_patients(standin_tables(spark, sf_dir), SEARCH_TERM_NIN)


@register("search_patients_name", _search_sql(SEARCH_TERM_NAME))
def q_search_patients_name(spark, sf_dir):
    return reads.search_patients(standin_tables(spark, sf_dir), SEARCH_TERM_NAME)


@register("service_census_for_staff", with_standin(_CENSUS_SQL.replace(
    "ns AS (SELECT DISTINCT id_service FROM staff WHERE role = 'nurse' AND id_service IS NOT NULL)",
    """ns AS (SELECT DISTINCT id_service FROM staff WHERE role = 'nurse' AND id_service IS NOT NULL
               AND id_staff IN (SELECT user_id FROM events WHERE event_type = 'purchase'))""")))
def q_service_census_for_staff(spark, sf_dir):
    """The census of the services of the nurses named in the requests: one
    row per stay, however many nurses of a service ask."""
    asked = _events(spark, sf_dir, "purchase").select(F.col("user_id").alias("id_staff"))
    return reads.service_census(standin_tables(spark, sf_dir), staff=asked, ordered=False)


# ------------------------------------------------------------------ Q7, Q8
@register("free_rooms", with_standin("""
SELECT id_room, room_no, bed_no, available, id_service FROM room WHERE available"""))
def q_free_rooms(spark, sf_dir):
    return reads.free_rooms(standin_tables(spark, sf_dir))


@register("free_rooms_for_staff", with_standin("""
SELECT r.id_room, r.room_no, r.bed_no, r.available, r.id_service FROM room r
WHERE r.available AND r.id_service IN (
  SELECT id_service FROM staff WHERE id_staff IN (SELECT user_id FROM events WHERE event_type = 'view'))"""))
def q_free_rooms_for_staff(spark, sf_dir):
    asked = _events(spark, sf_dir, "view").select(F.col("user_id").alias("id_staff"))
    return reads.free_rooms_for_staff(standin_tables(spark, sf_dir), asked)


# ------------------------------------------------------------------ Q9, Q10, Q11
@register("stay_prescriptions", with_standin("SELECT * FROM prescription"))
def q_stay_prescriptions(spark, sf_dir):
    return reads.stay_prescriptions(standin_tables(spark, sf_dir))


@register("stay_prescriptions_checked", with_standin("""
SELECT * FROM prescription WHERE id_stay IN (SELECT id_stay FROM stay)"""))
def q_stay_prescriptions_checked(spark, sf_dir):
    return reads.stay_prescriptions_checked(standin_tables(spark, sf_dir))


@register("stay_summary", with_standin("""
WITH obs AS (SELECT o.*, st.full_name AS nurse_name FROM observation o JOIN staff st ON st.id_staff = o.id_nurse),
last AS (SELECT * EXCLUDE (rn) FROM (
  SELECT obs.*, row_number() OVER (PARTITION BY id_stay ORDER BY observed_at DESC NULLS LAST,
         t_line DESC NULLS LAST, t_part DESC NULLS LAST, t_supp DESC NULLS LAST) AS rn FROM obs) WHERE rn = 1)
SELECT s.id_stay, p.drug, p.dose, p.frequency, p.instructions, p.p_line, p.p_part, p.p_supp, p.p_qty,
       l.observed_at AS last_obs_at, l.state AS last_state, l.blood_pressure AS last_blood_pressure,
       l.temperature AS last_temperature, l.heart_rate AS last_heart_rate, l.nurse_name AS last_obs_by
FROM stay s LEFT JOIN prescription p ON p.id_stay = s.id_stay LEFT JOIN last l ON l.id_stay = s.id_stay"""))
def q_stay_summary(spark, sf_dir):
    return reads.stay_summary(standin_tables(spark, sf_dir))


# ------------------------------------------------------------------ Q12 .. Q16
@register("stay_room", with_standin("""
SELECT e.event_id AS request_id, e.event_id AS id_stay, s.id_room
FROM events e LEFT JOIN stay s ON s.id_stay = e.event_id WHERE e.event_type = 'view'"""))
def q_stay_room(spark, sf_dir):
    req = _events(spark, sf_dir, "view").select(F.col("event_id").alias("request_id"),
                                                  F.col("event_id").alias("id_stay"))
    return reads.stay_room(standin_tables(spark, sf_dir), req)


@register("room_service", with_standin("""
SELECT e.event_id AS request_id, e.event_id * 7 % 100 AS id_room, r.id_service
FROM events e LEFT JOIN room r ON r.id_room = e.event_id * 7 % 100 WHERE e.event_type = 'click'"""))
def q_room_service(spark, sf_dir):
    req = _events(spark, sf_dir, "click").select(F.col("event_id").alias("request_id"),
                                                   ((F.col("event_id") * 7) % 100).alias("id_room"))
    return reads.room_service(standin_tables(spark, sf_dir), req)


@register("staff_service", with_standin("""
SELECT e.event_id AS request_id, e.user_id % 100 AS id_staff, st.id_service
FROM events e LEFT JOIN staff st ON st.id_staff = e.user_id % 100 WHERE e.event_type = 'click'"""))
def q_staff_service(spark, sf_dir):
    req = _events(spark, sf_dir, "click").select(F.col("event_id").alias("request_id"),
                                                   (F.col("user_id") % 100).alias("id_staff"))
    return reads.staff_service(standin_tables(spark, sf_dir), req)


@register("current_stay", with_standin("""
SELECT id_patient, date_in, id_stay, id_room FROM (
  SELECT s.*, row_number() OVER (PARTITION BY id_patient ORDER BY date_in DESC NULLS LAST, id_stay DESC) AS rn
  FROM stay s WHERE date_out IS NULL) WHERE rn = 1"""))
def q_current_stay(spark, sf_dir):
    return reads.current_stay(standin_tables(spark, sf_dir))


@register("room_available", with_standin("""
SELECT e.event_id AS request_id, e.event_id % 100 AS id_room, coalesce(r.available, false) AS available
FROM events e LEFT JOIN room r ON r.id_room = e.event_id % 100 WHERE e.event_type = 'signup'"""))
def q_room_available(spark, sf_dir):
    req = _events(spark, sf_dir, "signup").select(F.col("event_id").alias("request_id"),
                                                    (F.col("event_id") % 100).alias("id_room"))
    return reads.room_available(standin_tables(spark, sf_dir), req)


# ------------------------------------------------------------------ C1 .. C7
from ..operators import checks  # noqa: E402

# SQL form of each table's rule list (same rules as checks.default_rules on
# the stand-in tables), written out independently of the DataFrame code.
_RULES_SQL = {
    "service": ("id_service", [("pk", ["id_service"]), ("nn", ["name"]), ("len", "name", 50)]),
    "room": ("id_room", [("pk", ["id_room"]), ("nn", ["id_service", "room_no"]),
                         ("fk", "id_service", "service", "id_service")]),
    "staff": ("id_staff", [("pk", ["id_staff"]), ("nn", ["full_name", "email", "role"]),
                           ("fk", "id_service", "service", "id_service"),
                           ("dom", "role", ["admin", "nurse"]), ("uniq", "email", "id_staff"),
                           ("len", "full_name", 30), ("len", "email", 50)]),
    "patient": ("id_patient", [("pk", ["id_patient"]),
                               ("nn", ["full_name", "nin", "birth_date", "sex", "address", "blood_group"]),
                               ("dom", "sex", ["homme", "famme"]), ("len", "full_name", 30),
                               ("len", "nin", 15), ("len", "address", 100), ("len", "phone", 15),
                               ("len", "blood_group", 3)]),
    "stay": ("id_stay", [("pk", ["id_stay"]), ("nn", ["id_patient"]),
                         ("fk", "id_patient", "patient", "id_patient"), ("fk", "id_room", "room", "id_room")]),
    "prescription": ("id_stay,p_line,p_part,p_supp,p_qty",
                     [("nn", ["id_stay", "drug", "dose", "frequency"]), ("fk", "id_stay", "stay", "id_stay"),
                      ("int", "dose"), ("int", "frequency"), ("len", "drug", 30), ("len", "instructions", 100)]),
    "observation": ("id_stay,t_line,t_part,t_supp",
                    [("pk", ["id_stay", "t_line", "t_part", "t_supp"]),
                     ("nn", ["id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate"]),
                     ("fk", "id_stay", "stay", "id_stay"), ("fk", "id_nurse", "staff", "id_staff"),
                     ("dec", "temperature", 5, 2), ("int", "heart_rate"), ("len", "state", 30), ("len", "blood_pressure", 20)]),
}


def _violation_sql(table: str) -> str:
    key, rules = _RULES_SQL[table]
    joins, cases = [], []
    for i, r in enumerate(rules):
        kind = r[0]
        if kind == "pk":
            ks = r[1]
            on = " AND ".join(f"d{i}.{k} = x.{k}" for k in ks)
            joins.append(f"LEFT JOIN (SELECT {', '.join(ks)}, true AS d FROM {table} "
                         f"GROUP BY {', '.join(ks)} HAVING count(*) > 1) d{i} ON {on}")
            nul = " OR ".join(f"x.{k} IS NULL" for k in ks)
            cases.append((f"d{i}.d IS NOT NULL OR {nul}", f"primary_key:{','.join(ks)}"))
        elif kind == "nn":
            cases.append((" OR ".join(f"x.{c} IS NULL" for c in r[1]), f"not_null:{','.join(r[1])}"))
        elif kind == "fk":
            _, col, parent, pcol = r
            cases.append((f"x.{col} IS NOT NULL AND x.{col} NOT IN "
                          f"(SELECT {pcol} FROM {parent} WHERE {pcol} IS NOT NULL)", f"foreign_key:{col}"))
        elif kind == "dom":
            vals = ", ".join(f"'{v}'" for v in r[2])
            cases.append((f"x.{r[1]} IS NOT NULL AND x.{r[1]} NOT IN ({vals})", f"domain:{r[1]}"))
        elif kind == "uniq":
            _, col, order = r
            cases.append((f"EXISTS (SELECT 1 FROM {table} y WHERE lower(y.{col}) = lower(x.{col}) "
                          f"AND y.{order} < x.{order})", f"unique:{col}"))
        elif kind == "len":
            cases.append((f"coalesce(length(x.{r[1]}) > {r[2]}, false)", f"max_length:{r[1]}"))
        elif kind == "dec":
            _, col, p, s = r
            cases.append((f"x.{col} IS NOT NULL AND TRY_CAST(CAST(x.{col} AS VARCHAR) AS DECIMAL({p},{s})) IS NULL",
                          f"decimal_range:{col}"))
        elif kind == "int":
            cases.append((f"x.{r[1]} IS NOT NULL AND TRY_CAST(CAST(x.{r[1]} AS VARCHAR) AS INTEGER) IS NULL",
                          f"int_range:{r[1]}"))
    reason = "coalesce(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in cases) + ")"
    row_key = "concat_ws('/', " + ", ".join(f"CAST(x.{k} AS VARCHAR)" for k in key.split(",")) + ")"
    return (f"SELECT * FROM (SELECT '{table}' AS table_name, {row_key} AS row_key, {reason} AS reason "
            f"FROM {table} x {' '.join(joins)}) WHERE reason IS NOT NULL")


@register("table_violations", with_standin("\nUNION ALL\n".join(_violation_sql(t) for t in _RULES_SQL)))
def q_table_violations(spark, sf_dir):
    return checks.table_violations(standin_tables(spark, sf_dir))


@register("observation_key_check", with_standin("""
SELECT o.id_stay, o.t_line, o.t_part, o.t_supp, 'primary_key:id_stay,t_line' AS reason
FROM observation o JOIN (SELECT id_stay, t_line FROM observation GROUP BY 1, 2 HAVING count(*) > 1) d
  ON d.id_stay = o.id_stay AND d.t_line = o.t_line"""))
def q_observation_key_check(spark, sf_dir):
    obs = standin_tables(spark, sf_dir).observation.select("id_stay", "t_line", "t_part", "t_supp")
    _, bad = checks.violations(obs, [checks.primary_key("id_stay", "t_line")])
    return bad


@register("bed_flag_mismatches", with_standin("""
SELECT r.id_room, r.available, CAST(count(s.id_stay) AS BIGINT) AS active_stays
FROM room r LEFT JOIN stay s ON s.id_room = r.id_room AND s.date_out IS NULL
GROUP BY r.id_room, r.available
HAVING (coalesce(r.available, false) AND count(s.id_stay) > 0)
    OR (NOT coalesce(r.available, false) AND count(s.id_stay) = 0)"""))
def q_bed_flag_mismatches(spark, sf_dir):
    return checks.bed_flag_mismatches(standin_tables(spark, sf_dir))


# ------------------------------------------------------------------ M2, M4, M7, M9
from ..operators import changes  # noqa: E402
from ..sources import requests as rq  # noqa: E402

BATCH_TS = "2024-02-01 00:00:00"  # fixed "now" of the registered change batches

_EMPTY = "coalesce(trim({0}) IN ('', '0'), true)"
_DATE_SHAPE = "^[0-9]{4}-[0-9][0-9]-[0-9][0-9]$"

_ADMIT_SQL = f"""
WITH req AS (SELECT event_id AS request_id, ts AS requested_at, CAST(user_id AS VARCHAR) AS id_patient_t,
                    CAST(event_id % 100 AS VARCHAR) AS id_room_t, strftime(ts, '%Y-%m-%d') AS date_t
             FROM events WHERE event_type = 'signup'),
r AS (SELECT req.*, TRY_CAST(trim(id_patient_t) AS BIGINT) AS id_patient,
             CASE WHEN {_EMPTY.format('id_room_t')} THEN NULL ELSE TRY_CAST(trim(id_room_t) AS BIGINT) END AS bed
      FROM req),
c AS (SELECT r.*, CASE
        WHEN NOT coalesce(TRY_CAST(trim(r.id_patient_t) AS BIGINT) > 0, false) THEN 'invalid: id_patient'
        WHEN r.id_room_t IS NULL THEN 'missing: id_room'
        WHEN NOT coalesce(regexp_matches(r.date_t, '{_DATE_SHAPE}')
                          AND try_strptime(r.date_t, '%Y-%m-%d') IS NOT NULL, false) THEN 'invalid: date_in'
        WHEN p.id_patient IS NULL THEN 'unknown patient'
        WHEN r.id_patient IN (SELECT id_patient FROM stay WHERE date_out IS NULL AND id_patient IS NOT NULL)
          THEN 'already active'
        WHEN r.bed IS NOT NULL AND b.id_room IS NULL THEN 'unknown bed'
        WHEN r.bed IS NOT NULL AND NOT coalesce(b.available, false) THEN 'bed not free'
      END AS reason
      FROM r LEFT JOIN patient p ON p.id_patient = r.id_patient LEFT JOIN room b ON b.id_room = r.bed),
w AS (SELECT c.*, row_number() OVER (PARTITION BY id_patient ORDER BY requested_at NULLS FIRST, request_id) AS rp,
             CASE WHEN bed IS NULL THEN 1 ELSE
               row_number() OVER (PARTITION BY bed ORDER BY requested_at NULLS FIRST, request_id) END AS rb
      FROM c WHERE reason IS NULL),
acc AS (SELECT (SELECT max(id_stay) FROM stay) + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id)
               AS id_stay, request_id, id_patient, bed AS id_room,
               CAST(strptime(date_t, '%Y-%m-%d') AS TIMESTAMP) AS date_in, CAST(NULL AS TIMESTAMP) AS date_out
        FROM w WHERE rp = 1 AND rb = 1)
"""


# The source system's own behaviour: neither the bed nor an active stay is checked.
_ADMIT_LENIENT_SQL = _ADMIT_SQL
for _line in ("""        WHEN r.id_patient IN (SELECT id_patient FROM stay WHERE date_out IS NULL AND id_patient IS NOT NULL)
          THEN 'already active'
""", """        WHEN r.bed IS NOT NULL AND NOT coalesce(b.available, false) THEN 'bed not free'
"""):
    _ADMIT_LENIENT_SQL = _ADMIT_LENIENT_SQL.replace(_line, "")


def _admit(spark, sf_dir, check_free=True):
    return changes.admit_existing(standin_tables(spark, sf_dir), rq.admission_requests(spark, sf_dir), check_free)


@register("admit_existing_rejects", with_standin(_ADMIT_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'conflict' FROM w WHERE rp > 1 OR rb > 1"""))
def q_admit_rejects(spark, sf_dir):
    return _admit(spark, sf_dir).rejects


@register("admit_existing_new_stays", with_standin(_ADMIT_LENIENT_SQL + "SELECT * FROM acc"))
def q_admit_new_stays(spark, sf_dir):
    return _admit(spark, sf_dir, check_free=False).accepted


@register("admit_existing_rooms", with_standin(_ADMIT_LENIENT_SQL + """
SELECT id_room, id_service, room_no, bed_no,
       CASE WHEN id_room IN (SELECT id_room FROM acc WHERE id_room IS NOT NULL) THEN false ELSE available END
       AS available
FROM room"""))
def q_admit_rooms(spark, sf_dir):
    return _admit(spark, sf_dir, check_free=False).tables.room


_DISCHARGE_SQL = f"""
WITH active AS (SELECT * FROM stay WHERE date_out IS NULL),
per AS (SELECT id_patient, max(date_in) AS last_in FROM active GROUP BY id_patient),
req AS (SELECT event_id AS request_id, ts AS requested_at, user_id AS id_patient,
               coalesce(TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP),
                        TIMESTAMP '{BATCH_TS}') AS new_out
        FROM events WHERE event_type = 'purchase'),
r AS (SELECT req.*, CASE WHEN per.id_patient IS NULL THEN 'no active stay'
                         WHEN new_out < last_in THEN 'end before entry' END AS reason
      FROM req LEFT JOIN per ON per.id_patient = req.id_patient),
w AS (SELECT r.*, row_number() OVER (PARTITION BY id_patient ORDER BY requested_at NULLS FIRST, request_id) AS rk
      FROM r WHERE reason IS NULL),
done AS (SELECT a.id_stay, w.new_out FROM w JOIN active a ON a.id_patient = w.id_patient WHERE rk = 1)
"""


def _discharge(spark, sf_dir):
    return changes.discharge_by_patient(standin_tables(spark, sf_dir), rq.discharge_requests(spark, sf_dir),
                                        BATCH_TS)


@register("discharge_by_patient_stays", with_standin(_DISCHARGE_SQL + """
SELECT s.id_stay, s.id_patient, CASE WHEN d.id_stay IS NOT NULL THEN NULL ELSE s.id_room END AS id_room,
       s.date_in, CASE WHEN d.id_stay IS NOT NULL THEN d.new_out ELSE s.date_out END AS date_out
FROM stay s LEFT JOIN done d ON d.id_stay = s.id_stay"""))
def q_discharge_stays(spark, sf_dir):
    return _discharge(spark, sf_dir).tables.stay


@register("discharge_by_patient_rejects", with_standin(_DISCHARGE_SQL + """
SELECT request_id, reason FROM r WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'conflict' FROM w WHERE rk > 1"""))
def q_discharge_rejects(spark, sf_dir):
    return _discharge(spark, sf_dir).rejects


_TRANSFER_SQL = f"""
WITH req AS (SELECT event_id AS request_id, ts AS requested_at, CAST(event_id AS VARCHAR) AS id_stay_t,
                    CAST(event_id * 7 % 100 AS VARCHAR) AS id_room_t, CAST(user_id % 100 AS VARCHAR) AS id_staff_t
             FROM events WHERE event_type = 'click'),
r AS (SELECT req.*, TRY_CAST(id_stay_t AS BIGINT) AS id_stay, TRY_CAST(id_room_t AS BIGINT) AS bed,
             TRY_CAST(id_staff_t AS BIGINT) AS id_staff FROM req),
c AS (SELECT r.*, s.id_room AS old_bed, CASE
        WHEN {_EMPTY.format('r.id_stay_t')} OR {_EMPTY.format('r.id_staff_t')} OR r.id_room_t IS NULL
          THEN 'missing: field'
        WHEN st.id_service IS NULL THEN 'unknown staff service'
        WHEN b.id_room IS NULL THEN 'unknown bed'
        WHEN st.id_service <> b.id_service THEN 'service mismatch'
        WHEN s.id_stay IS NULL THEN 'unknown stay'
        WHEN s.date_out IS NOT NULL THEN 'not active'
        WHEN NOT coalesce(b.available, false) AND NOT coalesce(s.id_room = r.bed, false) THEN 'bed not free'
      END AS reason
      FROM r LEFT JOIN staff st ON st.id_staff = r.id_staff LEFT JOIN room b ON b.id_room = r.bed
      LEFT JOIN stay s ON s.id_stay = r.id_stay),
w AS (SELECT c.*, row_number() OVER (PARTITION BY id_stay ORDER BY requested_at NULLS FIRST, request_id) AS rs,
             row_number() OVER (PARTITION BY bed ORDER BY requested_at NULLS FIRST, request_id) AS rb
      FROM c WHERE reason IS NULL),
mv AS (SELECT * FROM w WHERE rs = 1 AND rb = 1),
chg AS (SELECT old_bed AS id_room, true AS available FROM mv WHERE old_bed IS NOT NULL AND old_bed <> bed
        UNION ALL SELECT bed, false FROM mv),
per_bed AS (SELECT id_room, bool_and(available) AS available FROM chg GROUP BY id_room)
"""


def _transfer(spark, sf_dir):
    return changes.transfer(standin_tables(spark, sf_dir), rq.transfer_requests(spark, sf_dir))


@register("transfer_rejects", with_standin(_TRANSFER_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'conflict' FROM w WHERE rs > 1 OR rb > 1"""))
def q_transfer_rejects(spark, sf_dir):
    return _transfer(spark, sf_dir).rejects


@register("transfer_rooms", with_standin(_TRANSFER_SQL + """
SELECT r.id_room, r.id_service, r.room_no, r.bed_no, coalesce(p.available, r.available) AS available
FROM room r LEFT JOIN per_bed p ON p.id_room = r.id_room"""))
def q_transfer_rooms(spark, sf_dir):
    return _transfer(spark, sf_dir).tables.room


def _clean_sql(c: str) -> str:
    quoted = r""""[^"]*(?:"|\z)|''[^'']*(?:''|\z)"""
    s = (f"regexp_replace({c}, '(?s)<!--(?:-?>|.*?(?:-->|\\z))|<(?:{quoted}|[^>\"''[:space:]])(?:{quoted}|[^>\"''])*(?:>|\\z)|<>', "
         "'', 'g')")
    for raw, esc in (("&", "&amp;"), ('"', "&quot;"), ("''", "&#039;"), ("<", "&lt;"), (">", "&gt;")):
        s = f"replace({s}, '{raw}', '{esc}')"
    return s


_OBS_SQL = f"""
WITH req AS (
  SELECT event_id AS request_id, ts AS requested_at, CAST(event_id AS VARCHAR) AS id_stay_t,
         CAST(user_id AS VARCHAR) AS id_nurse_t, '<b>' || props || '</b>' AS state_t,
         CAST(value AS VARCHAR) AS temp_t, CAST(event_id % 60 + 50 AS VARCHAR) AS hr_t,
         CAST(event_id % 10 + 90 AS VARCHAR) AS spo2_t, CAST(value AS VARCHAR) AS weight_t,
         CASE WHEN event_id % 2 = 1 THEN CAST(CAST(value * 10 AS DECIMAL(10,1)) AS VARCHAR) || 'cm'
              ELSE CAST(CAST(value * 10 AS DECIMAL(10,1)) AS VARCHAR) END AS height_t,
         'note <i>' || event_type || '</i> & "ok"' AS remark_t,
         strftime(ts, '%Y-%m-%dT%H:%M') AS at_t
  FROM events WHERE event_type = 'view'),
cl AS (
  SELECT request_id, requested_at,
         TRY_CAST(trim({_clean_sql('id_stay_t')}) AS BIGINT) AS id_stay,
         TRY_CAST(trim({_clean_sql('id_nurse_t')}) AS BIGINT) AS id_nurse,
         {_clean_sql('state_t')} AS state, {_clean_sql("'120/80'")} AS blood_pressure,
         {_clean_sql('remark_t')} AS remark,
         TRY_CAST({_clean_sql('temp_t')} AS DECIMAL(5,2)) AS temperature, temp_t,
         TRY_CAST(trim({_clean_sql('hr_t')}) AS INTEGER) AS heart_rate,
         TRY_CAST(trim({_clean_sql('spo2_t')}) AS INTEGER) AS spo2,
         TRY_CAST({_clean_sql("'5.5'")} AS DECIMAL(3,1)) AS glucose,
         TRY_CAST({_clean_sql('weight_t')} AS DECIMAL(5,2)) AS weight, weight_t,
         CASE WHEN regexp_extract(trim(height_t), '^[+-]?[0-9]*\\.?[0-9]+', 0) <> ''
              THEN TRY_CAST(regexp_extract(trim(height_t), '^[+-]?[0-9]*\\.?[0-9]+', 0) AS DECIMAL(38,10))
         END AS cm,
         coalesce(TRY_CAST(at_t AS TIMESTAMP), TIMESTAMP '{BATCH_TS}') AS observed_at
  FROM req),
c AS (
  SELECT cl.*, CASE WHEN cm > 0 THEN TRY_CAST(round(cm * 0.01, 2) AS DECIMAL(4,2)) ELSE 0.00 END AS height,
         CASE
           WHEN temperature IS NULL AND temp_t IS NOT NULL THEN 'out of range: temperature'
           WHEN weight IS NULL AND weight_t IS NOT NULL THEN 'out of range: weight'
           WHEN cm * 0.01 >= 99.995 THEN 'out of range: height'
           WHEN id_stay IS NULL OR id_nurse IS NULL OR state IS NULL OR blood_pressure IS NULL
                OR temperature IS NULL OR heart_rate IS NULL OR spo2 IS NULL OR glucose IS NULL
                OR weight IS NULL OR remark IS NULL THEN 'missing value'
           WHEN id_stay NOT IN (SELECT id_stay FROM stay) THEN 'unknown stay'
           WHEN id_nurse NOT IN (SELECT id_staff FROM staff) THEN 'unknown nurse'
           WHEN length(state) > 30 THEN 'too long: state'
           WHEN length(blood_pressure) > 20 THEN 'too long: blood_pressure'
         END AS reason
  FROM cl)
"""


def _ingest(spark, sf_dir):
    return changes.ingest_observations(standin_tables(spark, sf_dir), rq.observation_requests(spark, sf_dir),
                                       BATCH_TS)


@register("ingest_observations_accepted", with_standin(_OBS_SQL + """
SELECT request_id, row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS id_obs, id_stay, id_nurse,
       state, blood_pressure, CAST(temperature AS DOUBLE) AS temperature, heart_rate, spo2,
       CAST(glucose AS DOUBLE) AS glucose, CAST(weight AS DOUBLE) AS weight, CAST(height AS DOUBLE) AS height,
       remark, observed_at
FROM c WHERE reason IS NULL"""))
def q_ingest_accepted(spark, sf_dir):
    acc = _ingest(spark, sf_dir).accepted
    return acc.select(*[F.col(c).cast("double").alias(c) if c in ("temperature", "glucose", "weight", "height")
                        else F.col(c) for c in acc.columns])


@register("ingest_observations_rejects", with_standin(_OBS_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL"""))
def q_ingest_rejects(spark, sf_dir):
    return _ingest(spark, sf_dir).rejects


# ------------------------------------------------------------------ X6, X7 on whole texts
from ..functions.cleaning import clean_text  # noqa: E402


_clean_text_sql = _clean_sql


@register("clean_pages", f"SELECT page_id, {_clean_text_sql('html')} AS text FROM pages")
def q_clean_pages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", clean_text("html").alias("text"))


@register("clean_documents", f"SELECT doc_id, {_clean_text_sql('text')} AS text FROM documents")
def q_clean_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_text("text").alias("text"))


# ------------------------------------------------------------------ ST2
from ..streaming import observations as st  # noqa: E402


FEED_BATCHES = 7
FEED_FILE_ROWS = 250_000  # rows of a file of the feed, about


@register("stream_newest_observation", with_standin(f"WITH {_NEWEST_OBS} SELECT * FROM newest_obs"))
def q_stream_newest_observation(spark, sf_dir):
    """The newest observation per stay computed by the streaming operator
    over the observation feed (lineitem as a file stream of seven
    micro-batches)."""
    import uuid

    from ..session import checkpoint_dir
    root = f"{checkpoint_dir(spark).rstrip('/')}/newest-obs-{uuid.uuid4().hex}"
    # files in an order that has nothing to do with time, a seventh of them a micro-batch, merged after three
    # with the columns that an observation has
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    files = max(1, -(-lines.count() // (FEED_BATCHES * FEED_FILE_ROWS)))
    lines.repartition(FEED_BATCHES * files, "l_partkey").write.parquet(f"{root}/in")
    feed = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    obs = feed.select(F.col("l_orderkey").alias("id_stay"), F.col("l_suppkey").alias("id_nurse"),
                      F.col("l_returnflag").alias("state"), F.col("l_linestatus").alias("blood_pressure"),
                      F.col("l_quantity").alias("temperature"), F.col("l_linenumber").alias("heart_rate"),
                      F.col("l_shipdate").alias("observed_at"), F.col("l_linenumber").alias("t_line"),
                      F.col("l_partkey").alias("t_part"), F.col("l_suppkey").alias("t_supp"))
    ties = ("t_line", "t_part", "t_supp")
    st.start_newest_observation(spark, obs, f"{root}/out", f"{root}/state", ties, merge_after=3).awaitTermination()
    return st.read_newest_observation(spark, f"{root}/out", ties)


# ------------------------------------------------------------------ Q6 batch form
def _search_terms(spark, sf_dir):
    """``click`` events ask nurse ``user_id % 100`` for the patient whose
    name ends in the user id (``#000000123``)."""
    ev = _events(spark, sf_dir, "click")
    return ev.select(F.col("event_id").alias("term_id"),
                     F.concat(F.lit("#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("term"),
                     (F.col("user_id") % 100).alias("id_staff"))


@register("search_patients_batch", with_standin(_CENSUS_SQL.replace(
    "WHERE s.date_out IS NULL",
    """JOIN (SELECT e.event_id AS term_id, '#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0') AS term,
                e.user_id % 100 AS id_staff, st.id_service AS term_service
         FROM events e JOIN staff st ON st.id_staff = e.user_id % 100
         WHERE e.event_type = 'click' AND st.role = 'nurse' AND st.id_service IS NOT NULL) q
      ON q.term_service = r.id_service
         AND (contains(lower(strip_accents(p.full_name)), lower(q.term))
              OR contains(lower(strip_accents(p.nin)), lower(q.term)))
WHERE s.date_out IS NULL""").replace(
    "SELECT r.id_service, sv.name AS service_name",
    "SELECT q.term_id, q.id_staff, r.id_service, sv.name AS service_name", 1)))
def q_search_patients_batch(spark, sf_dir):
    return reads.search_patients_batch(standin_tables(spark, sf_dir), _search_terms(spark, sf_dir))


# ------------------------------------------------------------------ M8
_AVAIL_SQL = """
WITH req AS (SELECT event_id AS request_id, ts AS requested_at, event_id % 100 AS id_room,
                    CASE WHEN value > 25 THEN true ELSE false END AS flag
             FROM events WHERE event_type = 'error'),
last AS (SELECT * FROM (
  SELECT req.*, row_number() OVER (PARTITION BY id_room ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS rn
  FROM req WHERE id_room IN (SELECT id_room FROM room)) WHERE rn = 1)
"""


def _availability(spark, sf_dir):
    return changes.set_availability(standin_tables(spark, sf_dir), rq.availability_requests(spark, sf_dir))


@register("set_availability_rooms", with_standin(_AVAIL_SQL + """
SELECT r.id_room, r.id_service, r.room_no, r.bed_no, coalesce(l.flag, r.available) AS available
FROM room r LEFT JOIN last l ON l.id_room = r.id_room"""))
def q_set_availability_rooms(spark, sf_dir):
    return _availability(spark, sf_dir).tables.room


@register("set_availability_rejects", with_standin(_AVAIL_SQL + """
SELECT request_id, 'unknown bed' AS reason FROM req WHERE id_room NOT IN (SELECT id_room FROM room)
UNION ALL SELECT request_id, 'superseded' FROM req
WHERE id_room IN (SELECT id_room FROM room) AND request_id NOT IN (SELECT request_id FROM last)"""))
def q_set_availability_rejects(spark, sf_dir):
    return _availability(spark, sf_dir).rejects


# ------------------------------------------------------------------ M12
_STAFF_SQL = """
WITH req AS (
  SELECT event_id AS request_id, ts AS requested_at, CAST(user_id % 30 AS VARCHAR) AS svc_t,
         'Nurse ' || CAST(user_id AS VARCHAR) AS full_name,
         CASE WHEN event_id % 50 = 0 THEN 'SUPPLIER.' || lpad(CAST(user_id % 100 AS VARCHAR), 9, '0') || '@ward.test'
              ELSE 'n' || CAST(event_id % 700 AS VARCHAR) || '@Ward.test' END AS email,
         CASE event_id % 4 WHEN 0 THEN 'Nurse' WHEN 1 THEN 'admin' WHEN 2 THEN 'nurse' ELSE 'doctor' END AS role_t
  FROM events WHERE event_type = 'signup'),
r AS (SELECT req.*, TRY_CAST(trim(svc_t) AS BIGINT) AS id_service, lower(trim(role_t)) AS role,
             lower(email) AS lemail FROM req),
c AS (SELECT r.*, CASE
        WHEN r.role IS NULL OR r.role NOT IN ('admin', 'nurse') THEN 'unknown role'
        WHEN r.role = 'nurse' AND r.id_service IS NULL THEN 'missing: id_service'
        WHEN r.id_service IS NOT NULL AND r.id_service NOT IN (SELECT id_service FROM service) THEN 'unknown service'
        WHEN r.full_name IS NULL OR r.email IS NULL THEN 'missing value'
        WHEN length(r.full_name) > 30 THEN 'too long: full_name'
        WHEN length(r.email) > 50 THEN 'too long: email'
        WHEN r.lemail IN (SELECT lower(email) FROM staff) THEN 'duplicate email'
      END AS reason FROM r),
w AS (SELECT c.*, row_number() OVER (PARTITION BY lemail ORDER BY requested_at NULLS FIRST, request_id) AS rk
      FROM c WHERE reason IS NULL)
"""


def _load_staff(spark, sf_dir):
    return changes.load_staff(standin_tables(spark, sf_dir), rq.staff_requests(spark, sf_dir))


@register("load_staff_rejects", with_standin(_STAFF_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'duplicate email' FROM w WHERE rk > 1"""))
def q_load_staff_rejects(spark, sf_dir):
    return _load_staff(spark, sf_dir).rejects


@register("load_staff_new", with_standin(_STAFF_SQL + """
SELECT request_id, (SELECT max(id_staff) FROM staff)
       + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS id_staff
FROM w WHERE rk = 1"""))
def q_load_staff_new(spark, sf_dir):
    return _load_staff(spark, sf_dir).accepted


# ------------------------------------------------------------------ M5 + M6 (status route)
# One request after the other, in order: the maps hold the stays and beds that a request has changed.
def _status_sql(stay_of: str, result: str) -> str:
    return with_standin(f"""
WITH RECURSIVE req AS (
  SELECT event_id AS request_id, ts AS requested_at, {stay_of} AS id_stay,
         CASE WHEN value > 25 THEN 'reactivate' ELSE 'discharge' END AS action, event_id % 100 AS bed,
         coalesce(TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP), TIMESTAMP '{BATCH_TS}') AS new_out
  FROM events WHERE event_type = 'purchase'),
q AS (SELECT req.*, row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS n, s.id_stay IS NOT NULL AS known,
             s.date_in, struct_pack(id_room := s.id_room, date_out := s.date_out) AS s0, r.id_room IS NOT NULL AS bed_known,
             coalesce(r.available, false) AS b0
      FROM req LEFT JOIN stay s ON s.id_stay = req.id_stay LEFT JOIN room r ON r.id_room = req.bed),
met AS (SELECT 1 AS n, MAP {{}}::MAP(BIGINT, STRUCT(id_room BIGINT, date_out TIMESTAMP)) AS stays, MAP {{}}::MAP(BIGINT, BOOLEAN) AS beds),
step(n, stays, beds, request_id, reason) AS (
  SELECT 0, stays, beds, NULL::BIGINT, NULL::VARCHAR FROM met
  UNION ALL
  SELECT n, CASE WHEN reason IS NOT NULL THEN stays
                 WHEN action = 'discharge' THEN map_concat(stays, MAP {{id_stay: struct_pack(id_room := NULL::BIGINT, date_out := new_out)}})
                 ELSE map_concat(stays, MAP {{id_stay: struct_pack(id_room := bed, date_out := NULL::TIMESTAMP)}}) END,
         CASE WHEN reason IS NOT NULL OR action = 'discharge' AND s.id_room IS NULL THEN beds
              WHEN action = 'discharge' THEN map_concat(beds, MAP {{s.id_room: true}})
              ELSE map_concat(beds, MAP {{bed: false}}) END, request_id, reason
  FROM (SELECT *, CASE
          WHEN id_stay = 0 THEN 'invalid: id_stay'
          WHEN action = 'reactivate' AND bed = 0 THEN 'invalid: id_room'
          WHEN action = 'reactivate' AND NOT bed_known THEN 'unknown bed'
          WHEN action = 'reactivate' AND NOT coalesce(beds[bed], b0) THEN 'bed not free'
          WHEN NOT known THEN 'unknown stay'
          WHEN action = 'reactivate' AND s.date_out IS NULL THEN 'already active'
          WHEN action = 'discharge' AND s.date_out IS NOT NULL THEN 'not active'
          WHEN action = 'discharge' AND new_out < date_in THEN 'end before entry' END AS reason
        FROM (SELECT q.*, p.stays, p.beds, CASE WHEN map_contains(p.stays, q.id_stay) THEN p.stays[q.id_stay] ELSE q.s0 END AS s
              FROM step p JOIN q ON q.n = p.n + 1))),
fin AS (SELECT * FROM step ORDER BY n DESC LIMIT 1),
new_stay AS (SELECT unnest(map_keys(stays)) AS id_stay, unnest(map_values(stays)) AS s FROM fin),
new_bed AS (SELECT unnest(map_keys(beds)) AS id_room, unnest(map_values(beds)) AS free FROM fin)
{result}""")


_STATUS_RESULTS = {
    "stays": """SELECT s.id_stay, s.id_patient, CASE WHEN n.id_stay IS NULL THEN s.id_room ELSE n.s.id_room END AS id_room,
  s.date_in, CASE WHEN n.id_stay IS NULL THEN s.date_out ELSE n.s.date_out END AS date_out
FROM stay s LEFT JOIN new_stay n ON n.id_stay = s.id_stay""",
    "rooms": """SELECT r.id_room, r.id_service, r.room_no, r.bed_no, coalesce(n.free, r.available) AS available
FROM room r LEFT JOIN new_bed n ON n.id_room = r.id_room""",
    "rejects": "SELECT request_id, reason FROM step WHERE reason IS NOT NULL",
}


def _register_status(prefix: str, stay_of: str, repeated: bool) -> None:
    pick = {"stays": lambda r: r.tables.stay, "rooms": lambda r: r.tables.room, "rejects": lambda r: r.rejects}
    for part, result in _STATUS_RESULTS.items():
        def query(spark, sf_dir, part=part):
            asked = rq.status_requests(spark, sf_dir, repeated)
            return pick[part](changes.apply_status(standin_tables(spark, sf_dir), asked, BATCH_TS))
        register(f"{prefix}_{part}", _status_sql(stay_of, result))(query)


_register_status("apply_status", "event_id", False)
_register_status("apply_status_repeated", "event_id % 50", True)  # a stay is named again and again


# ------------------------------------------------------------------ M1
_ADMIT_NEW_SQL = f"""
WITH req AS (
  SELECT event_id AS request_id, ts AS requested_at, 'Patient ' || CAST(user_id AS VARCHAR) AS full_name,
         lpad(CAST(event_id AS VARCHAR), 9, '0') AS nin,
         '19' || lpad(CAST(event_id % 50 + 50 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0')
              || '-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') AS birth_t,
         CASE event_id % 3 WHEN 0 THEN 'homme' WHEN 1 THEN 'famme' ELSE 'autre' END AS sex,
         event_id % 100 AS bed,
         coalesce(TRY_CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP), TIMESTAMP '{BATCH_TS}') AS date_in
  FROM events WHERE event_type = 'signup'),
c AS (SELECT q.*, CASE
        WHEN NOT coalesce(regexp_matches(q.birth_t, '{_DATE_SHAPE}')
                          AND try_strptime(q.birth_t, '%Y-%m-%d') IS NOT NULL, false) THEN 'invalid: birth_date'
        WHEN q.sex NOT IN ('homme', 'famme') THEN 'invalid: sex'
        WHEN NOT coalesce(q.bed > 0, false) THEN 'invalid: id_room'
        WHEN b.id_room IS NULL OR NOT coalesce(b.available, false) THEN 'bed not free' END AS reason
      FROM req q LEFT JOIN room b ON b.id_room = q.bed),
w AS (SELECT c.*, row_number() OVER (PARTITION BY bed ORDER BY requested_at NULLS FIRST, request_id) AS rb
      FROM c WHERE reason IS NULL),
acc AS (SELECT w.*, row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS n FROM w WHERE rb = 1)
"""


def _admit_new(spark, sf_dir):
    return changes.admit_new(standin_tables(spark, sf_dir), rq.new_patient_requests(spark, sf_dir), BATCH_TS)


@register("admit_new_accepted", with_standin(_ADMIT_NEW_SQL + """
SELECT request_id, (SELECT max(id_patient) FROM patient) + n AS id_patient, (SELECT max(id_stay) FROM stay) + n AS id_stay,
       full_name, nin, bed AS id_room, date_in
FROM acc"""))
def q_admit_new_accepted(spark, sf_dir):
    return _admit_new(spark, sf_dir).accepted.select("request_id", "id_patient", "id_stay", "full_name", "nin",
                                                      "id_room", "date_in")


@register("admit_new_rejects", with_standin(_ADMIT_NEW_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'conflict' FROM w WHERE rb > 1"""))
def q_admit_new_rejects(spark, sf_dir):
    return _admit_new(spark, sf_dir).rejects


# ------------------------------------------------------------------ M3
_UPDATE_SQL = f"""
WITH cur AS (SELECT id_patient, id_stay, id_room FROM (
    SELECT s.*, row_number() OVER (PARTITION BY id_patient ORDER BY date_in DESC NULLS LAST, id_stay DESC) AS rn
    FROM stay s WHERE date_out IS NULL) WHERE rn = 1),
req AS (
  SELECT event_id AS request_id, ts AS requested_at, user_id AS id_patient,
         'Updated ' || CAST(user_id AS VARCHAR) AS full_name, lpad(CAST(event_id AS VARCHAR), 9, '0') AS nin,
         '1980-01-01' AS birth_t, 'homme' AS sex, 'New address' AS address, CAST(NULL AS VARCHAR) AS phone,
         'A+' AS blood_group,
         CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 100 AS VARCHAR) END AS room_t,
         CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS adm_t
  FROM events WHERE event_type = 'click'),
r AS (SELECT req.*, NOT {_EMPTY.format('room_t')} AS wants_bed, TRY_CAST(trim(room_t) AS BIGINT) AS bed FROM req),
c AS (SELECT r.*, cur.id_stay AS cur_stay, cur.id_room AS old_bed, CASE
        WHEN p.id_patient IS NULL THEN 'unknown patient'
        WHEN NOT coalesce(regexp_matches(r.birth_t, '{_DATE_SHAPE}')
                          AND try_strptime(r.birth_t, '%Y-%m-%d') IS NOT NULL, false) THEN 'invalid: birth_date'
        WHEN r.sex NOT IN ('homme', 'famme') THEN 'invalid: sex'
        WHEN r.wants_bed AND b.id_room IS NULL THEN 'unknown bed'
        WHEN r.wants_bed AND NOT coalesce(b.available, false) AND NOT coalesce(cur.id_room = r.bed, false)
          THEN 'bed not free'
        WHEN r.wants_bed AND cur.id_stay IS NULL AND {_EMPTY.format('r.adm_t')}
          THEN 'no active stay and no admission date'
      END AS reason
      FROM r LEFT JOIN patient p ON p.id_patient = r.id_patient LEFT JOIN room b ON b.id_room = r.bed
      LEFT JOIN cur ON cur.id_patient = r.id_patient),
w AS (SELECT c.*, row_number() OVER (PARTITION BY id_patient ORDER BY requested_at NULLS FIRST, request_id) AS rp,
             CASE WHEN wants_bed THEN row_number() OVER (PARTITION BY wants_bed, bed
                                                         ORDER BY requested_at NULLS FIRST, request_id)
                  ELSE 1 END AS rb
      FROM c WHERE reason IS NULL),
win AS (SELECT * FROM w WHERE rp = 1 AND rb = 1),
mv AS (SELECT * FROM win WHERE wants_bed AND cur_stay IS NOT NULL),
op AS (SELECT win.*, (SELECT max(id_stay) FROM stay) + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id)
              AS new_stay FROM win WHERE wants_bed AND cur_stay IS NULL)
"""


def _update(spark, sf_dir):
    return changes.update_patient(standin_tables(spark, sf_dir), rq.patient_update_requests(spark, sf_dir), BATCH_TS)


@register("update_patient_stays", with_standin(_UPDATE_SQL + f"""
SELECT s.id_stay, s.id_patient, CASE WHEN m.cur_stay IS NOT NULL THEN m.bed ELSE s.id_room END AS id_room,
       s.date_in, s.date_out
FROM stay s LEFT JOIN mv m ON m.cur_stay = s.id_stay
UNION ALL
SELECT new_stay, id_patient, bed, coalesce(TRY_CAST(adm_t AS TIMESTAMP), TIMESTAMP '{BATCH_TS}'),
       CAST(NULL AS TIMESTAMP) FROM op"""))
def q_update_patient_stays(spark, sf_dir):
    return _update(spark, sf_dir).tables.stay


@register("update_patient_patients", with_standin(_UPDATE_SQL + """
SELECT p.id_patient,
       CASE WHEN u.id_patient IS NOT NULL THEN u.full_name ELSE p.full_name END AS full_name,
       CASE WHEN u.id_patient IS NOT NULL THEN u.nin ELSE p.nin END AS nin,
       CASE WHEN u.id_patient IS NOT NULL THEN CAST(u.birth_t AS DATE) ELSE p.birth_date END AS birth_date,
       CASE WHEN u.id_patient IS NOT NULL THEN u.sex ELSE p.sex END AS sex,
       CASE WHEN u.id_patient IS NOT NULL THEN u.address ELSE p.address END AS address,
       CASE WHEN u.id_patient IS NOT NULL THEN u.phone ELSE p.phone END AS phone,
       CASE WHEN u.id_patient IS NOT NULL THEN u.blood_group ELSE p.blood_group END AS blood_group
FROM patient p LEFT JOIN win u ON u.id_patient = p.id_patient"""))
def q_update_patient_patients(spark, sf_dir):
    return _update(spark, sf_dir).tables.patient


@register("update_patient_rejects", with_standin(_UPDATE_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'conflict' FROM w WHERE rp > 1 OR rb > 1"""))
def q_update_patient_rejects(spark, sf_dir):
    return _update(spark, sf_dir).rejects


# ------------------------------------------------------------------ C1-C6 on data with violations
_RULES_SQL["staff_req"] = _RULES_SQL["staff"]
_STAFF_REQ_CTE = """
WITH staff_req AS (
  SELECT event_id AS id_staff, CAST(user_id % 30 AS BIGINT) AS id_service, 'Nurse ' || CAST(user_id AS VARCHAR) AS full_name,
         CASE WHEN event_id % 50 = 0 THEN 'SUPPLIER.' || lpad(CAST(user_id % 100 AS VARCHAR), 9, '0') || '@ward.test'
              ELSE 'n' || CAST(event_id % 700 AS VARCHAR) || '@Ward.test' END AS email,
         lower(CASE event_id % 4 WHEN 0 THEN 'Nurse' WHEN 1 THEN 'admin' WHEN 2 THEN 'nurse' ELSE 'doctor' END) AS role
  FROM events WHERE event_type = 'signup')
"""


@register("staff_table_violations", with_standin(_STAFF_REQ_CTE + _violation_sql("staff_req")))
def q_staff_table_violations(spark, sf_dir):
    """The constraint rules of the staff table applied to a staff table built
    from the registration stream (duplicate e-mails, unknown services and
    roles occur)."""
    t = standin_tables(spark, sf_dir)
    req = rq.staff_requests(spark, sf_dir)
    staff_like = req.select(F.col("request_id").alias("id_staff"), F.col("id_service").cast("bigint").alias("id_service"),
                            "full_name", "email", F.lower("role").alias("role"))
    _, bad = checks.violations(staff_like, checks.default_rules(t)["staff"])
    return bad.select(F.lit("staff_req").alias("table_name"), F.col("id_staff").cast("string").alias("row_key"),
                      "reason")


# ------------------------------------------------------------------ C4, C7 on an observation table with violations
_RULES_SQL["obs_broken"] = ("id_obs", [
    ("pk", ["id_obs"]), ("nn", ["id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate", "spo2", "glucose",
                                "weight", "height", "remark"]),
    ("fk", "id_stay", "stay", "id_stay"), ("fk", "id_nurse", "staff", "id_staff"), ("dec", "temperature", 5, 2),
    ("dec", "glucose", 3, 1), ("dec", "weight", 5, 2), ("dec", "height", 4, 2), ("int", "heart_rate"), ("int", "spo2"),
    ("len", "state", 30), ("len", "blood_pressure", 20)])
_OBS_BROKEN = {
    "id_obs": "event_id", "id_stay": "event_id % 900", "id_nurse": "CAST(user_id % 120 AS BIGINT)",
    "state": "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN repeat('s', 31) ELSE 'ok' END",
    "blood_pressure": "CASE WHEN event_id % 17 = 0 THEN repeat('1', 21) ELSE '120/80' END",
    "temperature": "CAST(CASE WHEN event_id % 7 = 0 THEN 1000 ELSE 37 END AS DOUBLE)", "heart_rate": "CAST(80 AS BIGINT)",
    "spo2": "CASE WHEN event_id % 19 = 0 THEN CAST(3000000000 AS BIGINT) ELSE CAST(97 AS BIGINT) END",
    "glucose": "CAST(CASE WHEN event_id % 5 = 0 THEN 999.9 ELSE 5.5 END AS DOUBLE)", "weight": "CAST(70 AS DOUBLE)",
    "height": "CAST(CASE WHEN event_id % 23 = 0 THEN 170 ELSE 1.7 END AS DOUBLE)",
    "remark": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END"}


@register("observation_table_violations", with_standin("WITH obs_broken AS (SELECT " + ", ".join(
    f"{e} AS {c}" for c, e in _OBS_BROKEN.items()) + " FROM events) " + _violation_sql("obs_broken")))
def q_observation_table_violations(spark, sf_dir):
    """The observation rules on a table from the event feed in which every
    kind of rule is broken."""
    t = standin_tables(spark, sf_dir)
    obs = read_table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in _OBS_BROKEN.items()])
    rules = checks.default_rules(t.replace(observation=obs, obs_ties=("id_obs",)))["observation"]
    _, bad = checks.violations(obs, rules)
    return bad.select(F.lit("obs_broken").alias("table_name"), F.col("id_obs").cast("string").alias("row_key"), "reason")


# ------------------------------------------------------------------ C9, C8
@register("service_removal_and_rename", with_standin("""
SELECT id_staff, CASE WHEN id_service % 5 = 0 THEN NULL WHEN id_service % 5 = 1 THEN id_service + 1000 ELSE id_service END
       AS id_service, coalesce(CASE WHEN id_staff % 7 = 0 THEN NULL ELSE role END, 'nurse') AS role
FROM staff"""))
def q_service_removal_and_rename(spark, sf_dir):
    """Services ending in 0 or 5 go, those ending in 1 or 6 get a new key:
    what becomes of their staff; a missing role is filled by its default."""
    t = standin_tables(spark, sf_dir)
    staff = t.staff.select("id_staff", "id_service", F.when(F.col("id_staff") % 7 != 0, F.col("role")).alias("role"))
    staff = checks.cascade_service_delete(staff, t.service.where("id_service % 5 = 0"))
    renames = t.service.where("id_service % 5 = 1").selectExpr("id_service", "id_service + 1000 AS new_id_service")
    return checks.fill_defaults(checks.cascade_service_rename(staff, renames), {"role": "nurse"})


# ------------------------------------------------------------------ S3, S4
from pyspark.sql import types as T  # noqa: E402

from ..sources import sinks  # noqa: E402


@register("json_decode_encode", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       '{"event_id":' || event_id || ',"k":' || coalesce(json_extract_string(props, '$.k'), 'null') || ',"none":null}' AS answer
FROM events""")
def q_json_decode_encode(spark, sf_dir):
    """The JSON of the event feed, decoded to a typed column and encoded as
    an answer that keeps NULLs."""
    ev = rq.decode_json_column(read_table(spark, sf_dir, "events"), "props", T.StructType([T.StructField("k", T.IntegerType())]))
    ev = ev.select("event_id", "k", F.lit(None).cast("int").alias("none"))
    return ev.select("event_id", "k", sinks.answer_json(ev).alias("answer"))


# ------------------------------------------------------------------ M9s with F13, X14
_OBS_STRICT_SQL = _OBS_SQL.replace("  SELECT request_id, requested_at,\n         TRY_CAST(trim(", """  SELECT request_id, requested_at,
         CASE WHEN trim(id_stay_t) IN ('', '0') THEN 'missing: id_stay' WHEN trim(id_nurse_t) IN ('', '0') THEN 'missing: id_nurse'
              WHEN trim(temp_t) IN ('', '0') THEN 'missing: temperature' WHEN trim(weight_t) IN ('', '0') THEN 'missing: weight'
              WHEN trim(height_t) IN ('', '0') THEN 'missing: height' END AS missing,
         TRY_CAST(trim(""", 1).replace("  SELECT cl.*, CASE WHEN cm > 0", "  SELECT cl.* EXCLUDE (missing), CASE WHEN cm > 0", 1).replace(
    "DECIMAL(4,2)) ELSE 0.00 END AS height,\n         CASE\n", "DECIMAL(4,2)) END AS height,\n         CASE\n           WHEN missing IS NOT NULL THEN missing\n", 1).replace(
    "OR weight IS NULL OR remark IS NULL", "OR weight IS NULL OR remark IS NULL OR NOT coalesce(cm > 0, false)", 1)


@register("ingest_observations_strict_rejects", with_standin(_OBS_STRICT_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL"""))
def q_ingest_strict_rejects(spark, sf_dir):
    return changes.ingest_observations(standin_tables(spark, sf_dir), rq.observation_requests(spark, sf_dir), BATCH_TS,
                                       strict=True).rejects


# ------------------------------------------------------------------ M11
_PRESC_SQL = """
WITH presc AS (SELECT o_orderkey AS id_prescription, o_orderkey AS id_stay, o_orderpriority AS drug, 1 AS dose, 1 AS frequency,
                      CAST(NULL AS VARCHAR) AS instructions FROM orders),
req AS (SELECT event_id AS request_id, ts AS requested_at,
               CASE event_id % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'insert' ELSE 'update' END AS action,
               event_id % 40 AS pid, event_id AS sid, 'd' || event_id AS drug FROM events WHERE event_type = 'click'),
c AS (SELECT *, CASE WHEN action = 'insert' AND sid NOT IN (SELECT id_stay FROM stay) THEN 'unknown stay'
                     WHEN action <> 'insert' AND pid NOT IN (SELECT id_prescription FROM presc) THEN 'unknown prescription' END AS reason
      FROM req),
e AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY requested_at NULLS FIRST, request_id) AS rn
      FROM c WHERE reason IS NULL AND action <> 'insert'),
g AS (SELECT *, min(CASE WHEN action = 'delete' THEN rn END) OVER (PARTITION BY pid) AS gone FROM e),
l AS (SELECT *, rn > coalesce(gone, rn) AS late,
             max(CASE WHEN rn <= coalesce(gone, rn) THEN rn END) OVER (PARTITION BY pid) AS last_rn FROM g),
ins AS (SELECT (SELECT max(id_prescription) FROM presc)
               + row_number() OVER (ORDER BY requested_at NULLS FIRST, request_id) AS id_prescription, sid, drug
        FROM c WHERE reason IS NULL AND action = 'insert')
"""


def _presc_changes(spark, sf_dir):
    t = standin_tables(spark, sf_dir)
    presc = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_prescription"), F.col("o_orderkey").alias("id_stay"), F.col("o_orderpriority").alias("drug"),
        F.lit(1).alias("dose"), F.lit(1).alias("frequency"), F.lit(None).cast("string").alias("instructions"))
    return changes.prescription_changes(t.replace(prescription=presc, presc_order=("id_prescription",)),
                                        rq.prescription_requests(spark, sf_dir))


@register("prescription_changes_rejects", with_standin(_PRESC_SQL + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, CASE WHEN late THEN 'unknown prescription' ELSE 'superseded' END FROM l WHERE late OR rn <> last_rn"""))
def q_prescription_rejects(spark, sf_dir):
    return _presc_changes(spark, sf_dir).rejects


@register("prescription_changes_table", with_standin(_PRESC_SQL + """
SELECT p.id_prescription, p.id_stay, coalesce(u.drug, p.drug) AS drug, p.dose, CASE WHEN u.pid IS NULL THEN 1 ELSE 2 END AS frequency
FROM presc p LEFT JOIN (SELECT * FROM l WHERE rn = last_rn AND action = 'update') u ON u.pid = p.id_prescription
WHERE p.id_prescription NOT IN (SELECT pid FROM l WHERE rn = last_rn AND action = 'delete')
UNION ALL SELECT id_prescription, sid, drug, 1, 2 FROM ins"""))
def q_prescription_table(spark, sf_dir):
    return _presc_changes(spark, sf_dir).tables.prescription.select("id_prescription", "id_stay", "drug", "dose", "frequency")


# ------------------------------------------------------------------ ST1
@register("stream_ingest_observations", with_standin(_OBS_SQL + """
SELECT request_id, id_stay, id_nurse, state, remark, observed_at FROM c WHERE reason IS NULL"""))
def q_stream_ingest_observations(spark, sf_dir):
    """The vitals feed as JSON files through the streaming ingest, one file a
    micro-batch: the accepted rows equal the batch answer."""
    import uuid

    from ..session import checkpoint_dir
    root = f"{checkpoint_dir(spark)}/st1-{uuid.uuid4().hex}"
    rq.observation_requests(spark, sf_dir).repartitionByRange(3, "request_id").write.json(f"{root}/in")
    st.start_observation_ingest(spark, standin_tables(spark, sf_dir), f"{root}/in", f"{root}/out", BATCH_TS, f"{root}/state",
                                max_files=1).awaitTermination()
    return spark.read.parquet(f"{root}/out/accepted").select("request_id", "id_stay", "id_nurse", "state", "remark", "observed_at")


from . import catalog_changes  # noqa: E402, F401  (registers its queries)

"""More registered queries: amended observations, admissions that the strict
rules accept, changes of services, snapshot versions and appends written and
read back, wildcard search and ordered prescription lists.  Same form as
``catalog``, which imports this module at its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import changes, checks, ordered, reads
from ..session import checkpoint_dir
from ..sources import requests as rq
from ..sources import snapshot
from ..sources.standin import read_table, standin_tables, with_standin
from .catalog import _ADMIT_SQL, _CENSUS_SQL, _TRANSFER_SQL, BATCH_TS, register


# ------------------------------------------------------------------ M2, what the strict rules accept
# A third of the patients has no stay here, and every other bed is free.
_STRICT_SQL = "WITH stay2 AS (SELECT * FROM stay WHERE id_patient % 3 <> 0),\nroom2 AS (SELECT * REPLACE (id_room % 2 = 0 AS available) FROM room),\n" + (
    _ADMIT_SQL.strip()[5:].replace("FROM stay WHERE", "FROM stay2 WHERE").replace("FROM stay)", "FROM stay2)").replace("JOIN room b", "JOIN room2 b"))


def _admit_strict(spark, sf_dir):
    t = standin_tables(spark, sf_dir)
    t = t.replace(stay=t.stay.where("id_patient % 3 <> 0"), room=t.room.withColumn("available", F.col("id_room") % 2 == 0))
    return changes.admit_existing(t, rq.admission_requests(spark, sf_dir))


@register("admit_existing_strict_new_stays", with_standin(_STRICT_SQL + "\nSELECT * FROM acc"))
def q_admit_strict_stays(spark, sf_dir):
    return _admit_strict(spark, sf_dir).accepted


@register("admit_existing_strict_rooms", with_standin(_STRICT_SQL + """
SELECT id_room, id_service, room_no, bed_no, available AND id_room NOT IN (SELECT id_room FROM acc WHERE id_room IS NOT NULL) AS available
FROM room2"""))
def q_admit_strict_rooms(spark, sf_dir):
    return _admit_strict(spark, sf_dir).tables.room


# ------------------------------------------------------------------ M10, M10o, F8
_AMEND = """
WITH obs AS (SELECT event_id AS id_obs, event_id AS id_stay, CAST(event_id % 5 + 1 AS BIGINT) AS id_nurse, 'ok' AS state,
                    CAST(37 AS DOUBLE) AS temperature, CAST(80 AS INTEGER) AS heart_rate, 'kept' AS remark FROM events WHERE event_type = 'view'),
req AS (SELECT event_id AS request_id, ts AS requested_at, event_id - event_id % 4 AS id_obs, event_id % 20000 AS id_stay,
               CASE WHEN event_id % 2 = 0 THEN (event_id - event_id % 4) % 5 + 1 ELSE event_id % 150 END AS id_nurse,
               event_id % 11 = 0 AS hot, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'amended ' || event_id END AS remark
        FROM events),
c AS (SELECT q.*, CASE WHEN o.id_obs IS NULL{own} THEN 'not found'
                       WHEN hot THEN 'out of range: temperature' WHEN q.remark IS NULL THEN 'missing value'{known} END AS reason
      FROM req q LEFT JOIN obs o ON o.id_obs = q.id_obs),
w AS (SELECT *, row_number() OVER (PARTITION BY id_obs ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS rn FROM c WHERE reason IS NULL)
"""
_AMEND_SQL = {
    False: _AMEND.format(own="", known="""
                       WHEN q.id_stay NOT IN (SELECT id_stay FROM stay) THEN 'unknown stay'
                       WHEN q.id_nurse NOT IN (SELECT id_staff FROM staff) THEN 'unknown nurse'"""),
    True: _AMEND.format(own=" OR o.id_nurse <> q.id_nurse", known=""),
}


def _amend(spark, sf_dir, own_only: bool):
    ev = read_table(spark, sf_dir, "events")
    number = lambda text, kind: F.lit(text).cast(kind)
    obs = ev.where("event_type = 'view'").select(
        F.col("event_id").alias("id_obs"), F.col("event_id").alias("id_stay"), (F.col("event_id") % 5 + 1).cast("bigint").alias("id_nurse"),
        F.lit("ok").alias("state"), F.lit("120/80").alias("blood_pressure"), number("37", "decimal(5,2)").alias("temperature"),
        number("80", "int").alias("heart_rate"), number("97", "int").alias("spo2"), number("5.5", "decimal(3,1)").alias("glucose"),
        number("70", "decimal(5,2)").alias("weight"), number("1.70", "decimal(4,2)").alias("height"), F.lit("kept").alias("remark"),
        F.col("ts").cast("timestamp_ntz").alias("observed_at"))
    e = F.col("event_id")
    asked = ev.select(
        e.alias("request_id"), F.col("ts").alias("requested_at"), (e - e % 4).cast("string").alias("id_obs"), (e % 20000).cast("string").alias("id_stay"),
        F.when(e % 2 == 0, (e - e % 4) % 5 + 1).otherwise(e % 150).cast("string").alias("id_nurse"), F.lit("better").alias("state"),
        F.lit("110/70").alias("blood_pressure"), F.when(e % 11 == 0, "1000").otherwise("36.5").alias("temperature"), F.lit("75").alias("heart_rate"),
        F.lit("98").alias("spo2"), F.lit("5.1").alias("glucose"), F.lit("71").alias("weight"), F.lit("1.71").alias("height"),
        F.when(e % 13 != 0, F.concat(F.lit("amended "), e.cast("string"))).alias("remark"), F.lit("2024-01-01T10:00").alias("observed_at"))
    t = standin_tables(spark, sf_dir).replace(observation=obs, obs_ties=("id_obs",))
    return changes.amend_observations(t, asked, own_only)


def _register_amend(prefix: str, own: bool) -> None:
    nurse = "o.id_nurse" if own else "coalesce(w.id_nurse, o.id_nurse)"
    stay = "o.id_stay" if own else "coalesce(w.id_stay, o.id_stay)"

    @register(f"{prefix}_table", with_standin(_AMEND_SQL[own] + f"""
SELECT o.id_obs, {stay} AS id_stay, {nurse} AS id_nurse, CASE WHEN w.id_obs IS NULL THEN o.state ELSE 'better' END AS state,
       CASE WHEN w.id_obs IS NULL THEN 37.0 ELSE 36.5 END::DOUBLE AS temperature, coalesce(w.remark, o.remark) AS remark,
       CASE WHEN w.id_obs IS NULL THEN 1.70 ELSE {'1.70' if own else '1.71'} END::DOUBLE AS height
FROM obs o LEFT JOIN w ON w.id_obs = o.id_obs AND w.rn = 1"""))
    def table(spark, sf_dir) -> DataFrame:
        out = _amend(spark, sf_dir, own).tables.observation
        return out.select("id_obs", "id_stay", "id_nurse", "state", F.col("temperature").cast("double").alias("temperature"), "remark",
                          F.col("height").cast("double").alias("height"))

    @register(f"{prefix}_rejects", with_standin(_AMEND_SQL[own] + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL UNION ALL SELECT request_id, 'superseded' FROM w WHERE rn > 1"""))
    def rejects(spark, sf_dir) -> DataFrame:
        return _amend(spark, sf_dir, own).rejects


_register_amend("amend_observations", False)
_register_amend("amend_own_observations", True)


# ------------------------------------------------------------------ C9
# By the key's last digit: 0 and 1, 5 and 6 swap; 2 and 7 ask for the key of a service that goes only if it has
# no beds; 3 and 8 get new keys; 4 and 9 go.
_SERVICE_SQL = """
WITH bedless AS (SELECT id_service FROM service WHERE id_service NOT IN (SELECT id_service FROM room WHERE id_service IS NOT NULL)),
req AS (SELECT id_service AS request_id, id_service, CASE id_service % 5 WHEN 0 THEN id_service + 1 WHEN 1 THEN id_service - 1
               WHEN 2 THEN id_service + 2 WHEN 3 THEN id_service + 1000 END AS new_key, id_service % 5 AS k FROM service),
c AS (SELECT *, CASE WHEN k = 4 AND id_service NOT IN (SELECT id_service FROM bedless) THEN 'service has beds'
                     WHEN k = 2 AND new_key IN (SELECT id_service FROM service)
                          AND new_key NOT IN (SELECT id_service FROM bedless) THEN 'key taken' END AS reason FROM req),
moved AS (SELECT id_service, new_key FROM c WHERE reason IS NULL)
"""


def _services(spark, sf_dir):
    t = standin_tables(spark, sf_dir)
    k, s = F.col("id_service") % 5, F.col("id_service")
    asked = t.service.select(s.alias("request_id"), "id_service", F.when(k == 0, s + 1).when(k == 1, s - 1).when(k == 2, s + 2)
                             .when(k == 3, s + 1000).alias("new_id_service"))
    return checks.change_services(t, asked)


@register("service_changes_rejects", with_standin(_SERVICE_SQL + "SELECT request_id, reason FROM c WHERE reason IS NOT NULL"))
def q_service_rejects(spark, sf_dir):
    return _services(spark, sf_dir)[1]


@register("service_changes_beds", with_standin(_SERVICE_SQL + """
SELECT id_room, CASE WHEN m.id_service IS NULL THEN r.id_service ELSE m.new_key END AS id_service
FROM room r LEFT JOIN moved m ON m.id_service = r.id_service"""))
def q_service_beds(spark, sf_dir):
    return _services(spark, sf_dir)[0].room.select("id_room", "id_service")


@register("service_changes_staff", with_standin(_SERVICE_SQL + """
SELECT id_staff, CASE WHEN m.id_service IS NULL THEN s.id_service ELSE m.new_key END AS id_service
FROM staff s LEFT JOIN moved m ON m.id_service = s.id_service"""))
def q_service_staff(spark, sf_dir):
    return _services(spark, sf_dir)[0].staff.select("id_staff", "id_service")


# ------------------------------------------------------------------ S5, S6
@register("version_round_trip_rooms", with_standin(_TRANSFER_SQL + """
SELECT r.id_room, r.id_service, r.room_no, r.bed_no, coalesce(p.available, r.available) AS available
FROM room r LEFT JOIN per_bed p ON p.id_room = r.id_room"""))
def q_version_round_trip(spark, sf_dir):
    """A batch of transfers written as the next snapshot version (only the
    tables it replaced) and read back by the version's manifest."""
    t = standin_tables(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/version-{uuid.uuid4().hex}"
    after = changes.transfer(t, rq.transfer_requests(spark, sf_dir)).tables
    written = snapshot.write_version(after, t, f"{root}/v1", f"{root}/v2")
    paths = snapshot.table_paths(spark, f"{root}/v2")
    if sorted(written) != ["room", "stay"] or paths["patient"] != f"{root}/v1/patient":
        raise ValueError(f"a transfer wrote {written}")
    return spark.read.schema(schemas.TABLE_SCHEMAS["room"]).parquet(paths["room"])


@register("version_parts_round_trip_rooms", with_standin(_TRANSFER_SQL + """
SELECT r.id_room, r.id_service, r.room_no, r.bed_no, coalesce(p.available, r.available) AS available
FROM room r LEFT JOIN per_bed p ON p.id_room = r.id_room"""))
def q_version_parts_round_trip(spark, sf_dir):
    """Stays and beds in parts by key; a batch of transfers written as the
    next version (only the parts it changed) and read back."""
    t = standin_tables(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/parts-{uuid.uuid4().hex}"
    snapshot.write_snapshot_parts(t, f"{root}/v1", {"stay": 16, "room": 16}, ("stay", "room"))
    base = t.replace(**{n: snapshot.read_snapshot_table(spark, f"{root}/v1", n) for n in ("stay", "room")})
    after = changes.transfer(base, rq.transfer_requests(spark, sf_dir)).tables
    snapshot.write_version(after, base, f"{root}/v1", f"{root}/v2")
    return snapshot.read_snapshot_table(spark, f"{root}/v2", "room")


@register("append_round_trip", "SELECT o_orderkey AS id_prescription, o_custkey AS id_stay, o_orderpriority AS drug FROM orders")
def q_append_round_trip(spark, sf_dir):
    """A prescription table and two batches appended to it, one of them
    sent twice, read back: every row once."""
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_prescription"), F.col("o_custkey").alias("id_stay"), F.col("o_orderpriority").alias("drug"),
        F.lit(1).alias("dose"), F.lit(1).alias("frequency"), F.lit(None).cast("string").alias("instructions"))
    root = f"{checkpoint_dir(spark)}/append-{uuid.uuid4().hex}"
    rows.where("id_prescription % 3 = 0").write.parquet(f"{root}/prescription")
    for batch in (1, 2, 1):
        snapshot.append_rows(rows.where(F.col("id_prescription") % 3 == batch), root, "prescription", f"b{batch}")
    path = f"{root}/prescription"
    return (spark.read.schema(schemas.PRESCRIPTION).parquet(path, *snapshot.appended(spark, path))
                 .select("id_prescription", "id_stay", "drug"))


# ------------------------------------------------------------------ X12, F6
@register("search_patients_wildcards", with_standin(_CENSUS_SQL + """
  AND (p.full_name ILIKE '%mer#%0_7%' OR p.nin ILIKE '%mer#%0_7%')"""))
def q_search_wildcards(spark, sf_dir):
    return reads.search_patients(standin_tables(spark, sf_dir), "MER#%0_7", wildcards=True)


# Terms of one and two characters, and patterns with several literal runs.
_BATCH_TERMS = {
    "short_terms": (False, "CAST(e.event_id % 100 AS VARCHAR)"),
    "patterns": (True, "'mer#%' || CAST(e.event_id % 10 AS VARCHAR) || '_' || CAST(e.user_id % 10 AS VARCHAR) || '%'"),
}


def _register_batch_search(kind: str) -> None:
    wildcards, term = _BATCH_TERMS[kind]
    match = "p.{0} ILIKE '%' || q.term || '%'" if wildcards else "contains(lower(strip_accents(p.{0})), q.term)"

    @register(f"search_patients_batch_{kind}", with_standin(_CENSUS_SQL.replace("WHERE s.date_out IS NULL", f"""
JOIN (SELECT e.event_id AS term_id, {term} AS term, e.user_id % 100 AS id_staff, st.id_service AS term_service
      FROM events e JOIN staff st ON st.id_staff = e.user_id % 100
      WHERE e.event_type = 'error' AND st.role = 'nurse' AND st.id_service IS NOT NULL) q
  ON q.term_service = r.id_service AND ({match.format('full_name')} OR {match.format('nin')})
WHERE s.date_out IS NULL""").replace(
        "SELECT r.id_service, sv.name AS service_name", "SELECT q.term_id, q.id_staff, r.id_service, sv.name AS service_name", 1)))
    def query(spark, sf_dir) -> DataFrame:
        ev = read_table(spark, sf_dir, "events").where("event_type = 'error'")
        e, u = F.col("event_id"), F.col("user_id")
        text = (F.concat(F.lit("mer#%"), (e % 10).cast("string"), F.lit("_"), (u % 10).cast("string"), F.lit("%")) if wildcards
                else (e % 100).cast("string"))
        terms = ev.select(e.alias("term_id"), text.alias("term"), (u % 100).alias("id_staff"))
        return reads.search_patients_batch(standin_tables(spark, sf_dir), terms, wildcards)


for _kind in _BATCH_TERMS:
    _register_batch_search(_kind)


# ------------------------------------------------------------------ Q11 lists, O3
@register("stay_summary_lists", with_standin("""
SELECT s.id_stay, coalesce(string_agg(p.drug || ' x' || p.dose::INTEGER, ';' ORDER BY p_line, p_part, p_supp, p_qty), '') AS prescriptions
FROM stay s LEFT JOIN prescription p ON p.id_stay = s.id_stay WHERE s.date_out IS NULL GROUP BY s.id_stay"""))
def q_stay_summary_lists(spark, sf_dir):
    t = standin_tables(spark, sf_dir)
    nested = reads.stay_summary_nested(t, t.stay.where("date_out is null"))
    return nested.select("id_stay", F.array_join(F.transform("prescriptions", lambda p: F.concat(
        p["drug"], F.lit(" x"), p["dose"].cast("int").cast("string"))), ";").alias("prescriptions"))


@register("stay_summary_chunks", with_standin("""
SELECT s.id_stay, coalesce(p.chunk, 0) AS chunk, coalesce(string_agg(p.drug || ' x' || p.dose::INTEGER, ';' ORDER BY p.n), '') AS prescriptions
FROM stay s LEFT JOIN (SELECT *, n // 3 AS chunk FROM (
  SELECT *, row_number() OVER (PARTITION BY id_stay ORDER BY p_line, p_part, p_supp, p_qty) - 1 AS n FROM prescription)) p
  ON p.id_stay = s.id_stay GROUP BY s.id_stay, p.chunk"""))
def q_stay_summary_chunks(spark, sf_dir):
    """Every stay's ordered prescriptions in numbered lists of three."""
    chunks = reads.stay_summary_chunks(standin_tables(spark, sf_dir), chunk_rows=3)
    return chunks.select("id_stay", "chunk", F.array_join(F.transform("prescriptions", lambda p: F.concat(
        p["drug"], F.lit(" x"), p["dose"].cast("int").cast("string"))), ";").alias("prescriptions"))


@register("free_rooms_chunks", with_standin("""
SELECT id_service, n // 100 AS chunk, string_agg(id_room::VARCHAR, ',' ORDER BY n) AS rooms FROM (
  SELECT id_service, id_room, row_number() OVER (PARTITION BY id_service ORDER BY id_room) - 1 AS n FROM room WHERE available)
GROUP BY ALL"""))
def q_free_rooms_chunks(spark, sf_dir):
    """The free beds of every service in numbered lists of a hundred."""
    rooms = ordered.list_chunks(reads.free_rooms(standin_tables(spark, sf_dir)), "id_service", ["id_room"], ["id_room"], "rooms", 100)
    return rooms.select("id_service", "chunk", F.array_join(F.transform("rooms", lambda r: r["id_room"].cast("string")), ",").alias("rooms"))

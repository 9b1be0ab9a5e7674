"""Batch change application: requests in, new table versions and rejects
out.

The source system applies one request per HTTP call inside a transaction.
Here a whole batch is applied to a snapshot in one deterministic step:

* each request is validated (shape, then the snapshot: keys exist, bed
  free, services match);
* among the valid ones, in (requested_at, request_id) order, the first
  request per stay (per patient for admissions) *and* per bed wins; the
  others are rejected with reason ``conflict`` and may be sent again;
* winners are applied with joins and column merges; nothing is updated
  in place.

Every rejected request appears once in ``rejects`` (request_id, reason).
Key lookups are joins (AQE picks broadcast or sort-merge from the measured
sizes); conflict winners come from aggregates, so a bed or stay asked for
by a third of all requests is still reduced map-side.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cleaning as X
from ..sources.snapshot import Tables
from .hot import hot_values, join_split
from .ids import assign_dense_ids
from .latest import flag_first_per_key, latest_per_key
from .reads import current_stay

ORDER = ["requested_at", "request_id"]


@dataclasses.dataclass(frozen=True)
class ChangeResult:
    tables: Tables
    accepted: DataFrame
    rejects: DataFrame


def _reason(*pairs: tuple[Column, str | Column]) -> Column:
    """First failing check's reason (checks given as (is_bad, reason))."""
    return F.coalesce(*[F.when(bad, r if isinstance(r, Column) else F.lit(r)) for bad, r in pairs])


def _named(t_df: DataFrame, t_col: str, df: DataFrame, col: str) -> DataFrame:
    """The rows of a (large) table whose key the batch names.  A semi join
    whose build side is the batch's distinct keys: with a small batch the
    table is streamed past a broadcast key set instead of being shuffled, so
    the lookup work follows the batch size, not the table size."""
    asked = df.select(F.col(col).alias(t_col)).where(F.col(t_col).isNotNull()).distinct()
    return t_df.join(asked, on=t_col, how="left_semi")


def _exists(df: DataFrame, t_df: DataFrame, col: str, t_col: str, flag: str) -> DataFrame:
    """Flag whether ``col`` names a row of ``t_df``.  The batch's distinct
    keys (combined on the map side, so a hot key is one row) meet the table;
    the rows then meet only the keys the table lacks, as a rule few enough
    for a broadcast: the rows of a hot key are never brought together.  A
    duplicated key of the table cannot duplicate a request."""
    lacking = f"_lacking{flag}"
    asked = df.select(F.col(col).alias(lacking)).where(F.col(lacking).isNotNull()).distinct()
    known = _named(t_df.select(F.col(t_col).alias(lacking)), lacking, df, col)
    unknown = asked.join(known, on=lacking, how="left_anti")
    return (df.join(unknown, on=F.col(col) == F.col(lacking), how="left")
              .withColumn(flag, F.col(col).isNotNull() & F.col(lacking).isNull())
              .drop(lacking))


def _with_bed(df: DataFrame, t: Tables, hot: dict, col: str = "bed") -> DataFrame:
    """Service and state of the bed that a request names; ``hot``: the batch's ``hot_values`` of ``col``."""
    named = _named(t.room, "id_room", df, col)
    beds = named.select(F.col("id_room").alias(col), F.col("id_service").alias(col + "_service"),
                        F.col("available").alias(col + "_free"), F.lit(True).alias(col + "_exists"))
    return (join_split(df, beds, col, "left", hot=hot)
              .withColumn(col + "_exists", F.coalesce(F.col(col + "_exists"), F.lit(False)))
              .withColumn(col + "_free", F.coalesce(F.col(col + "_free"), F.lit(False))))


def _resolve_conflicts(valid: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Flag ``_win``: first valid request per each key set."""
    out, flags = valid, []
    for i, k in enumerate(keys):
        out = flag_first_per_key(out, k, ORDER, f"_w{i}")
        flags.append(F.col(f"_w{i}"))
    win = F.lit(True)
    for f in flags:
        win = win & f
    return out.withColumn("_win", win).drop(*[f"_w{i}" for i in range(len(keys))])


def _split(checked: DataFrame, keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """(winners, rejects) from requests with a ``reason`` column."""
    bad = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    valid = _resolve_conflicts(checked.filter(F.col("reason").isNull()), keys)
    lost = valid.filter(~F.col("_win")).select("request_id", F.lit("conflict").alias("reason"))
    return valid.filter(F.col("_win")).drop("_win", "reason"), bad.unionByName(lost)


def _superseded(valid: DataFrame, kept: DataFrame) -> DataFrame:
    """The valid requests that a later one has overtaken."""
    return (valid.join(kept.select("request_id"), on="request_id", how="left_anti")
                 .select("request_id", F.lit("superseded").alias("reason")))


def apply_bed_changes(room: DataFrame, changes: DataFrame) -> DataFrame:
    """New bed table from (id_room, available) changes; when a batch both
    frees and takes a bed, taken wins."""
    per_bed = changes.groupBy("id_room").agg(F.min(F.col("available")).alias("_new"))
    return (room.join(per_bed, on="id_room", how="left")
                .withColumn("available", F.coalesce(F.col("_new"), F.col("available")))
                .select(*room.columns))


def _merge(table: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Overwrite ``cols`` of the rows named in ``updates`` (one row per key)."""
    up = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias("_u_" + c) for c in cols])
    merged = table.join(up, on=key, how="left")
    return merged.select(*[F.when(F.col("_hit"), F.col("_u_" + c)).otherwise(F.col(c)).alias(c)
                           if c in cols else F.col(c) for c in table.columns])


def _next_ids(rows: DataFrame, table: DataFrame, id_col: str, name: str) -> DataFrame:
    base = table.agg(F.max(id_col)).scalar() if id_col in table.columns else F.lit(0)
    return assign_dense_ids(rows, ORDER, name, base)


def _stay_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns
                         else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STAY.fields])


# ---------------------------------------------------------------- M2
def admit_existing(t: Tables, requests: DataFrame, check_free: bool = True) -> ChangeResult:
    """New stay for a known patient; bed 0 or empty means no bed.  The bed
    must be free and the patient without an active stay unless
    ``check_free=False`` (the source system's behaviour)."""
    r = requests.select(
        *ORDER, X.to_long("id_patient").alias("id_patient"),
        F.when(X.is_empty("id_room"), F.lit(None).cast("bigint")).otherwise(X.to_long("id_room")).alias("bed"),
        F.col("id_room").alias("_bed_text"), F.col("date_in").alias("_date_text"))
    r = _exists(r, t.patient, "id_patient", "id_patient", "_pat")
    r = _exists(r, t.stay.filter(F.col("date_out").isNull()), "id_patient", "id_patient", "_in")
    r = _with_bed(r, t, hot_values(r.select("bed"), ["bed"])["bed"])
    checked = r.withColumn("reason", _reason(
        (~X.positive_int("id_patient"), "invalid: id_patient"),
        (F.col("_bed_text").isNull(), "missing: id_room"),
        (~X.valid_date_text("_date_text"), "invalid: date_in"),
        (~F.col("_pat"), "unknown patient"),
        (F.lit(check_free) & F.col("_in"), "already active"),
        (F.col("bed").isNotNull() & ~F.col("bed_exists"), "unknown bed"),
        (F.lit(check_free) & F.col("bed").isNotNull() & ~F.col("bed_free"), "bed not free"),
    ))
    winners, rejects = _split(checked, [["id_patient"], ["bed"]])
    new = _next_ids(winners, t.stay, "id_stay", "id_stay").select(
        "request_id", "id_stay", "id_patient", F.col("bed").alias("id_room"),
        F.to_timestamp_ntz("_date_text", F.lit("yyyy-MM-dd")).alias("date_in"),
        F.lit(None).cast("timestamp_ntz").alias("date_out"))
    stays = t.stay.unionByName(_stay_rows(new).select(*t.stay.columns))
    rooms = apply_bed_changes(t.room, new.filter(F.col("id_room").isNotNull())
                              .select("id_room", F.lit(False).alias("available")))
    return ChangeResult(t.replace(stay=stays, room=rooms), new, rejects)


# ---------------------------------------------------------------- M1
PATIENT_FIELDS = ["full_name", "nin", "birth_date", "sex", "address", "phone", "blood_group"]
PATIENT_REQUIRED = ["full_name", "nin", "birth_date", "sex", "address", "blood_group"]


def _patient_checks() -> list[tuple[Column, str]]:
    lim = schemas.TEXT_LIMITS["patient"]
    missing = X.first_missing(PATIENT_REQUIRED)
    checks = [(missing.isNotNull(), F.concat(F.lit("missing: "), missing))]
    checks.append((~X.valid_date_text("birth_date"), "invalid: birth_date"))
    checks.append((~F.col("sex").isin(list(schemas.SEX_VALUES)), "invalid: sex"))
    for c, n in lim.items():
        checks.append((F.coalesce(F.char_length(c) > n, F.lit(False)), f"too long: {c}"))
    return checks


def admit_new(t: Tables, requests: DataFrame, batch_ts: str) -> ChangeResult:
    """New patient + new stay in a free bed, all or nothing."""
    r = requests.withColumn("bed", X.to_long("id_room"))
    r = _with_bed(r, t, hot_values(r.select("bed"), ["bed"])["bed"])
    checked = r.withColumn("reason", _reason(
        *_patient_checks(),
        (~X.positive_int("id_room"), "invalid: id_room"),
        (~F.col("bed_exists") | ~F.col("bed_free"), "bed not free"),
    ))
    winners, rejects = _split(checked, [["bed"]])
    base_p = t.patient.agg(F.max("id_patient")).scalar()
    base_s = t.stay.agg(F.max("id_stay")).scalar()
    numbered = assign_dense_ids(winners, ORDER, "_n", 0)
    new = numbered.select(
        "request_id", (F.coalesce(base_p, F.lit(0)) + F.col("_n")).alias("id_patient"),
        (F.coalesce(base_s, F.lit(0)) + F.col("_n")).alias("id_stay"),
        *PATIENT_FIELDS, F.col("bed").alias("id_room"),
        X.parse_timestamp("admission_date", batch_ts).alias("date_in"))
    patients = t.patient.unionByName(new.select(
        *[F.col(f.name).cast(f.dataType) if f.name != "birth_date" else F.to_date("birth_date").alias("birth_date")
          for f in schemas.PATIENT.fields]).select(*t.patient.columns))
    stays = t.stay.unionByName(_stay_rows(new).select(*t.stay.columns))
    rooms = apply_bed_changes(t.room, new.select("id_room", F.lit(False).alias("available")))
    return ChangeResult(t.replace(patient=patients, stay=stays, room=rooms), new, rejects)


# ---------------------------------------------------------------- M4
def transfer(t: Tables, requests: DataFrame, lenient: bool = False) -> ChangeResult:
    """Move a stay to another bed of the asking nurse's service.  The old bed
    is freed, the new one taken.  Strict mode (default) also requires the
    stay to be active and the new bed to be free, unless it is the stay's own
    bed (a no-op)."""
    r = requests.select(*ORDER, X.to_long("id_stay").alias("id_stay"), X.to_long("id_room").alias("bed"),
                        X.to_long("id_staff").alias("id_staff"), F.col("id_room").alias("_bed_text"))
    hot = hot_values(r, ["bed", "id_stay", "id_staff"])
    staff = _named(t.staff, "id_staff", r, "id_staff").select("id_staff", F.col("id_service").alias("staff_service"))
    r = join_split(r, staff, "id_staff", "left", hot=hot["id_staff"])
    r = _with_bed(r, t, hot["bed"])
    cur = _named(t.stay, "id_stay", r, "id_stay").select(
        "id_stay", F.col("id_room").alias("old_bed"), F.col("date_out").alias("_out"), F.lit(True).alias("_stay"))
    r = join_split(r, cur, "id_stay", "left", hot=hot["id_stay"]).withColumn("_stay", F.coalesce(F.col("_stay"), F.lit(False)))
    same = F.coalesce(F.col("old_bed") == F.col("bed"), F.lit(False))
    checked = r.withColumn("reason", _reason(
        (X.is_empty("id_stay") | X.is_empty("id_staff") | F.col("_bed_text").isNull(), "missing: field"),
        (F.col("staff_service").isNull(), "unknown staff service"),
        (~F.col("bed_exists"), "unknown bed"),
        (F.col("staff_service") != F.col("bed_service"), "service mismatch"),
        (~F.col("_stay"), "unknown stay"),
        (F.lit(not lenient) & F.col("_out").isNotNull(), "not active"),
        (F.lit(not lenient) & ~F.col("bed_free") & ~same, "bed not free"),
    ))
    winners, rejects = _split(checked, [["id_stay"], ["bed"]])
    moves = winners.select("request_id", "id_stay", F.col("bed").alias("id_room"), "old_bed")
    stays = _merge(t.stay, moves, "id_stay", ["id_room"])
    changes = (moves.filter(F.col("old_bed").isNotNull() & (F.col("old_bed") != F.col("id_room")))
                    .select(F.col("old_bed").alias("id_room"), F.lit(True).alias("available"))
               .unionByName(moves.select("id_room", F.lit(False).alias("available"))))
    rooms = apply_bed_changes(t.room, changes)
    return ChangeResult(t.replace(stay=stays, room=rooms), moves, rejects)


# ---------------------------------------------------------------- M5, M6
def discharge(t: Tables, requests: DataFrame, batch_ts: str, lenient: bool = False) -> ChangeResult:
    """End stays: set the end time (default ``batch_ts``), clear the stay's
    bed and free that bed.  ``lenient`` frees the bed named in the request
    instead (the source system's behaviour) and allows ended stays and an end
    before the entry."""
    r = requests.select(*ORDER, X.to_long("id_stay").alias("id_stay"), F.col("id_room").alias("_bed_text"),
                        X.parse_timestamp("date_out", batch_ts).alias("new_out"))
    hot = hot_values(r, ["id_stay"])
    cur = _named(t.stay, "id_stay", r, "id_stay").select(
        "id_stay", F.col("id_room").alias("old_bed"), F.col("date_out").alias("old_out"),
        F.col("date_in").alias("_in"), F.lit(True).alias("_stay"))
    r = join_split(r, cur, "id_stay", "left", hot=hot["id_stay"]).withColumn("_stay", F.coalesce(F.col("_stay"), F.lit(False)))
    checked = r.withColumn("reason", _reason(
        (X.is_empty("id_stay"), "invalid: id_stay"),
        (F.col("_bed_text").isNull(), "missing: id_room"),
        (~F.col("_stay"), "unknown stay"),
        (F.lit(not lenient) & F.col("old_out").isNotNull(), "not active"),
        (F.lit(not lenient) & F.coalesce(F.col("new_out") < F.col("_in"), F.lit(False)), "end before entry"),
    ))
    winners, rejects = _split(checked, [["id_stay"]])
    freed = (F.when(X.positive_int("_bed_text"), X.to_long("_bed_text")) if lenient else F.col("old_bed"))
    done = winners.select("request_id", "id_stay", F.col("new_out").alias("date_out"),
                          F.lit(None).cast("bigint").alias("id_room"), freed.alias("freed_bed"))
    stays = _merge(t.stay, done, "id_stay", ["date_out", "id_room"])
    rooms = apply_bed_changes(t.room, done.filter(F.col("freed_bed").isNotNull())
                              .select(F.col("freed_bed").alias("id_room"), F.lit(True).alias("available")))
    return ChangeResult(t.replace(stay=stays, room=rooms), done, rejects)


def reactivate(t: Tables, requests: DataFrame, lenient: bool = False) -> ChangeResult:
    """Re-open a stay in a bed that exists and is free; the bed is taken.  The
    stay must have ended unless ``lenient`` (the source system's behaviour,
    which leaves the bed of an active stay taken by nobody)."""
    r = requests.select(*ORDER, X.to_long("id_stay").alias("id_stay"), X.to_long("id_room").alias("bed"),
                        F.col("id_room").alias("_bed_text"))
    hot = hot_values(r, ["bed", "id_stay"])
    r = _with_bed(r, t, hot["bed"])
    cur = _named(t.stay, "id_stay", r, "id_stay").select(
        "id_stay", F.col("date_out").alias("_out"), F.lit(True).alias("_stay"))
    r = join_split(r, cur, "id_stay", "left", hot=hot["id_stay"]).withColumn("_stay", F.coalesce(F.col("_stay"), F.lit(False)))
    checked = r.withColumn("reason", _reason(
        (X.is_empty("id_stay"), "invalid: id_stay"),
        (~X.positive_int("_bed_text"), "invalid: id_room"),
        (~F.col("bed_exists"), "unknown bed"),
        (~F.col("bed_free"), "bed not free"),
        (~F.col("_stay"), "unknown stay"),
        (F.lit(not lenient) & F.col("_out").isNull(), "already active"),
    ))
    winners, rejects = _split(checked, [["id_stay"], ["bed"]])
    done = winners.select("request_id", "id_stay", F.col("bed").alias("id_room"),
                          F.lit(None).cast("timestamp_ntz").alias("date_out"))
    stays = _merge(t.stay, done, "id_stay", ["id_room", "date_out"])
    rooms = apply_bed_changes(t.room, done.select("id_room", F.lit(False).alias("available")))
    return ChangeResult(t.replace(stay=stays, room=rooms), done, rejects)


def apply_status(t: Tables, requests: DataFrame, batch_ts: str, lenient: bool = False) -> ChangeResult:
    """The status route: ``action`` = discharge or reactivate, in request
    order (see ``status``)."""
    from .status import apply_status as in_order
    return in_order(t, requests, batch_ts, lenient)


# ---------------------------------------------------------------- M7
def discharge_by_patient(t: Tables, requests: DataFrame, batch_ts: str) -> ChangeResult:
    """End every active stay of each named patient and free each one's bed.
    The first request for a patient wins; an end before the entry of any of
    the patient's active stays refuses the request."""
    r = requests.select(*ORDER, X.to_long("id_patient").alias("id_patient"),
                        X.parse_timestamp("date_out", batch_ts).alias("new_out"))
    active = _named(t.stay.filter(F.col("date_out").isNull()), "id_patient", r, "id_patient")
    per = active.groupBy("id_patient").agg(F.max("date_in").alias("_in"), F.lit(True).alias("_some"))
    checked = r.join(per, on="id_patient", how="left").withColumn("reason", _reason(
        (F.col("_some").isNull(), "no active stay"),
        (F.coalesce(F.col("new_out") < F.col("_in"), F.lit(False)), "end before entry"),
    ))
    winners, rejects = _split(checked, [["id_patient"]])
    done = (winners.select("request_id", "id_patient", F.col("new_out").alias("date_out"))
            .join(active.select("id_patient", "id_stay", F.col("id_room").alias("freed_bed")), on="id_patient")
            .select("request_id", "id_stay", "date_out", F.lit(None).cast("bigint").alias("id_room"), "freed_bed"))
    stays = _merge(t.stay, done, "id_stay", ["date_out", "id_room"])
    rooms = apply_bed_changes(t.room, done.filter(F.col("freed_bed").isNotNull())
                              .select(F.col("freed_bed").alias("id_room"), F.lit(True).alias("available")))
    return ChangeResult(t.replace(stay=stays, room=rooms), done, rejects)


# ---------------------------------------------------------------- M3
def update_patient(t: Tables, requests: DataFrame, batch_ts: str) -> ChangeResult:
    """Overwrite the patient's fields; with a bed: move the active stay
    there (the old bed is freed first, so the same bed is fine), or open a
    new stay when there is none and an admission date is given."""
    r = requests.withColumn("id_patient", X.to_long("id_patient")).withColumn("bed", X.to_long("id_room"))
    hot = hot_values(r, ["bed", "id_patient"])
    r = _exists(r, t.patient, "id_patient", "id_patient", "_pat")
    r = _with_bed(r, t, hot["bed"])
    cur = (current_stay(t, patients=r.select("id_patient"))
           .select("id_patient", F.col("id_stay").alias("cur_stay"), F.col("id_room").alias("old_bed")))
    r = join_split(r, cur, "id_patient", "left", hot=hot["id_patient"])
    wants_bed = ~X.is_empty("id_room")
    same = F.coalesce(F.col("old_bed") == F.col("bed"), F.lit(False))
    checked = r.withColumn("reason", _reason(
        (~F.col("_pat"), "unknown patient"),
        *_patient_checks(),
        (wants_bed & ~F.col("bed_exists"), "unknown bed"),
        (wants_bed & ~F.col("bed_free") & ~same, "bed not free"),
        (wants_bed & F.col("cur_stay").isNull() & X.is_empty("admission_date"),
         "no active stay and no admission date"),
    ))
    winners, rejects = _split(checked.withColumn("_bed_key", F.when(wants_bed, F.col("bed"))),
                              [["id_patient"], ["_bed_key"]])
    patients = _merge(t.patient, winners.select(
        "id_patient", *[F.to_date("birth_date").alias(c) if c == "birth_date" else F.col(c) for c in PATIENT_FIELDS]),
        "id_patient", PATIENT_FIELDS)
    moving = winners.filter(F.col("_bed_key").isNotNull() & F.col("cur_stay").isNotNull())
    moves = moving.select(F.col("cur_stay").alias("id_stay"), F.col("bed").alias("id_room"), "old_bed")
    stays = _merge(t.stay, moves, "id_stay", ["id_room"])
    opening = winners.filter(F.col("_bed_key").isNotNull() & F.col("cur_stay").isNull())
    new = _next_ids(opening, t.stay, "id_stay", "id_stay").select(
        "request_id", "id_stay", "id_patient", F.col("bed").alias("id_room"),
        X.parse_timestamp("admission_date", batch_ts).alias("date_in"))
    stays = stays.unionByName(_stay_rows(new).select(*t.stay.columns))
    changes = (moves.filter(F.col("old_bed").isNotNull() & (F.col("old_bed") != F.col("id_room")))
                    .select(F.col("old_bed").alias("id_room"), F.lit(True).alias("available"))
               .unionByName(moves.select("id_room", F.lit(False).alias("available")))
               .unionByName(new.select("id_room", F.lit(False).alias("available"))))
    rooms = apply_bed_changes(t.room, changes)
    return ChangeResult(t.replace(patient=patients, stay=stays, room=rooms),
                        winners.select("request_id", "id_patient"), rejects)


# ---------------------------------------------------------------- M8
def set_availability(t: Tables, requests: DataFrame) -> ChangeResult:
    """Set bed flags; with several requests for one bed the last one wins
    (they would be applied one after another), the others are rejected as
    ``superseded``."""
    r = requests.select(*ORDER, X.to_long("id_room").alias("id_room"), X.truthy("available").alias("flag"))
    r = _exists(r, t.room, "id_room", "id_room", "_bed")
    rejects = r.filter(~F.col("_bed")).select("request_id", F.lit("unknown bed").alias("reason"))
    last = latest_per_key(r.filter(F.col("_bed")), ["id_room"], ORDER, ["flag"])
    rejects = rejects.unionByName(_superseded(r.filter(F.col("_bed")), last))
    rooms = _merge(t.room, last.select("id_room", F.col("flag").alias("available")), "id_room", ["available"])
    return ChangeResult(t.replace(room=rooms), last, rejects)


# ---------------------------------------------------------------- M9
OBS_TEXT = ["state", "blood_pressure", "remark"]
OBS_REQUIRED = ["id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate", "spo2",
                "glucose", "remark", "observed_at", "weight", "height"]


def clean_observations(requests: DataFrame, batch_ts: str, strict: bool = False) -> DataFrame:
    """Cleaning of posted vitals: tags removed and text escaped, numbers to
    their column types (rounded to the column scale, NULL when out of
    range), height from cm to m, time parsed with ``batch_ts`` as default.
    ``strict``: every "empty" value (NULL, '', 0, '0') becomes NULL."""
    def val(c):
        v = F.col(c)
        return X.empty_to_null(v) if strict else v

    def txt(c):
        return X.clean_text(val(c))

    return requests.select(
        *ORDER,
        X.to_long(txt("id_stay")).alias("id_stay"),
        X.to_long(txt("id_nurse")).alias("id_nurse"),
        *[txt(c).alias(c) for c in OBS_TEXT],
        X.to_decimal(txt("temperature"), 5, 2).alias("temperature"),
        X.to_int(txt("heart_rate")).alias("heart_rate"),
        X.to_int(txt("spo2")).alias("spo2"),
        X.to_decimal(txt("glucose"), 3, 1).alias("glucose"),
        X.to_decimal(txt("weight"), 5, 2).alias("weight"),
        X.height_m("height", strict=strict).alias("height"),
        X.parse_timestamp(F.col("observed_at"), batch_ts).alias("observed_at"),
        *[F.col(c).alias("_raw_" + c) for c in ("temperature", "glucose", "weight", "height")],
        *([F.coalesce(*[F.when(val(c).isNull(), F.lit(c)) for c in OBS_REQUIRED]).alias("_missing")] if strict else []),
    )


def ingest_observations(t: Tables, requests: DataFrame, batch_ts: str, strict: bool = False,
                        id_base: Column | None = None) -> ChangeResult:
    """Append cleaned observations; a value the table cannot hold (missing,
    out of range, unknown stay or nurse) rejects the request.  New ids start
    after ``id_base`` (default: the table's greatest id)."""
    c = clean_observations(requests, batch_ts, strict)
    c = _exists(c, t.stay, "id_stay", "id_stay", "_stay")
    c = _exists(c, t.staff, "id_nurse", "id_staff", "_nurse")
    not_null = ["id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate", "spo2",
                "glucose", "weight", "height", "remark"]
    checks = []
    if strict:
        checks.append((F.col("_missing").isNotNull(), F.concat(F.lit("missing: "), F.col("_missing"))))
    for col in ("temperature", "glucose", "weight"):
        checks.append((F.col(col).isNull() & F.col("_raw_" + col).isNotNull(), f"out of range: {col}"))
    checks.append((F.coalesce(F.col("height").isNull() & (X.number_prefix("_raw_height") > 0), F.lit(False)),
                   "out of range: height"))
    checks.append((X.first_missing(not_null).isNotNull(), "missing value"))
    checks.append((~F.col("_stay"), "unknown stay"))
    checks.append((~F.col("_nurse"), "unknown nurse"))
    for col, n in schemas.TEXT_LIMITS["observation"].items():
        checks.append((F.coalesce(F.char_length(col) > n, F.lit(False)), f"too long: {col}"))
    checked = c.withColumn("reason", _reason(*checks))
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    good = checked.filter(F.col("reason").isNull())
    new = (assign_dense_ids(good, ORDER, "id_obs", id_base) if id_base is not None
           else _next_ids(good, t.observation, "id_obs", "id_obs"))
    out_cols = ["id_obs", "id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate",
                "spo2", "glucose", "weight", "height", "remark", "observed_at"]
    accepted = new.select("request_id", *out_cols)
    obs = t.observation
    if set(out_cols) <= set(obs.columns):
        obs = obs.unionByName(accepted.select(*[F.col(f.name).cast(f.dataType) for f in schemas.OBSERVATION.fields])
                              .select(*obs.columns))
    return ChangeResult(t.replace(observation=obs), accepted, rejects)


# ---------------------------------------------------------------- M10
OBS_VALUE_COLS = ["id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate", "spo2",
                  "glucose", "weight", "height", "remark", "observed_at"]


def amend_observations(t: Tables, requests: DataFrame, own_only: bool = False) -> ChangeResult:
    """Overwrite observations by id (height already in metres).  With
    ``own_only`` only 8 fields change, and only where the nurse matches;
    height and weight are kept.  Of several requests for one observation the
    last one stands, the others are rejected as ``superseded``."""
    r = requests.select(
        *ORDER, X.to_long("id_obs").alias("id_obs"), X.to_long("id_stay").alias("id_stay"),
        X.to_long("id_nurse").alias("id_nurse"), "state", "blood_pressure", "remark",
        X.to_decimal("temperature", 5, 2).alias("temperature"), X.to_int("heart_rate").alias("heart_rate"),
        X.to_int("spo2").alias("spo2"), X.to_decimal("glucose", 3, 1).alias("glucose"),
        X.to_decimal("weight", 5, 2).alias("weight"), X.to_decimal("height", 4, 2).alias("height"),
        X.parse_timestamp("observed_at", F.lit(None).cast("timestamp_ntz")).alias("observed_at"),
        *[F.col(c).alias("_raw_" + c) for c in ("temperature", "glucose", "weight", "height")])
    owner = _named(t.observation, "id_obs", r, "id_obs").select(
        "id_obs", F.col("id_nurse").alias("_owner"), F.lit(True).alias("_found"))
    r = join_split(r, owner, "id_obs", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    if own_only:
        found = found & (F.col("_owner") == F.col("id_nurse"))
        cols = ["state", "blood_pressure", "temperature", "heart_rate", "spo2", "glucose", "remark", "observed_at"]
    else:
        cols = OBS_VALUE_COLS
    checks = [(~found, "not found")]
    for col in ("temperature", "glucose", "weight", "height"):
        if col in cols:
            checks.append((F.col(col).isNull() & F.col("_raw_" + col).isNotNull(), f"out of range: {col}"))
    checks.append((X.first_missing(cols).isNotNull(), "missing value"))
    if not own_only:
        r = _exists(r, t.stay, "id_stay", "id_stay", "_stay_known")
        r = _exists(r, t.staff, "id_nurse", "id_staff", "_nurse_known")
        checks += [(~F.col("_stay_known"), "unknown stay"), (~F.col("_nurse_known"), "unknown nurse")]
    for col, n in schemas.TEXT_LIMITS["observation"].items():
        checks.append((F.coalesce(F.char_length(col) > n, F.lit(False)), f"too long: {col}"))
    checked = r.withColumn("reason", _reason(*checks))
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    good = checked.filter(F.col("reason").isNull())
    last = latest_per_key(good, ["id_obs"], ORDER, cols)
    rejects = rejects.unionByName(_superseded(good, last))
    obs = _merge(t.observation, last, "id_obs", cols)
    return ChangeResult(t.replace(observation=obs), last, rejects)


# ---------------------------------------------------------------- M11
def prescription_changes(t: Tables, requests: DataFrame) -> ChangeResult:
    """``action`` insert / update / delete; inserts get new ids.  Updates and
    deletes of one id apply in order: what comes after the first delete meets
    an unknown prescription; before it (or without one) the last update
    stands and earlier ones are rejected as ``superseded``."""
    r = requests.select(*ORDER, "action", X.to_long("id_prescription").alias("id_prescription"),
                        X.to_long("id_stay").alias("id_stay"), "drug", X.to_int("dose").alias("dose"),
                        X.to_int("frequency").alias("frequency"), "instructions")
    r = _exists(r, t.stay, "id_stay", "id_stay", "_stay")
    r = _exists(r, t.prescription, "id_prescription", "id_prescription", "_presc")
    act = F.col("action")
    lim = schemas.TEXT_LIMITS["prescription"]
    checked = r.withColumn("reason", _reason(
        (act.isNull() | ~act.isin("insert", "update", "delete"), "invalid: action"),
        ((act == "insert") & ~F.col("_stay"), "unknown stay"),
        ((act != "insert") & ~F.col("_presc"), "unknown prescription"),
        ((act != "delete") & X.first_missing(["drug", "dose", "frequency"]).isNotNull(), "missing value"),
        ((act != "delete") & F.coalesce(F.char_length("drug") > lim["drug"], F.lit(False)), "too long: drug"),
        ((act != "delete") & F.coalesce(F.char_length("instructions") > lim["instructions"], F.lit(False)),
         "too long: instructions"),
    ))
    rejects = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    ok = checked.filter(F.col("reason").isNull())
    ins = _next_ids(ok.filter(act == "insert"), t.prescription, "id_prescription", "id_prescription")
    edits = ok.filter(act != "insert")
    gone = (edits.filter(act == "delete").groupBy("id_prescription").agg(F.min(F.struct(*ORDER)).alias("_gone")))
    edits = edits.join(gone, on="id_prescription", how="left")
    late = edits.filter(F.struct(*ORDER) > F.col("_gone"))
    rejects = rejects.unionByName(late.select("request_id", F.lit("unknown prescription").alias("reason")))
    live = edits.filter(F.col("_gone").isNull() | (F.struct(*ORDER) <= F.col("_gone")))
    last = latest_per_key(live, ["id_prescription"], ORDER, ["action", "drug", "dose", "frequency", "instructions"])
    rejects = rejects.unionByName(_superseded(live, last))
    presc = _merge(t.prescription, last.filter(F.col("action") == "update"), "id_prescription",
                   ["drug", "dose", "frequency", "instructions"])
    presc = presc.join(last.filter(F.col("action") == "delete").select("id_prescription"),
                       on="id_prescription", how="left_anti")
    presc = presc.unionByName(ins.select(*[F.col(f.name).cast(f.dataType) for f in schemas.PRESCRIPTION.fields])
                              .select(*presc.columns))
    accepted = ins.select("request_id", "id_prescription", F.lit("insert").alias("action")).unionByName(
        last.select("request_id", "id_prescription", "action"))
    return ChangeResult(t.replace(prescription=presc), accepted, rejects)


# ---------------------------------------------------------------- M12
def load_staff(t: Tables, requests: DataFrame) -> ChangeResult:
    """New staff: a nurse needs a service, an admin may have none, other
    roles are refused; the email must be unique ignoring case (against the
    table and inside the batch, first request wins)."""
    r = requests.select(*ORDER, X.to_long("id_service").alias("id_service"), "full_name", "email",
                        F.lower(F.trim("role")).alias("role"))
    r = _exists(r, t.service, "id_service", "id_service", "_svc")
    r = r.withColumn("_email", F.lower("email"))
    r = _exists(r, t.staff.select(F.lower("email").alias("_staff_email")), "_email", "_staff_email", "_taken")
    lim = schemas.TEXT_LIMITS["staff"]
    checked = r.withColumn("reason", _reason(
        (~F.col("role").isin(list(schemas.ROLE_VALUES)) | F.col("role").isNull(), "unknown role"),
        ((F.col("role") == "nurse") & F.col("id_service").isNull(), "missing: id_service"),
        (F.col("id_service").isNotNull() & ~F.col("_svc"), "unknown service"),
        (X.first_missing(["full_name", "email"]).isNotNull(), "missing value"),
        (F.coalesce(F.char_length("full_name") > lim["full_name"], F.lit(False)), "too long: full_name"),
        (F.coalesce(F.char_length("email") > lim["email"], F.lit(False)), "too long: email"),
        (F.col("_taken"), "duplicate email"),
    ))
    winners, rejects = _split(checked, [["_email"]])
    rejects = rejects.withColumn("reason", F.when(F.col("reason") == "conflict", F.lit("duplicate email"))
                                 .otherwise(F.col("reason")))
    new = _next_ids(winners, t.staff, "id_staff", "id_staff")
    staff = t.staff.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in schemas.STAFF.fields])
                                .select(*t.staff.columns))
    return ChangeResult(t.replace(staff=staff), new.select("request_id", "id_staff"), rejects)

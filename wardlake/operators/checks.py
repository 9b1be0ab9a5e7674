"""Constraint checks the source database enforced on write (keys, foreign
keys, unique, not null, domains, lengths, numeric ranges, defaults) and
the bed-flag invariant.

``violations(df, rules)`` returns (good rows, bad rows with ``reason``).
A row's reason is the first rule it breaks, in the order given.  Key
rules are joins against aggregates (map-side reduced), never windows, so a
hot key costs one row per map task.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import checkpoint_dir
from ..sources.snapshot import Tables


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    cols: tuple
    arg: object = None
    name: str | None = None

    @property
    def reason(self) -> str:
        return self.name or f"{self.kind}:{','.join(self.cols)}"


def primary_key(*cols) -> Rule:
    return Rule("primary_key", tuple(cols))


def foreign_key(col: str, parent: DataFrame, parent_col: str | None = None) -> Rule:
    return Rule("foreign_key", (col,), (parent, parent_col or col))


def unique_ci(col: str, order_by: str) -> Rule:
    """Unique ignoring case; the first row by ``order_by`` keeps the value."""
    return Rule("unique", (col,), order_by)


def not_null(*cols) -> Rule:
    return Rule("not_null", tuple(cols))


def domain(col: str, values: Sequence[str]) -> Rule:
    return Rule("domain", (col,), tuple(values))


def max_length(col: str, n: int) -> Rule:
    return Rule("max_length", (col,), n)


def fits_decimal(col: str, precision: int, scale: int) -> Rule:
    return Rule("decimal_range", (col,), (precision, scale))


def int_range(col: str, lo: int = -(2 ** 31), hi: int = 2 ** 31 - 1) -> Rule:
    return Rule("int_range", (col,), (lo, hi))


def _row_test(rule: Rule) -> Column | None:
    """Column that is True when the row breaks the rule (row-local rules)."""
    c = F.col(rule.cols[0])
    if rule.kind == "not_null":
        bad = F.lit(False)
        for name in rule.cols:
            bad = bad | F.col(name).isNull()
        return bad
    if rule.kind == "domain":
        return c.isNotNull() & ~c.isin(list(rule.arg))
    if rule.kind == "max_length":
        return F.coalesce(F.char_length(c) > rule.arg, F.lit(False))
    if rule.kind == "decimal_range":
        p, s = rule.arg
        return c.isNotNull() & c.cast("string").try_cast(f"decimal({p},{s})").isNull()
    if rule.kind == "int_range":
        lo, hi = rule.arg
        v = c.cast("string").try_cast("decimal(38,0)")
        return c.isNotNull() & (v.isNull() | (v < lo) | (v > hi))
    return None


KEY_KINDS = ("primary_key", "foreign_key", "unique")


def _whole_number(df: DataFrame, cols: Sequence[str]) -> bool:
    return len(cols) == 1 and dict(df.dtypes)[cols[0]] in ("tinyint", "smallint", "int", "bigint")


def _key(df: DataFrame, rule: Rule, cols: Sequence[str]) -> tuple[Column, Column]:
    """A rule's key as (number, text): whole numbers stay numbers, all else is text."""
    if _whole_number(df, cols):
        return F.col(cols[0]).cast("bigint"), F.lit(None).cast("string")
    text = F.col(cols[0]).cast("string") if len(cols) == 1 else F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
    return F.lit(None).cast("bigint"), F.lower(text) if rule.kind == "unique" else text


def _broken_keys(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The keys that break a rule, for all key rules of a table in one pass:
    each row gives an entry per rule, each parent table its keys, and one
    aggregate by (rule, key) counts them.  It is combined before the shuffle,
    so a key that very many rows hold is one row per task.  Written as a table:
    broken keys are few as a rule, and the planner then knows their size."""
    spark = df.sparkSession
    entries, parents, broken = [], [], F.lit(False)
    orders = {i: r.arg for i, r in enumerate(rules) if r.kind == "unique"}
    for i, rule in enumerate(rules):
        if rule.kind not in KEY_KINDS:
            continue
        number, text = _key(df, rule, rule.cols)
        whole = F.lit(True)
        for c in rule.cols:
            whole = whole & F.col(c).isNotNull()
        entries.append(F.when(whole, F.struct(F.lit(i).alias("rule"), number.alias("number"), text.alias("text"),
                                              *[F.col(c).alias(f"o{j}") for j, c in orders.items()])))
        if rule.kind == "foreign_key":
            parent, pcol = rule.arg
            number, text = _key(parent, rule, [pcol])
            parents.append(parent.select(F.lit(i).alias("rule"), number.alias("number"), text.alias("text")))
            broken = broken | ((F.col("rule") == i) & F.col("parent").isNull())
        else:
            broken = broken | ((F.col("rule") == i) & (F.col("n") > 1))
    keys = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*", F.lit(1).alias("child"))
    for p in parents:
        keys = keys.unionByName(p.withColumn("parent", F.lit(True)), allowMissingColumns=True)
    if not parents:
        keys = keys.withColumn("parent", F.lit(None).cast("boolean"))
    found = keys.groupBy("rule", "number", "text").agg(
        F.count("child").alias("n"), F.max("parent").alias("parent"), *[F.min(f"o{j}").alias(f"o{j}") for j in orders])
    found = found.filter((F.col("n") > 0) & broken).drop("n", "parent")
    path = f"{checkpoint_dir(spark).rstrip('/')}/broken-keys-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def violations(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one, with the ``reason``:
    the first broken rule).  One shuffle finds the broken keys of all key rules
    (``_broken_keys``); the rows then meet those, few as they are, and the
    other rules are tested on the row itself."""
    flagged = df
    tests: list[tuple[str, Column]] = []
    keys = _broken_keys(df, rules) if any(r.kind in KEY_KINDS for r in rules) else None
    for i, rule in enumerate(rules):
        if rule.kind not in KEY_KINDS:
            tests.append((rule.reason, _row_test(rule)))
            continue
        flag, order = f"_rule_{i}_flag", f"_rule_{i}_first"
        number, text = _key(df, rule, rule.cols)
        by, own = ("number", number) if _whole_number(df, rule.cols) else ("text", text)
        mine = keys.filter(F.col("rule") == i).select(
            F.col(by).alias(f"_rule_{i}_key"), F.lit(True).alias(flag), *([F.col(f"o{i}").alias(order)] if rule.kind == "unique" else []))
        flagged = flagged.join(mine, own == F.col(f"_rule_{i}_key"), "left")
        hit = F.coalesce(F.col(flag), F.lit(False))
        if rule.kind == "unique":  # the first row keeps the value
            hit = hit & ~F.col(rule.arg).eqNullSafe(F.col(order))
        if rule.kind == "primary_key":
            for k in rule.cols:
                hit = hit | F.col(k).isNull()
        tests.append((rule.reason, hit))
    reason = F.coalesce(*[F.when(t, F.lit(r)) for r, t in tests]) if tests else F.lit(None).cast("string")
    helper = [c for c in flagged.columns if c not in df.columns]
    out = flagged.withColumn("reason", reason).drop(*helper)
    good = out.filter(F.col("reason").isNull()).drop("reason")
    bad = out.filter(F.col("reason").isNotNull())
    return good, bad


# The observation columns that may not be missing, and the decimal columns' sizes.
OBS_NOT_NULL = ("id_stay", "id_nurse", "state", "blood_pressure", "temperature", "heart_rate", "spo2", "glucose", "weight",
                "height", "remark")
OBS_DECIMALS = {"temperature": (5, 2), "glucose": (3, 1), "weight": (5, 2), "height": (4, 2)}


def default_rules(t: Tables) -> dict[str, list[Rule]]:
    """The source schema's constraints for each table."""
    lim = schemas.TEXT_LIMITS
    obs_key = ("id_obs",) if "id_obs" in t.observation.columns else ("id_stay", *t.obs_ties)
    presc_key = ("id_prescription",) if "id_prescription" in t.prescription.columns else None
    rules = {
        "service": [primary_key("id_service"), not_null("name"), max_length("name", lim["service"]["name"])],
        "room": [primary_key("id_room"), not_null("id_service", "room_no"),
                 foreign_key("id_service", t.service)],
        "staff": [primary_key("id_staff"), not_null("full_name", "email", "role"),
                  foreign_key("id_service", t.service), domain("role", schemas.ROLE_VALUES),
                  unique_ci("email", "id_staff")]
                 + [max_length(c, n) for c, n in lim["staff"].items()],
        "patient": [primary_key("id_patient"),
                    not_null("full_name", "nin", "birth_date", "sex", "address", "blood_group"),
                    domain("sex", schemas.SEX_VALUES)]
                   + [max_length(c, n) for c, n in lim["patient"].items()],
        "stay": [primary_key("id_stay"), not_null("id_patient"),
                 foreign_key("id_patient", t.patient), foreign_key("id_room", t.room)],
        "prescription": ([primary_key(*presc_key)] if presc_key else [])
                        + [not_null("id_stay", "drug", "dose", "frequency"), foreign_key("id_stay", t.stay),
                           int_range("dose", -2**31, 2**31 - 1), int_range("frequency", -2**31, 2**31 - 1)]
                        + [max_length(c, n) for c, n in lim["prescription"].items()
                           if c in t.prescription.columns],
        "observation": [primary_key(*obs_key), not_null(*[c for c in OBS_NOT_NULL if c in t.observation.columns]),
                        foreign_key("id_stay", t.stay),
                        foreign_key("id_nurse", t.staff, "id_staff")]
                       + [fits_decimal(c, p, s) for c, (p, s) in OBS_DECIMALS.items() if c in t.observation.columns]
                       + [int_range(c, -2**31, 2**31 - 1) for c in ("heart_rate", "spo2") if c in t.observation.columns]
                       + [max_length(c, n) for c, n in lim["observation"].items()
                          if c in t.observation.columns],
    }
    return rules


TABLE_KEYS = {"service": ("id_service",), "room": ("id_room",), "staff": ("id_staff",),
              "patient": ("id_patient",), "stay": ("id_stay",)}


def table_violations(t: Tables) -> DataFrame:
    """All rule breaks of a snapshot: (table_name, row_key, reason)."""
    parts = []
    rules = default_rules(t)
    for name, df in t.as_dict().items():
        _, bad = violations(df, rules[name])
        if name in TABLE_KEYS:
            keys = TABLE_KEYS[name]
        elif name == "observation":
            keys = ("id_obs",) if "id_obs" in df.columns else ("id_stay", *t.obs_ties)
        else:
            keys = ("id_prescription",) if "id_prescription" in df.columns else ("id_stay", *t.presc_order)
        row_key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        parts.append(bad.select(F.lit(name).alias("table_name"), row_key.alias("row_key"), "reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bed_flag_mismatches(t: Tables) -> DataFrame:
    """Beds whose ``available`` flag disagrees with the active stays in
    them (free but occupied, or taken but empty)."""
    active = (t.stay.filter(F.col("date_out").isNull() & F.col("id_room").isNotNull())
                    .groupBy("id_room").agg(F.count(F.lit(1)).alias("active_stays")))
    beds = t.room.select("id_room", "available").join(active, on="id_room", how="left")
    n = F.coalesce(F.col("active_stays"), F.lit(0)).cast("bigint")
    free = F.coalesce(F.col("available"), F.lit(False))
    return (beds.select("id_room", F.col("available"), n.alias("active_stays"))
                .filter((free & (n > 0)) | (~free & (n == 0))))


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults of the source schema (C8) for missing values."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                       for c in df.columns])


def change_services(t: Tables, changes: DataFrame) -> tuple[Tables, DataFrame]:
    """Removals and renames of services in one step, with what the source's
    foreign keys do (C2, C9): (new tables, rejects).

    ``changes``: request_id, id_service, new_id_service (NULL: remove).  Beds
    refuse the removal of their service; its staff keep their row without a
    service.  A new key is carried to beds and staff.  All renames are one
    mapping old -> new, so swaps and chains (1 -> 2, 2 -> 3) move every row
    once.  Of several requests for a service the first in request id order
    counts; a new key must be free, or be freed by another rename of the batch
    that itself stands, and is taken by one service only."""
    checkpoint_dir(t.service.sparkSession)
    known = t.service.select("id_service")
    used = t.room.select("id_service").distinct().withColumn("_beds", F.lit(True))
    first = changes.groupBy("id_service").agg(F.min(F.struct("request_id", "new_id_service")).alias("_f"))
    first = first.select("id_service", F.col("_f.request_id").alias("_first"))
    r = (changes.join(first, on="id_service", how="left").join(known.withColumn("_known", F.lit(True)), on="id_service", how="left")
                .join(used, on="id_service", how="left"))
    target = F.col("new_id_service")
    r = r.withColumn("reason", F.coalesce(
        F.when(F.col("id_service").isNull() | F.col("_known").isNull(), F.lit("unknown service")),
        F.when(F.col("request_id") != F.col("_first"), F.lit("conflict")),
        F.when(target.isNull() & F.coalesce("_beds", F.lit(False)), F.lit("service has beds"))))
    ok = r.filter(F.col("reason").isNull()).select("request_id", "id_service", "new_id_service")
    refused = r.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    # one service per new key; then a rename whose key is not free falls, and with it those that wait for its old key
    taker = ok.filter(target.isNotNull()).groupBy("new_id_service").agg(F.min("request_id").alias("request_id"))
    twice = ok.filter(target.isNotNull()).join(taker.select("request_id"), on="request_id", how="left_anti")
    refused = refused.unionByName(twice.select("request_id", F.lit("key taken").alias("reason")))
    standing = ok.join(twice.select("request_id"), on="request_id", how="left_anti").checkpoint(eager=True)
    while True:
        leaving = standing.filter(target.isNull() | (target != F.col("id_service"))).select("id_service")
        held = known.join(leaving, on="id_service", how="left_anti").withColumnRenamed("id_service", "new_id_service")
        blocked = (standing.filter(target.isNotNull() & (target != F.col("id_service")))
                           .join(held, on="new_id_service", how="left_semi").select("request_id")).checkpoint(eager=True)
        if not blocked.limit(1).count():
            break
        refused = refused.unionByName(blocked.select("request_id", F.lit("key taken").alias("reason")))
        standing = standing.join(blocked, on="request_id", how="left_anti").checkpoint(eager=True)
    mapping = standing.select("id_service", "new_id_service", F.lit(True).alias("_hit"))

    def moved(df: DataFrame) -> DataFrame:
        return (df.join(mapping, on="id_service", how="left")
                  .withColumn("id_service", F.when(F.col("_hit"), F.col("new_id_service")).otherwise(F.col("id_service")))
                  .select(*df.columns))

    service = moved(t.service).filter(F.col("id_service").isNotNull())
    return t.replace(service=service, room=moved(t.room), staff=moved(t.staff)), refused


def cascade_service_delete(staff: DataFrame, removed_services: DataFrame) -> DataFrame:
    """Staff of a removed service keep their row with no service (C9)."""
    gone = removed_services.select("id_service").distinct().withColumn("_gone", F.lit(True))
    return (staff.join(gone, on="id_service", how="left")
                 .withColumn("id_service", F.when(F.col("_gone").isNull(), F.col("id_service")))
                 .select(*staff.columns))


def cascade_service_rename(staff: DataFrame, renames: DataFrame) -> DataFrame:
    """Key update of services: ``renames`` has (id_service, new_id_service)."""
    return (staff.join(renames, on="id_service", how="left")
                 .withColumn("id_service", F.coalesce(F.col("new_id_service"), F.col("id_service")))
                 .select(*staff.columns))

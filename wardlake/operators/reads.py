"""Read operators: every question of the ward application, answered for all
keys at once.  A key argument narrows the answer; Catalyst pushes that
filter into the Parquet scans.

Join strategy: no broadcast hints.  Dimension sides (services, beds, staff)
are small in practice but grow with the hospital, so the planner picks the
join from statistics and AQE re-plans with the measured shuffle sizes:
a side under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` becomes a
broadcast, a bigger one stays a sort-merge join whose skewed partitions AQE
splits.  Fact-to-fact joins are always on a key reduced to one row per key
first (``latest_per_key``), so no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import age_years, contains_folded, day_text, fold, grams, like_ci, literal_runs, run_grams
from ..sources.snapshot import Tables
from .hot import HOT_ROWS, join_split
from .latest import latest_per_key
from .ordered import CHUNK_ROWS, list_chunks

ENTRY = 16  # characters of an entry of the search index, at most
ASK_ROWS = 100     # askings of a term in one list, at most
HIT_ROWS = 10_000  # rows of a term that meet its askings in one part, about
PATIENT_COLS = ["id_patient", "full_name", "nin", "birth_date", "sex", "address", "phone", "blood_group"]


def _keys_df(t_df: DataFrame, col: str, keys) -> DataFrame:
    """Narrow ``t_df`` to the given keys: a list (pushed down as IN) or a
    DataFrame with that column (semi join)."""
    if keys is None:
        return t_df
    if isinstance(keys, DataFrame):
        return t_df.join(keys.select(col).distinct(), on=col, how="left_semi")
    if not isinstance(keys, Iterable) or isinstance(keys, (str, bytes)):
        keys = [keys]
    return t_df.filter(F.col(col).isin(list(keys)))


def _service_names(t: Tables) -> DataFrame:
    return t.service.select("id_service", F.col("name").alias("service_name"))


def with_bed_and_service(df: DataFrame, t: Tables, bed_cols: list[str], how: str = "left") -> DataFrame:
    """Join ``df`` (with ``id_room``) to its bed and then to the bed's
    service.  Two joins against the base tables, not one against a
    pre-joined view: each side keeps its own size estimate, so a small
    table is broadcast by the static plan and a large one is not."""
    cols = ["id_room", *[c for c in bed_cols if c != "id_room"]]
    if "id_service" not in cols:
        cols.append("id_service")
    return (df.join(t.room.select(*cols), on="id_room", how=how)
              .join(_service_names(t), on="id_service", how=how))


def newest_observation(t: Tables, with_nurse: bool = False, stays: DataFrame | None = None,
                       payload: list[str] | None = None) -> DataFrame:
    """Newest observation per stay (by time, then the tie-break columns).

    ``with_nurse`` first keeps only observations whose nurse exists and adds
    the nurse's name, as the stay summary does.  ``stays`` (a DataFrame with
    ``id_stay``) restricts the work to those stays before aggregating: a
    semi join the planner broadcasts when the stay set is small, and whose
    ``id_stay`` partitioning the aggregate reuses when it is large.
    ``payload``: the columns wanted (default all); only these are read."""
    obs = t.observation
    if stays is not None:
        obs = obs.join(stays.select("id_stay"), on="id_stay", how="left_semi")
    if with_nurse:
        nurses = t.staff.select(F.col("id_staff").alias("id_nurse"), F.col("full_name").alias("nurse_name"))
        obs = obs.join(nurses, on="id_nurse", how="inner")
    return latest_per_key(obs, ["id_stay"], ["observed_at", *t.obs_ties], payload)


def _obs_payload(t: Tables) -> list[str]:
    ties = [c for c in t.obs_ties if c != "id_obs"]  # the id is part of the answer
    return [c for c in t.observation.columns if c not in ("id_stay", *ties)]


# ---------------------------------------------------------------- Q1
def roster(t: Tables, active_only: bool = False) -> DataFrame:
    """One row per stay that holds a bed: patient, sex and service name.
    Ended stays that still hold a bed count unless ``active_only``."""
    stays = t.stay.filter(F.col("id_room").isNotNull())
    if active_only:
        stays = stays.filter(F.col("date_out").isNull())
    return (with_bed_and_service(stays.select("id_stay", "id_patient", "id_room"), t, [], how="inner")
                 .join(t.patient.select("id_patient", "full_name", "sex"), on="id_patient", how="inner")
                 .select("id_stay", "id_patient", "full_name", "sex", "service_name"))


# ---------------------------------------------------------------- Q2
def patient_card(t: Tables, as_of, patients=None) -> DataFrame:
    """Patient with the stay of greatest id, its bed, service and the age.
    Birth and entry dates are cut to the day; the end date is not."""
    patient = _keys_df(t.patient, "id_patient", patients)
    stays = _keys_df(t.stay, "id_patient", patients)
    last = latest_per_key(stays, ["id_patient"], ["id_stay"], ["date_in", "date_out", "id_room"])
    return (with_bed_and_service(patient.join(last, on="id_patient", how="left"), t, ["room_no"])
                   .select(*[c for c in PATIENT_COLS if c != "birth_date"],
                           day_text("birth_date").alias("birth_date"),
                           "id_stay", day_text("date_in").alias("date_in"), "date_out", "id_room",
                           "room_no", "service_name", "id_service",
                           age_years("birth_date", as_of).alias("age")))


# ---------------------------------------------------------------- Q3
def patient_detail(t: Tables, as_of, patients=None) -> DataFrame:
    """Patient with an active stay and that stay's newest observation, the
    bed, the service and the age; one row per patient.  With several active
    stays, the one with the newest observation wins (then newest entry)."""
    patient = _keys_df(t.patient, "id_patient", patients)
    active = _keys_df(t.stay, "id_patient", patients).filter(F.col("date_out").isNull())
    obs = newest_observation(t, stays=active.select("id_stay"))
    payload = _obs_payload(t)
    stay_obs = (active.select("id_stay", "id_patient", "date_in", "date_out", "id_room")
                      .join(obs, on="id_stay", how="left"))
    pick = latest_per_key(stay_obs, ["id_patient"],
                          ["observed_at", *t.obs_ties, "date_in", "id_stay"],
                          ["date_out", "id_room", *payload])
    return (with_bed_and_service(patient.join(pick, on="id_patient", how="left"), t, ["room_no"])
                   .select(*[c for c in PATIENT_COLS if c != "birth_date"],
                           day_text("birth_date").alias("birth_date"),
                           "id_stay", "date_in", "date_out", "room_no", "service_name",
                           *[c for c in payload if c not in ("date_in", "date_out")],
                           age_years("birth_date", as_of).alias("age")))


# ---------------------------------------------------------------- Q4
def admin_overview(t: Tables, as_of, ordered: bool = True) -> DataFrame:
    """Every patient with the newest stay (by entry time, then id), its bed,
    service and the age; ordered by name (case and accents ignored)."""
    last = latest_per_key(t.stay, ["id_patient"], ["date_in", "id_stay"], ["date_out", "id_room"])
    out = (with_bed_and_service(t.patient.join(last, on="id_patient", how="left"), t, ["room_no", "bed_no"])
                    .select(*PATIENT_COLS, "id_stay", "date_in", "date_out", "id_room", "room_no",
                            "bed_no", "id_service", "service_name",
                            age_years("birth_date", as_of).alias("age")))
    if ordered:
        out = out.orderBy(F.collate(F.col("full_name"), "UNICODE_CI_AI"), F.col("id_patient"))
    return out


# ---------------------------------------------------------------- Q5
def _nurse_services(t: Tables) -> DataFrame:
    return t.staff.filter((F.col("role") == "nurse") & F.col("id_service").isNotNull()).select("id_service")


def _census_rows(t: Tables, services: DataFrame) -> DataFrame:
    """Active stays with a bed in one of ``services``, their bed, service and patient."""
    active = t.stay.filter(F.col("date_out").isNull() & F.col("id_room").isNotNull())
    return (with_bed_and_service(active, t, ["room_no", "bed_no"], how="inner")
                    .join(services, on="id_service", how="left_semi")
                    .join(t.patient.select(*PATIENT_COLS), on="id_patient", how="inner"))


def service_census(t: Tables, staff=None, ordered: bool = True, per_staff: bool = False,
                   matches: Column | None = None) -> DataFrame:
    """Patients now in a bed, with the newest health state of the stay.

    One row per active stay with a bed, keyed by service, for every service
    that has a nurse.  With ``staff`` (ids or a DataFrame of ``id_staff``):
    only the services of those nurses, still one row per stay, so many
    nurses of one service never multiply its census.  ``per_staff=True``
    repeats the rows once per asking nurse (``id_staff`` first), the shape
    of a single nurse's answer; its size is nurses x census, so use it for a
    bounded set of nurses.  ``matches``: a condition on the patient columns,
    applied before observations are read.  Ordered by entry time, newest first."""
    services = _nurse_services(t)
    nurses = None
    if staff is not None:
        nurses = (_keys_df(t.staff, "id_staff", staff)
                  .filter((F.col("role") == "nurse") & F.col("id_service").isNotNull())
                  .select("id_staff", "id_service"))
        services = nurses.select("id_service")
    census = _census_rows(t, services)
    if matches is not None:
        census = census.filter(matches)
    # the observations of the rows asked for, not of every active stay
    state = (newest_observation(t, stays=census.select("id_stay"), payload=["state"])
             .select("id_stay", F.col("state").alias("latest_state")))
    census = census.join(state, on="id_stay", how="left")
    cols = ["id_service", "service_name", *PATIENT_COLS, "id_stay", "date_in", "date_out",
            "id_room", "room_no", "bed_no", "latest_state"]
    first = "id_service"
    if nurses is not None and per_staff:
        census = nurses.join(census, on="id_service", how="inner")
        cols, first = ["id_staff", *cols], "id_staff"
    out = census.select(*cols)
    if ordered:
        out = out.orderBy(F.col(first), F.col("date_in").desc(), F.col("id_stay"))
    return out


# ---------------------------------------------------------------- Q6
def name_or_nin_matches(term, wildcards: bool = False) -> Column:
    test = like_ci if wildcards else contains_folded
    return test("full_name", term) | test("nin", term)


def search_patients(t: Tables, term: str, staff=None, wildcards: bool = False) -> DataFrame:
    """The census rows whose patient name or national id contains ``term``
    (case and accents ignored).  ``wildcards=True`` lets ``%`` and ``_`` in
    the term match any text / one character, as an unescaped LIKE does."""
    return service_census(t, staff=staff, ordered=False, matches=name_or_nin_matches(term, wildcards))


def search_patients_batch(t: Tables, terms: DataFrame, wildcards: bool = False) -> DataFrame:
    """Many searches at once.  ``terms`` has ``term_id``, ``term`` and
    ``id_staff`` (the nurse asking); each term is matched against the census
    of its nurse's service (case and accents ignored).

    The census rows' folded name and national id are indexed by their distinct
    substrings of the lengths that the terms ask for, at most ``ENTRY``
    characters.  A term is looked up by its first ``ENTRY`` characters, so the rows
    found are its answer or, for a longer term, nearly; with ``wildcards`` a
    pattern is looked up by the rarest of its literal runs.  Only these rows are
    verified, so no term is compared with every patient of the service, but one
    without any literal character (``''``, ``%``, ``__``), whose answer is the
    service's census but for its lengths.  Equal terms of a service are looked up
    once.

    The answer has a row per asking and matching row, so many askings of
    a term that many rows match give their product.  It is made behind the last
    join and goes through no shuffle: before, each distinct term carries its rows
    once.  There a row meets the askings of its term as lists of at most
    ``ASK_ROWS``, which are opened last, so what is held at once is bounded.  The
    rows of a term with more than ``HIT_ROWS`` of them are dealt out over parts, and
    its lists are copied once per part: at most a ``HIT_ROWS``-th of the answer."""
    nurses = (t.staff.filter((F.col("role") == "nurse") & F.col("id_service").isNotNull())
                     .select("id_staff", "id_service"))
    asks = (terms.select("term_id", "term", "id_staff").join(nurses, on="id_staff", how="inner")
                 .withColumn("_nterm", fold("term")).filter(F.col("_nterm").isNotNull()))
    keyed = _census_rows(t, _nurse_services(t)).select(
        "id_service", "id_stay", fold("full_name").alias("_nname"), fold("nin").alias("_nnin"))
    wanted = asks.select("id_service", "_nterm").distinct()
    runs = literal_runs("_nterm", wildcards)
    need_of = run_grams(runs, ENTRY) if wildcards else F.transform(runs, lambda r: F.substring(r, 1, ENTRY))
    wanted = wanted.withColumn("_need", need_of)

    def matches(col: str) -> Column:
        return like_ci(F.col(col), F.col("_nterm")) if wildcards else F.contains(F.col(col), F.col("_nterm"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.coalesce(matches("_nname"), F.lit(False)) | F.coalesce(matches("_nnin"), F.lit(False))).select(
            "id_service", "_nterm", "id_stay")

    need = wanted.select("id_service", "_nterm", F.explode("_need").alias("_g"))
    # a row per service with at most ENTRY numbers
    lengths = need.groupBy("id_service").agg(F.collect_set(F.char_length("_g")).alias("_lengths"))
    entries = F.array_distinct(F.flatten(F.transform("_lengths", lambda n: F.concat(grams("_nname", n), grams("_nnin", n)))))
    postings = (keyed.join(F.broadcast(lengths), on="id_service", how="inner")
                     .select("id_service", "id_stay", "_nname", "_nnin", F.explode(entries).alias("_g")))
    if wildcards:
        postings = postings.join(need.select("id_service", "_g").distinct(), on=["id_service", "_g"], how="left_semi")
        freq = postings.groupBy("id_service", "_g").agg(F.count(F.lit(1)).alias("_f"))
        # an entry that no row has makes its term empty: it counts as the rarest
        rarest = latest_per_key(need.join(freq, on=["id_service", "_g"], how="left").withColumn("_f", F.coalesce("_f", F.lit(0))),
                                ["id_service", "_nterm"], ["_f", "_g"], newest=False)
        need = rarest.filter(F.col("_f") > 0).select("id_service", "_nterm", "_g")
    hits = verified(need.join(postings, on=["id_service", "_g"], how="inner"))
    open_ = wanted.filter(F.size("_need") == 0).select("id_service", "_nterm")
    hits = hits.unionByName(verified(open_.join(keyed, on="id_service", how="inner")))
    # the rows by stay, read twice: to count a term's rows, and to meet the census
    key = ["_asked", "_nterm"]
    hits = hits.withColumnRenamed("id_service", "_asked").filter(F.col("id_stay").isNotNull()).repartition("id_stay")
    # at most a row per HIT_ROWS hits
    hot = F.broadcast(hits.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HIT_ROWS)
                          .select(*key, F.ceil(F.col("_n") / HIT_ROWS).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    census = service_census(t, ordered=False)
    rows = (hits.join(hot, on=key, how="left").withColumn("_part", F.pmod(F.xxhash64("id_stay"), parts)).drop("_parts")
                .join(census, on="id_stay", how="inner"))
    asked = (_ask_lists(asks.select(F.col("id_service").alias("_asked"), "_nterm", "term_id", "id_staff"), key)
             .join(hot, on=key, how="left")
             .select(*key, "_who", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part")))
    return (rows.join(asked, on=[*key, "_part"], how="inner").select(*census.columns, F.inline("_who"))
                .select("term_id", "id_staff", *census.columns))


def _ask_lists(asks: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``_who``: the askings (``term_id``, ``id_staff``) of a key as
    lists of at most ``ASK_ROWS``.  They are cut in a range-partitioned order, so a
    key that is asked very often is neither one list nor one task."""
    order = [*key, "term_id", "id_staff"]
    cut = F.floor(F.monotonically_increasing_id() / ASK_ROWS)
    return (asks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_list", cut)
                .groupBy(*key, "_list").agg(F.collect_list(F.struct("term_id", "id_staff")).alias("_who")).drop("_list"))


# ---------------------------------------------------------------- Q7, Q8
def free_rooms(t: Tables, services=None) -> DataFrame:
    """Available beds, with their service."""
    beds = _keys_df(t.room, "id_service", services)
    return (beds.filter(F.col("available") == F.lit(True))
                .select("id_room", "room_no", "bed_no", "available", "id_service"))


def free_rooms_for_staff(t: Tables, staff, per_staff: bool = False) -> DataFrame:
    """Available beds of the named staff members' services (the role is not
    checked; unknown staff or staff without a service add nothing).  One row
    per bed; ``per_staff=True`` repeats it per asking staff member
    (``id_staff`` first), for a bounded set of staff."""
    who = _keys_df(t.staff, "id_staff", staff).select("id_staff", "id_service")
    if per_staff:
        return (who.join(free_rooms(t), on="id_service", how="inner")
                   .select("id_staff", "id_room", "room_no", "bed_no", "available"))
    return free_rooms(t).join(who.select("id_service"), on="id_service", how="left_semi")


# ---------------------------------------------------------------- Q9, Q10
def stay_prescriptions(t: Tables, stays=None) -> DataFrame:
    """All prescriptions of the given stays (all stays by default)."""
    return _keys_df(t.prescription, "id_stay", stays)


def stay_prescriptions_checked(t: Tables, stays=None) -> DataFrame:
    """As ``stay_prescriptions`` but only for stays that exist."""
    presc = _keys_df(t.prescription, "id_stay", stays)
    return presc.join(_keys_df(t.stay, "id_stay", stays).select("id_stay"), on="id_stay", how="left_semi")


# ---------------------------------------------------------------- Q11
LAST_OBS_NAMES = {"remark": "last_remark", "observed_at": "last_obs_at", "state": "last_state",
                  "blood_pressure": "last_blood_pressure", "temperature": "last_temperature",
                  "heart_rate": "last_heart_rate", "spo2": "last_spo2", "glucose": "last_glucose",
                  "weight": "last_weight", "height": "last_height", "nurse_name": "last_obs_by"}


def _last_obs_for_summary(t: Tables, stays) -> DataFrame:
    obs = newest_observation(t.replace(observation=_keys_df(t.observation, "id_stay", stays)), with_nurse=True)
    return obs.select("id_stay", *[F.col(c).alias(a) for c, a in LAST_OBS_NAMES.items() if c in obs.columns])


def stay_summary(t: Tables, stays=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per stay: its prescriptions and its newest observation (with the
    nurse's name), flat: one row per (stay, prescription), or one row with
    empty prescription columns for a stay without any.  The prescription
    order columns are kept so the list order is explicit.

    The stays with their newest observation, one row each, meet the
    prescriptions in a join that deals out the prescriptions of a stay with
    more than ``hot_rows`` of them over several tasks; the stays without any
    follow by an anti join against the distinct keys, which are combined on
    the map side."""
    presc_cols = [c for c in t.prescription.columns if c != "id_stay"]
    base = (_keys_df(t.stay, "id_stay", stays).select("id_stay")
            .join(_last_obs_for_summary(t, stays), on="id_stay", how="left"))
    last = [c for c in base.columns if c != "id_stay"]
    presc = _keys_df(t.prescription, "id_stay", stays)
    some = join_split(presc, base, "id_stay", hot_rows=hot_rows).select("id_stay", *presc_cols, *last)
    none = base.join(presc.select("id_stay").distinct(), on="id_stay", how="left_anti")
    return some.unionByName(none, allowMissingColumns=True)


def stay_summary_nested(t: Tables, stays) -> DataFrame:
    """The nested answer (prescription list in order + newest observation
    struct) for the named stays.  Meant for a bounded set of stays: the list
    of one stay is built in one task; see ``stay_summary_chunks``."""
    presc = _keys_df(t.prescription, "id_stay", stays)
    order = list(t.presc_order)
    fields = order + [c for c in ("drug", "dose", "frequency", "instructions") if c not in order]
    lists = presc.groupBy("id_stay").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_p"))
    lists = lists.select("id_stay", F.transform("_p", lambda p: F.struct(
        p["drug"].alias("drug"), p["dose"].alias("dose"), p["frequency"].alias("frequency"),
        p["instructions"].alias("instructions"))).alias("prescriptions"))
    last = _last_obs_for_summary(t, stays)
    last = last.select("id_stay", F.struct(*[c for c in last.columns if c != "id_stay"]).alias("latest_obs"))
    base = _keys_df(t.stay, "id_stay", stays).select("id_stay")
    return (base.join(lists, on="id_stay", how="left").join(last, on="id_stay", how="left")
                .select("id_stay", F.coalesce("prescriptions", F.array().cast(lists.schema["prescriptions"].dataType))
                        .alias("prescriptions"), "latest_obs"))


def stay_summary_chunks(t: Tables, stays=None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The nested answer for all stays with rows of bounded size: (id_stay,
    chunk, prescriptions, latest_obs), the ordered prescription list cut after
    every ``chunk_rows`` entries.  Every stay has chunk 0, which carries its
    newest observation; its list is empty for a stay without prescriptions."""
    fields = ["drug", "dose", "frequency", "instructions"]
    lists = list_chunks(_keys_df(t.prescription, "id_stay", stays), "id_stay", t.presc_order, fields, "prescriptions", chunk_rows)
    last = _last_obs_for_summary(t, stays)
    last = last.select("id_stay", F.struct(*[c for c in last.columns if c != "id_stay"]).alias("latest_obs"))
    first = (_keys_df(t.stay, "id_stay", stays).select("id_stay", F.lit(0).cast("bigint").alias("chunk"))
             .join(last, on="id_stay", how="left"))
    known = lists.join(first.select("id_stay"), on="id_stay", how="left_semi")
    return (first.join(known, on=["id_stay", "chunk"], how="full")
                 .select("id_stay", "chunk", F.coalesce("prescriptions", F.array().cast(lists.schema["prescriptions"].dataType))
                         .alias("prescriptions"), "latest_obs"))


# ---------------------------------------------------------------- Q12 .. Q16
def lookup(requests: DataFrame, table: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Left join of requests to a keyed table: a missing key gives NULLs."""
    return requests.join(table.select(key, *cols), on=key, how="left")


def stay_room(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Bed of each stay (NULL for a stay without bed or an unknown stay)."""
    if requests is None:
        return t.stay.select("id_stay", "id_room")
    return lookup(requests, t.stay, "id_stay", ["id_room"])


def room_service(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    if requests is None:
        return t.room.select("id_room", "id_service")
    return lookup(requests, t.room, "id_room", ["id_service"])


def staff_service(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    if requests is None:
        return t.staff.select("id_staff", "id_service")
    return lookup(requests, t.staff, "id_staff", ["id_service"])


def current_stay(t: Tables, patients=None) -> DataFrame:
    """Newest active stay per patient (by entry time, then id)."""
    active = _keys_df(t.stay, "id_patient", patients).filter(F.col("date_out").isNull())
    return latest_per_key(active, ["id_patient"], ["date_in", "id_stay"], ["id_room"])


def room_available(t: Tables, requests: DataFrame) -> DataFrame:
    """Is each requested bed free?  A bed that does not exist is not."""
    flags = t.room.select("id_room", F.col("available").alias("_avail"))
    return (requests.join(flags, on="id_room", how="left")
                    .withColumn("available", F.coalesce(F.col("_avail"), F.lit(False)))
                    .drop("_avail"))

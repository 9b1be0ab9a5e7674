"""Change requests: decoded from JSON lines with an explicit schema, or
derived from the driver's ``events`` table for tests at scale.

Malformed JSON lines land in ``_corrupt_record`` and become rejects, never
silent drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_json_requests(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Read JSON-lines requests.  Returns (parsed requests, malformed lines
    with reason)."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(full).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    # Both halves read more than the corrupt column, which Spark requires of
    # a raw JSON scan; no cache is needed.
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).select(
        F.col("request_id"), F.col("_corrupt_record").alias("payload"), F.lit("malformed").alias("reason"))
    good = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, bad


def decode_json_column(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Decode a JSON text column into typed columns (NULL fields when the
    text is not an object)."""
    return df.withColumn("_r", F.from_json(F.col(col), schema)).select("*", "_r.*").drop("_r")


# ------------------------------------------------------------ from events
def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    from .standin import read_table
    return read_table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


def _base(ev: DataFrame) -> list:
    return [F.col("event_id").alias("request_id"), F.col("ts").alias("requested_at")]


def admission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` events: patient ``user_id`` asks for bed ``event_id % 100``
    on the event's day."""
    ev = _events(spark, sf_dir, "signup")
    return ev.select(*_base(ev), F.col("user_id").cast("string").alias("id_patient"),
                     (F.col("event_id") % 100).cast("string").alias("id_room"),
                     F.date_format("ts", "yyyy-MM-dd").alias("date_in"))


def discharge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``purchase`` events: discharge patient ``user_id`` at the event time."""
    ev = _events(spark, sf_dir, "purchase")
    return ev.select(*_base(ev), F.col("user_id").cast("string").alias("id_patient"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_out"))


def transfer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``click`` events: move stay ``event_id`` to bed ``event_id * 7 % 100``,
    asked by staff ``user_id % 100``."""
    ev = _events(spark, sf_dir, "click")
    return ev.select(*_base(ev), F.col("event_id").cast("string").alias("id_stay"),
                     ((F.col("event_id") * 7) % 100).cast("string").alias("id_room"),
                     (F.col("user_id") % 100).cast("string").alias("id_staff"))


def observation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``view`` events: nurse ``user_id`` records vitals for stay
    ``event_id``; the height is ``value * 10`` cm (with a unit suffix on odd
    events), the temperature is ``value``, the remark carries markup."""
    ev = _events(spark, sf_dir, "view")
    height = (F.col("value") * 10).cast("decimal(10,1)").cast("string")
    return ev.select(
        *_base(ev), F.lit(None).cast("string").alias("id_obs"),
        F.col("event_id").cast("string").alias("id_stay"),
        F.col("user_id").cast("string").alias("id_nurse"),
        F.concat(F.lit("<b>"), F.col("props"), F.lit("</b>")).alias("state"),
        F.lit("120/80").alias("blood_pressure"),
        F.col("value").cast("string").alias("temperature"),
        (F.col("event_id") % 60 + 50).cast("string").alias("heart_rate"),
        (F.col("event_id") % 10 + 90).cast("string").alias("spo2"),
        F.lit("5.5").alias("glucose"),
        F.col("value").cast("string").alias("weight"),
        F.when(F.col("event_id") % 2 == 1, F.concat(height, F.lit("cm"))).otherwise(height).alias("height"),
        F.concat(F.lit("note <i>"), F.col("event_type"), F.lit("</i> & \"ok\"")).alias("remark"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("observed_at"),
    )


def availability_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``error`` events: set bed ``event_id % 100`` free ('yes') when the
    event value is above 25, taken ('no') otherwise."""
    ev = _events(spark, sf_dir, "error")
    return ev.select(*_base(ev), (F.col("event_id") % 100).cast("string").alias("id_room"),
                     F.when(F.col("value") > 25, F.lit("yes")).otherwise(F.lit("no")).alias("available"))


def staff_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` events as staff registrations: service ``user_id % 30``
    (some unknown), a repeating e-mail (some already taken, some repeated in
    the batch, case varies) and a role among Nurse/admin/nurse/doctor."""
    ev = _events(spark, sf_dir, "signup")
    email = (F.when(F.col("event_id") % 50 == 0,
                    F.concat(F.lit("SUPPLIER."), F.lpad((F.col("user_id") % 100).cast("string"), 9, "0"),
                             F.lit("@ward.test")))
              .otherwise(F.concat(F.lit("n"), (F.col("event_id") % 700).cast("string"), F.lit("@Ward.test"))))
    role = (F.when(F.col("event_id") % 4 == 0, F.lit("Nurse")).when(F.col("event_id") % 4 == 1, F.lit("admin"))
             .when(F.col("event_id") % 4 == 2, F.lit("nurse")).otherwise(F.lit("doctor")))
    return ev.select(*_base(ev), (F.col("user_id") % 30).cast("string").alias("id_service"),
                     F.concat(F.lit("Nurse "), F.col("user_id").cast("string")).alias("full_name"),
                     email.alias("email"), role.alias("role"))


def status_requests(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """``purchase`` events on the status route: stay ``event_id`` (with
    ``repeated``: ``event_id % 50``, so that a stay is named many times) is
    reactivated in bed ``event_id % 100`` when the value is above 25, else
    discharged at the event time."""
    ev = _events(spark, sf_dir, "purchase")
    stay = F.col("event_id") % 50 if repeated else F.col("event_id")
    return ev.select(*_base(ev), stay.cast("string").alias("id_stay"),
                     F.when(F.col("value") > 25, F.lit("reactivate")).otherwise(F.lit("discharge")).alias("action"),
                     (F.col("event_id") % 100).cast("string").alias("id_room"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_out"))


def new_patient_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` events as admissions of new patients into bed
    ``event_id % 100``; some birth dates do not exist and some sexes are
    outside the domain."""
    ev = _events(spark, sf_dir, "signup")
    e = F.col("event_id")

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    birth = F.concat(F.lit("19"), two(e % 50 + 50), F.lit("-"), two(e % 12 + 1), F.lit("-"), two(e % 31 + 1))
    sex = F.when(e % 3 == 0, F.lit("homme")).when(e % 3 == 1, F.lit("famme")).otherwise(F.lit("autre"))
    return ev.select(*_base(ev), F.concat(F.lit("Patient "), F.col("user_id").cast("string")).alias("full_name"),
                     F.lpad(e.cast("string"), 9, "0").alias("nin"), birth.alias("birth_date"), sex.alias("sex"),
                     F.concat(F.lit("Street "), F.col("user_id").cast("string")).alias("address"),
                     F.lit(None).cast("string").alias("phone"), F.lit("O+").alias("blood_group"),
                     (e % 100).cast("string").alias("id_room"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("admission_date"))


def patient_update_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``click`` events as patient updates: patient ``user_id`` gets new
    fields; two in three also ask for bed ``event_id % 100``, and every
    other one carries an admission date for when no stay is active."""
    ev = _events(spark, sf_dir, "click")
    e = F.col("event_id")
    return ev.select(*_base(ev), F.col("user_id").cast("string").alias("id_patient"),
                     F.concat(F.lit("Updated "), F.col("user_id").cast("string")).alias("full_name"),
                     F.lpad(e.cast("string"), 9, "0").alias("nin"), F.lit("1980-01-01").alias("birth_date"),
                     F.lit("homme").alias("sex"), F.lit("New address").alias("address"),
                     F.lit(None).cast("string").alias("phone"), F.lit("A+").alias("blood_group"),
                     F.when(e % 3 == 0, F.lit("")).otherwise((e % 100).cast("string")).alias("id_room"),
                     F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("admission_date"))


def prescription_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``click`` events as edits of prescription ``event_id % 40``: every fifth
    deletes, every fifth inserts one for stay ``event_id``, the rest update."""
    ev = _events(spark, sf_dir, "click")
    k = F.col("event_id")
    action = F.when(k % 5 == 0, "delete").when(k % 5 == 1, "insert").otherwise("update")
    return ev.select(*_base(ev), action.alias("action"), (k % 40).cast("string").alias("id_prescription"),
                     k.cast("string").alias("id_stay"), F.concat(F.lit("d"), k.cast("string")).alias("drug"),
                     F.lit("1").alias("dose"), F.lit("2").alias("frequency"), F.lit(None).cast("string").alias("instructions"))

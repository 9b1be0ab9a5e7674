"""The driver's TPC-H style tables read as the seven inpatient tables.

Mapping (every rule is plain column arithmetic, so the same view is easy to
write in any SQL engine):

  service      <- nation     id = n_nationkey, name = n_name
  room (bed)   <- supplier   id = s_suppkey, service = s_nationkey,
                             room_no = s_suppkey div 2, bed_no = s_suppkey % 2 + 1,
                             available = s_acctbal > 5000
  staff        <- supplier   id = s_suppkey, service = s_nationkey, name = s_name,
                             role = admin when s_suppkey % 25 = 0 else nurse
  patient      <- customer   id = c_custkey, name = c_name, nin = c_mktsegment,
                             birth_date = 1940-01-01 + (c_custkey * 37 % 25000) days
  stay         <- orders     id = o_orderkey, patient = o_custkey,
                             room = null if o_orderkey % 7 = 0 else o_orderkey % 10,
                             in = o_orderdate, out = in + 5 days when status 'F'
  observation  <- lineitem   stay = l_orderkey, nurse = l_suppkey, at = l_shipdate,
                             state = l_returnflag, temperature = l_quantity;
                             ties: l_linenumber, l_partkey, l_suppkey
  prescription <- lineitem   stay = l_orderkey, drug = l_partkey, dose = l_quantity,
                             frequency = l_linenumber
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import Tables

STANDIN_AS_OF = "2005-02-28"  # fixed "today" for ages on these tables

# Blood groups, in the order the stand-in picks them.
BLOOD_GROUPS = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]


# Declared schemas of the driver's tables: reading with a schema skips the
# footer-inference job Spark otherwise runs for every read.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


# DataFrames are immutable, lazy plans: build each source relation once per
# session and folder, and let every query start from the same plan objects.
_CACHE: dict = {}


def _cached(spark: SparkSession, key: tuple, build):
    hit = _CACHE.get(key)
    if hit is not None and hit[0] is spark:
        return hit[1]
    value = build()
    _CACHE[key] = (spark, value)
    return value


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def build():
        reader = spark.read
        if name in DRIVER_SCHEMAS:
            reader = reader.schema(DRIVER_SCHEMAS[name])
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return _cached(spark, ("table", sf_dir, name), build)


def _mod(c: str, n: int) -> Column:
    return F.col(c) % F.lit(n)


def standin_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return _cached(spark, ("tables", sf_dir), lambda: _build_standin(spark, sf_dir))


def _build_standin(spark: SparkSession, sf_dir: str) -> Tables:
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier")
    customer = read_table(spark, sf_dir, "customer")
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")

    service = nation.select(
        F.col("n_nationkey").cast("bigint").alias("id_service"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    room = supplier.select(
        F.col("s_suppkey").alias("id_room"),
        F.col("s_nationkey").cast("bigint").alias("id_service"),
        F.expr("s_suppkey div 2").cast("int").alias("room_no"),
        (_mod("s_suppkey", 2) + 1).cast("int").alias("bed_no"),
        (F.col("s_acctbal") > 5000).alias("available"),
    )
    staff = supplier.select(
        F.col("s_suppkey").alias("id_staff"),
        F.col("s_nationkey").cast("bigint").alias("id_service"),
        F.col("s_name").alias("full_name"),
        F.concat(F.lower(F.regexp_replace("s_name", "#", ".")), F.lit("@ward.test")).alias("email"),
        F.when(_mod("s_suppkey", 25) == 0, F.lit("admin")).otherwise(F.lit("nurse")).alias("role"),
    )
    patient = customer.select(
        F.col("c_custkey").alias("id_patient"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("nin"),
        F.date_add(F.lit("1940-01-01").cast("date"),
                   ((F.col("c_custkey") * 37) % 25000).cast("int")).alias("birth_date"),
        F.when(_mod("c_custkey", 2) == 0, F.lit("homme")).otherwise(F.lit("famme")).alias("sex"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
        F.when(_mod("c_custkey", 5) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("06"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("phone"),
        F.element_at(F.array(*[F.lit(g) for g in BLOOD_GROUPS]),
                     (_mod("c_custkey", 8) + 1).cast("int")).alias("blood_group"),
    )
    stay = orders.select(
        F.col("o_orderkey").alias("id_stay"),
        F.col("o_custkey").alias("id_patient"),
        F.when(_mod("o_orderkey", 7) == 0, F.lit(None).cast("bigint"))
         .otherwise(_mod("o_orderkey", 10)).alias("id_room"),
        F.col("o_orderdate").alias("date_in"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS"))
         .alias("date_out"),
    )
    observation = lineitem.select(
        F.col("l_orderkey").alias("id_stay"),
        F.col("l_suppkey").alias("id_nurse"),
        F.col("l_returnflag").alias("state"),
        F.col("l_linestatus").alias("blood_pressure"),
        F.col("l_quantity").alias("temperature"),
        F.col("l_linenumber").alias("heart_rate"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_linenumber").alias("t_line"),
        F.col("l_partkey").alias("t_part"),
        F.col("l_suppkey").alias("t_supp"),
    )
    prescription = lineitem.select(
        F.col("l_orderkey").alias("id_stay"),
        F.col("l_partkey").cast("string").alias("drug"),
        F.col("l_quantity").alias("dose"),
        F.col("l_linenumber").alias("frequency"),
        F.col("l_returnflag").alias("instructions"),
        F.col("l_linenumber").alias("p_line"),
        F.col("l_partkey").alias("p_part"),
        F.col("l_suppkey").alias("p_supp"),
        F.col("l_quantity").alias("p_qty"),
    )
    return Tables(service=service, room=room, staff=staff, patient=patient, stay=stay,
                  prescription=prescription, observation=observation,
                  obs_ties=("t_line", "t_part", "t_supp"),
                  presc_order=("p_line", "p_part", "p_supp", "p_qty"))


# The same views in plain SQL, for the DuckDB oracle.  Kept next to the
# DataFrame version so both change together.
STANDIN_SQL_CTES = """
service AS (SELECT CAST(n_nationkey AS BIGINT) AS id_service, n_name AS name,
                   CAST(NULL AS TIMESTAMP) AS created_at FROM nation),
room AS (SELECT s_suppkey AS id_room, CAST(s_nationkey AS BIGINT) AS id_service,
                CAST(s_suppkey // 2 AS INTEGER) AS room_no, CAST(s_suppkey % 2 + 1 AS INTEGER) AS bed_no,
                s_acctbal > 5000 AS available FROM supplier),
staff AS (SELECT s_suppkey AS id_staff, CAST(s_nationkey AS BIGINT) AS id_service, s_name AS full_name,
                 lower(replace(s_name, '#', '.')) || '@ward.test' AS email,
                 CASE WHEN s_suppkey % 25 = 0 THEN 'admin' ELSE 'nurse' END AS role FROM supplier),
patient AS (SELECT c_custkey AS id_patient, c_name AS full_name, c_mktsegment AS nin,
                   CAST(DATE '1940-01-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) AS DATE) AS birth_date,
                   CASE WHEN c_custkey % 2 = 0 THEN 'homme' ELSE 'famme' END AS sex,
                   'Nation ' || CAST(c_nationkey AS VARCHAR) AS address,
                   CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '06' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
                   (['A+','A-','B+','B-','AB+','AB-','O+','O-'])[CAST(c_custkey % 8 + 1 AS INTEGER)] AS blood_group
            FROM customer),
stay AS (SELECT o_orderkey AS id_stay, o_custkey AS id_patient,
                CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 10 END AS id_room,
                o_orderdate AS date_in,
                CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 DAY END AS date_out FROM orders),
observation AS (SELECT l_orderkey AS id_stay, l_suppkey AS id_nurse, l_returnflag AS state,
                       l_linestatus AS blood_pressure, l_quantity AS temperature, l_linenumber AS heart_rate,
                       l_shipdate AS observed_at, l_linenumber AS t_line, l_partkey AS t_part, l_suppkey AS t_supp
                FROM lineitem),
prescription AS (SELECT l_orderkey AS id_stay, CAST(l_partkey AS VARCHAR) AS drug, l_quantity AS dose,
                        l_linenumber AS frequency, l_returnflag AS instructions, l_linenumber AS p_line,
                        l_partkey AS p_part, l_suppkey AS p_supp, l_quantity AS p_qty FROM lineitem)
"""


def with_standin(sql_body: str) -> str:
    """Prefix a query over our table names with the stand-in views."""
    body = sql_body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + STANDIN_SQL_CTES.strip() + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + STANDIN_SQL_CTES.strip() + ",\n" + body[5:]
    return "WITH " + STANDIN_SQL_CTES.strip() + "\n" + body

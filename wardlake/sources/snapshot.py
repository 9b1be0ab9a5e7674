"""The seven tables as one snapshot, read from and written to Parquet.

A snapshot is a folder with one Parquet directory per table.  Changes never
rewrite a snapshot in place: ``write_snapshot`` writes a new version folder
and the caller switches to it (Parquet has no DELETE or MERGE).  A table may
lie in parts by a hash of its key (``write_snapshot_parts``); a new version
then writes only the parts whose rows changed.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLE_NAMES = ("service", "room", "staff", "patient", "stay", "prescription", "observation")


@dataclasses.dataclass(frozen=True)
class Tables:
    service: DataFrame
    room: DataFrame
    staff: DataFrame
    patient: DataFrame
    stay: DataFrame
    prescription: DataFrame
    observation: DataFrame
    # Tie-break columns after the main order key.  The source tables use
    # their auto-increment id; a table without one names a unique column set.
    obs_ties: tuple = ("id_obs",)
    presc_order: tuple = ("id_prescription",)

    def replace(self, **changes) -> "Tables":
        return dataclasses.replace(self, **changes)

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES}

    def checkpoint(self, names: tuple = TABLE_NAMES) -> "Tables":
        """Cut the lineage of the named tables (reliable checkpoint in the
        cluster's checkpoint folder).  Each change batch's output refers to
        its input tables several times, so chaining batches without cutting
        lineage (or writing a snapshot) makes the plan grow with every step."""
        from ..session import checkpoint_dir
        checkpoint_dir(self.stay.sparkSession)
        return self.replace(**{n: getattr(self, n).checkpoint(eager=True) for n in names})


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none when it isn't there."""
    if not _exists(spark, path):
        return []
    p = _path(spark, path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found)


def check_apart(spark: SparkSession, source: str, target: str) -> None:
    """Refuse a target that is the source, lies in it or holds it: writing
    there would destroy what is being read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (_path(spark, x).getFileSystem(conf).makeQualified(_path(spark, x)).toString().rstrip("/") + "/"
            for x in (source, target))
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"the new version {target} must lie apart from the snapshot {source}")


MANIFEST = "_manifest"
APPENDS = "-appends"  # beside a table's folder: a folder per appended batch


MANIFEST_SCHEMA = "name string, path string, part int, parts int"


def manifest(spark: SparkSession, root: str) -> list[Row]:
    """What a snapshot version consists of: per table one row with its folder
    (for a table in parts: the folder beside which its appended batches lie)
    and one row per part.  Without a manifest, a folder per table under
    ``root``.  Its size is bounded by the numbers of parts."""
    rows = []
    if _exists(spark, f"{root}/{MANIFEST}"):
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/{MANIFEST}").collect()
    named = {r["name"] for r in rows}
    return rows + [Row(name=n, path=f"{root}/{n}", part=None, parts=None) for n in TABLE_NAMES if n not in named]


def _write_manifest(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").json(f"{root}/{MANIFEST}")


def table_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder of each table of a snapshot version."""
    return {r["name"]: r["path"] for r in manifest(spark, root) if r["part"] is None}


def _read(spark: SparkSession, name: str, rows: list[Row], appends: bool = True) -> DataFrame:
    own = [r for r in rows if r["name"] == name]
    table = next(r for r in own if r["part"] is None)
    paths = [table["path"]] if table["parts"] is None else [r["path"] for r in own if r["part"] is not None]
    if appends:
        paths += appended(spark, table["path"])
    schema = schemas.TABLE_SCHEMAS[name]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _read(spark, name, manifest(spark, root))


def read_snapshot(spark: SparkSession, root: str) -> Tables:
    """Read every table with its declared schema (never inferred)."""
    rows = manifest(spark, root)
    return Tables(**{n: _read(spark, n, rows) for n in TABLE_NAMES})


def appended(spark: SparkSession, path: str) -> list[str]:
    """The appended batches of a table folder, each once: those written to the end."""
    root = f"{path}{APPENDS}"
    return [f"{root}/{n}" for n in child_names(spark, root) if _exists(spark, f"{root}/{n}/_SUCCESS")]


def write_snapshot(tables: Tables, root: str, partition_stays_by_month: bool = False) -> None:
    """Write a whole snapshot version into a new folder.  Stays may be
    partitioned by entry month so that date filters prune whole folders."""
    for name, df in tables.as_dict().items():
        writer = df.write.mode("errorifexists")
        if name == "stay" and partition_stays_by_month:
            df = df.withColumn("in_month", F.date_format("date_in", "yyyy-MM"))
            writer = df.write.mode("errorifexists").partitionBy("in_month")
        writer.parquet(f"{root}/{name}")


def part_of(name: str, parts: int) -> Column:
    """The part of a table's row: a hash of its key."""
    return F.pmod(F.xxhash64(BUCKET_KEYS[name]), F.lit(parts)).cast("int")


def _in_schema(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[df[f.name].cast(f.dataType) for f in schemas.TABLE_SCHEMAS[name].fields])


def _write_parts(df: DataFrame, name: str, root: str, parts: int, only: list[int] | None = None) -> list[tuple]:
    """Write the rows of ``df`` (of the parts ``only``) into a folder per part;
    a part without rows has none.  Rebalancing gathers a part in few files and
    splits one with a hot key.  Returns the parts' manifest rows."""
    path = f"{root}/{name}"
    rows = _in_schema(df, name).withColumn("part", part_of(name, parts))
    if only is not None:
        rows = rows.where(F.col("part").isin(only))
    rows.hint("rebalance", F.col("part")).write.mode("errorifexists").partitionBy("part").parquet(path)
    return [(name, f"{path}/{c}", int(c.split("=")[1]), parts)
            for c in child_names(df.sparkSession, path) if c.startswith("part=")]


def write_snapshot_parts(tables: Tables, root: str, parts: dict[str, int], names: tuple = TABLE_NAMES) -> None:
    """Write a snapshot version whose tables in ``parts`` lie in that many
    parts by a hash of their key, the others whole.  Choose the numbers so
    that a part is some hundred MB.  The manifest is written last."""
    rows: list[tuple] = []
    for name in names:
        df = getattr(tables, name)
        if name in parts:
            rows += _write_parts(df, name, root, parts[name])
        else:
            df.write.mode("errorifexists").parquet(f"{root}/{name}")
        rows.append((name, f"{root}/{name}", None, parts.get(name)))
    _write_manifest(tables.stay.sparkSession, root, rows)


def changed_parts(before: DataFrame, after: DataFrame, name: str, parts: int) -> list[int]:
    """The parts whose rows differ, as multisets: by row count and two sums of
    row hashes per part, one map-side combined aggregate each, which return a
    row per part.  NULL and value are told apart."""
    def sums(df: DataFrame, side: str) -> DataFrame:
        df = _in_schema(df, name)
        cols = [F.col(c) for c in df.columns] + [F.col(c).isNull() for c in df.columns]
        return df.groupBy(part_of(name, parts).alias("part")).agg(
            F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")),
                     F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)"))).alias(side))
    both = sums(before, "old").join(sums(after, "new"), "part", "full")
    return sorted(r["part"] for r in both.where(~F.col("old").eqNullSafe(F.col("new"))).select("part").collect())


def write_version(tables: Tables, base: Tables, base_root: str, root: str) -> list[str]:
    """Write the next version after ``base``: only the tables that a change
    batch replaced, and of a table in parts only the parts whose rows changed;
    the others are named where they lie.  Batches appended to a replaced table
    become rows of its parts.  The old version's files are never touched and
    the manifest is written last, so a version that failed half way has none
    and a repeated write fails on the existing folder.  Returns the tables
    replaced."""
    spark = tables.stay.sparkSession
    check_apart(spark, base_root, root)
    old = manifest(spark, base_root)
    changed = [n for n in TABLE_NAMES if getattr(tables, n) is not getattr(base, n)]
    rows = [tuple(r) for r in old if r["name"] not in changed]
    for name in changed:
        df, path = getattr(tables, name), f"{root}/{name}"
        parts = next(r["parts"] for r in old if r["name"] == name and r["part"] is None)
        if parts is None:
            df.write.mode("errorifexists").parquet(path)
        else:
            only = changed_parts(_read(spark, name, old, appends=False), df, name, parts)
            rows += [tuple(r) for r in old if r["name"] == name and r["part"] is not None and r["part"] not in only]
            rows += _write_parts(df, name, root, parts, only) if only else []
        rows.append((name, path, None, parts))
    _write_manifest(spark, root, rows)
    return changed


def read_jdbc(spark: SparkSession, url: str, table: str, schema_name: str, columns: dict[str, str],
              partition_column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """Scan of a live relational table in ``partitions`` ranges of its key
    ``partition_column``; the caller gives the connection options (no account
    data lives in this library).  ``columns`` maps our column names to the
    table's; columns that aren't named, such as a password, are never read."""
    target = schemas.TABLE_SCHEMAS[schema_name]
    unknown = set(columns) - {f.name for f in target.fields}
    if unknown:
        raise ValueError(f"not in {schema_name}: {sorted(unknown)}")
    df = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
          .option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper)
          .option("numPartitions", partitions).options(**options).load())
    return select_columns(df, schema_name, columns)


def select_columns(df: DataFrame, schema_name: str, columns: dict[str, str]) -> DataFrame:
    """``df`` in our schema: each column by name, cast; unnamed ones NULL."""
    return df.select(*[(F.col(columns[f.name]) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schemas.TABLE_SCHEMAS[schema_name].fields])


# Bucketing keys: stays, observations and prescriptions meet on id_stay (the
# newest-observation aggregate and every stay join); patients on id_patient.
BUCKET_KEYS = {"stay": "id_stay", "observation": "id_stay", "prescription": "id_stay",
               "patient": "id_patient", "room": "id_room", "staff": "id_staff", "service": "id_service"}


def save_catalog_snapshot(tables: Tables, database: str, buckets: int, location: str | None = None,
                          mode: str = "overwrite") -> None:
    """Save a snapshot as catalog tables bucketed (and sorted) by their join
    key, so joins and aggregates on that key read co-located buckets with no
    shuffle.  All tables that meet on a key share the bucket count."""
    spark = tables.stay.sparkSession
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{loc}")
    for name, df in tables.as_dict().items():
        key = BUCKET_KEYS[name]
        (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
           .saveAsTable(f"{database}.{name}"))


def read_catalog_snapshot(spark: SparkSession, database: str, **ties) -> Tables:
    return Tables(**{n: spark.table(f"{database}.{n}") for n in TABLE_NAMES}, **ties)


def append_rows(df: DataFrame, root: str, name: str, batch_id: str) -> None:
    """Append checked rows to one table of a snapshot folder (the insert
    path: run the constraint checks first, append only the good rows).  The
    batch lies in a folder named by ``batch_id``: the same batch sent again
    takes its own place, one that failed half way is not read, and the table's
    other files are never touched."""
    target = schemas.TABLE_SCHEMAS[name]
    path = table_paths(df.sparkSession, root)[name]
    (df.select(*[df[f.name].cast(f.dataType) for f in target.fields])
       .write.mode("overwrite").parquet(f"{path}{APPENDS}/{batch_id}"))

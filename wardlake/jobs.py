"""Command-line jobs for ``spark-submit``: run a read operator on a snapshot,
or apply a batch of JSON requests and write the next snapshot version.

    spark-submit -m wardlake.jobs read admin_overview --snapshot s3://.../v12 --out .../answers --as-of 2025-06-01
    spark-submit -m wardlake.jobs apply transfer --snapshot .../v12 --requests .../incoming --out .../v13
    spark-submit -m wardlake.jobs registered roster --sf-dir /data/sf100 --out .../roster

Results are written by the executors (Parquet, or JSON lines with NULLs
kept); nothing is collected on the driver.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import changes, checks, reads
from .session import get_session
from .sources import requests as rq
from .sources.sinks import write_answers
from .sources.snapshot import Tables, check_apart, read_snapshot, write_version

READS = {
    "roster": lambda t, a: reads.roster(t, active_only=a.active_only),
    "patient_card": lambda t, a: reads.patient_card(t, a.as_of),
    "patient_detail": lambda t, a: reads.patient_detail(t, a.as_of),
    "admin_overview": lambda t, a: reads.admin_overview(t, a.as_of),
    "service_census": lambda t, a: reads.service_census(t),
    "search_patients": lambda t, a: reads.search_patients(t, a.term, wildcards=a.wildcards),
    "free_rooms": lambda t, a: reads.free_rooms(t),
    "stay_prescriptions": lambda t, a: reads.stay_prescriptions(t),
    "stay_summary": lambda t, a: reads.stay_summary(t),
    "current_stay": lambda t, a: reads.current_stay(t),
    "newest_observation": lambda t, a: reads.newest_observation(t),
    "table_violations": lambda t, a: checks.table_violations(t),
    "bed_flag_mismatches": lambda t, a: checks.bed_flag_mismatches(t),
}

APPLY = {
    "admit_new": (schemas.ADMIT_NEW_REQ, lambda t, r, a: changes.admit_new(t, r, a.batch_ts)),
    "admit_existing": (schemas.ADMIT_EXISTING_REQ,
                       lambda t, r, a: changes.admit_existing(t, r, check_free=not a.lenient)),
    "update_patient": (schemas.UPDATE_PATIENT_REQ, lambda t, r, a: changes.update_patient(t, r, a.batch_ts)),
    "transfer": (schemas.TRANSFER_REQ, lambda t, r, a: changes.transfer(t, r, lenient=a.lenient)),
    "status": (schemas.STATUS_REQ, lambda t, r, a: changes.apply_status(t, r, a.batch_ts, lenient=a.lenient)),
    "discharge_patient": (schemas.DISCHARGE_PATIENT_REQ,
                          lambda t, r, a: changes.discharge_by_patient(t, r, a.batch_ts)),
    "availability": (schemas.AVAILABILITY_REQ, lambda t, r, a: changes.set_availability(t, r)),
    "observations": (schemas.OBSERVATION_REQ,
                     lambda t, r, a: changes.ingest_observations(t, r, a.batch_ts, strict=a.strict)),
    "amend_observations": (schemas.OBSERVATION_REQ,
                           lambda t, r, a: changes.amend_observations(t, r, own_only=a.own_only)),
    "prescriptions": (schemas.PRESCRIPTION_REQ, lambda t, r, a: changes.prescription_changes(t, r)),
    "staff": (schemas.STAFF_REQ, lambda t, r, a: changes.load_staff(t, r)),
}


def _write(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "json":
        write_answers(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def run(spark: SparkSession, argv: list[str]) -> None:
    p = argparse.ArgumentParser(prog="wardlake.jobs")
    sub = p.add_subparsers(dest="mode", required=True)
    r = sub.add_parser("read")
    r.add_argument("name", choices=sorted(READS))
    a = sub.add_parser("apply")
    a.add_argument("name", choices=sorted(APPLY))
    a.add_argument("--requests", required=True)
    g = sub.add_parser("registered")
    g.add_argument("name")
    g.add_argument("--sf-dir", required=True)
    for s in (r, a):
        s.add_argument("--snapshot", required=True)
    for s in (r, a, g):
        s.add_argument("--out", required=True)
        s.add_argument("--format", choices=["parquet", "json"], default="parquet")
    for s in (r, a):
        s.add_argument("--as-of", default=None)
        s.add_argument("--term", default="")
        s.add_argument("--wildcards", action="store_true")
        s.add_argument("--active-only", action="store_true")
        s.add_argument("--batch-ts", default=None)
        s.add_argument("--lenient", action="store_true")
        s.add_argument("--strict", action="store_true")
        s.add_argument("--own-only", action="store_true")
    args = p.parse_args(argv)
    # "now" of the job: fixed once, so every task of the batch sees the same value
    started = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    if getattr(args, "batch_ts", "x") is None:
        args.batch_ts = started.strftime("%Y-%m-%d %H:%M:%S")
    if getattr(args, "as_of", "x") is None:
        args.as_of = started.strftime("%Y-%m-%d")

    if args.mode == "registered":
        from .plans import catalog
        _write(catalog.QUERIES[args.name](spark, args.sf_dir), args.out, args.format)
        return
    tables: Tables = read_snapshot(spark, args.snapshot)
    if args.mode == "read":
        _write(READS[args.name](tables, args), args.out, args.format)
        return
    schema, fn = APPLY[args.name]
    check_apart(spark, args.snapshot, args.out)
    good, malformed = rq.read_json_requests(spark, args.requests, schema)
    res = fn(tables, good, args)
    # answers first, the version's manifest last: a version that can be read is complete
    rejects = res.rejects.withColumn("text", F.lit(None).cast("string"))
    _write(rejects.unionByName(malformed.select("request_id", "reason", F.col("payload").alias("text"))),
           f"{args.out}/_rejects", args.format)
    _write(res.accepted, f"{args.out}/_accepted", args.format)
    write_version(res.tables, tables, args.snapshot, args.out)


def main() -> None:
    spark = get_session()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()

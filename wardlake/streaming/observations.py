"""Structured Streaming forms of the vitals feed.

ST1 ``start_observation_ingest``: JSON request lines arrive in a folder;
each micro-batch is cleaned and checked exactly like the batch operator and
written, per batch id, to an accepted folder and a rejects folder.  A
retried batch overwrites its own folder, so the sink stays exactly-once.  A
request that is sent again, in another file or after a restart, is taken
once: the request ids of the last ``resend_within`` are kept in the state store,
by arrival time, so no late request is ever dropped for its own time.  The tables
may be a function, called for every micro-batch: a stay that a newer snapshot
version adds is known to the next one.

ST2 ``newest_observation_stream``: the newest observation per stay, kept
up to date as observations arrive in any order.  It is a streaming
aggregate (max of a struct, as the batch operator), so late rows need no
watermark: the maximum is taken by event time, not arrival time.  Its state
lives in RocksDB (``session.state_on_disk``, whatever the session's own settings), its output in generations: each
micro-batch adds a part, after ``MERGE_AFTER`` parts they are merged into one,
and a small manifest per micro-batch, written last, names the parts that count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import changes
from ..session import state_on_disk
from ..sources.snapshot import Tables, _exists as path_exists, child_names

MERGE_AFTER = 8  # parts of the newest-observation output


# ---------------------------------------------------------------- ST1
def read_observation_requests(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The request stream of a folder, at most ``max_files`` files a micro-batch."""
    schema = T.StructType(schemas.OBSERVATION_REQ.fields + [T.StructField("_corrupt_record", T.StringType())])
    reader = (spark.readStream.schema(schema).option("mode", "PERMISSIVE")
                   .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def ingest_batch(t: Tables, batch: DataFrame, batch_id: int, out_dir: str, batch_ts: str, base_id: int) -> None:
    """One micro-batch: split malformed lines, ingest the rest, write both
    outputs under ``batch_id=<n>`` (overwrite: a replay is idempotent).

    New ids continue after ``base_id`` (the snapshot's greatest id) plus the
    accepted counts of the earlier batches, kept in a one-row-per-batch
    ``counts`` table, so no batch rescans what earlier batches wrote."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        malformed = batch.filter(F.col("_corrupt_record").isNotNull()).select(
            "request_id", F.lit("malformed").alias("reason"), F.col("_corrupt_record").alias("text"))
        good = batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        before = F.lit(0)
        if path_exists(spark, f"{out_dir}/counts"):  # else this is the first batch
            counts = spark.read.schema("n bigint, batch_id bigint").parquet(f"{out_dir}/counts")
            before = counts.filter(F.col("batch_id") < batch_id).agg(F.sum("n")).scalar()
        base = F.lit(base_id) + F.coalesce(before, F.lit(0))
        res = changes.ingest_observations(t, good, batch_ts, id_base=base)
        accepted = res.accepted.persist()
        try:
            accepted.write.mode("overwrite").parquet(f"{out_dir}/accepted/batch_id={batch_id}")
            accepted.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
                f"{out_dir}/counts/batch_id={batch_id}")
        finally:
            accepted.unpersist()
        res.rejects.withColumn("text", F.lit(None).cast("string")).unionByName(malformed).write.mode("overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
    finally:
        batch.unpersist()


def each_request_once(stream: DataFrame, within: str) -> DataFrame:
    """The stream without requests whose id arrived before, up to ``within``
    ago.  Lines that are malformed, and requests without an id, are told apart
    by their whole content."""
    content = F.coalesce(F.col("_corrupt_record"), F.to_json(F.struct(*[c for c in stream.columns if c != "_corrupt_record"])))
    key = F.when(F.col("request_id").isNotNull(), F.concat(F.lit("id "), F.col("request_id").cast("string"))).otherwise(
        F.concat(F.lit("line "), F.sha2(content, 256)))
    return (stream.withColumn("_arrived", F.current_timestamp()).withColumn("_request", key)
                  .withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_request"]).drop("_arrived", "_request"))


def start_observation_ingest(spark: SparkSession, t: Tables | Callable[[], Tables], in_folder: str, out_dir: str, batch_ts: str,
                             checkpoint: str, available_now: bool = True, max_files: int | None = None,
                             resend_within: str = "7 days"):
    """Start ST1.  ``checkpoint`` is the stream's own lasting folder: a start
    with the same one goes on behind the last finished batch; with another one
    the whole folder is read again.  ``t``: the tables, or a function that
    gives the newest ones."""
    tables = t if callable(t) else lambda: t
    # the snapshot's greatest id, taken once (one number) rather than per batch
    first = tables().observation
    base_id = (first.agg(F.max("id_obs")).first()[0] or 0) if "id_obs" in first.columns else 0
    stream = each_request_once(read_observation_requests(spark, in_folder, max_files), resend_within)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
                    .foreachBatch(lambda df, bid: ingest_batch(tables(), df, bid, out_dir, batch_ts, base_id)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# ---------------------------------------------------------------- ST2
def newest_observation_stream(obs: DataFrame, ties: Sequence[str] = ("id_obs",),
                              payload: Sequence[str] | None = None) -> DataFrame:
    """Streaming (or batch) newest observation per stay."""
    order = ["observed_at", *ties]
    if payload is None:
        payload = [c for c in obs.columns if c not in ("id_stay", *order)]
    fields = order + list(payload)
    top = F.max(F.struct(*fields)).alias("_top")
    return obs.groupBy("id_stay").agg(top).select("id_stay", *[F.col("_top").getField(c).alias(c) for c in fields])


def _newest_of_parts(rows: DataFrame, ties: Sequence[str]) -> DataFrame:
    """The newest observation per stay of several parts.  A part has a row per
    stay, so combining before the shuffle would only sort: the rows go to their
    stay's task as they are."""
    return newest_observation_stream(rows.repartition("id_stay"), ties)


def _parts(spark: SparkSession, out_dir: str, before: int | None = None) -> list[str]:
    """The parts that count, by the newest manifest (of a batch earlier than ``before``)."""
    numbers = [int(n.split("=")[1]) for n in child_names(spark, f"{out_dir}/_manifest")]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return []
    rows = spark.read.schema("part string").json(f"{out_dir}/_manifest/n={max(numbers)}").collect()
    return sorted(f"{out_dir}/{r.part}" for r in rows)


def start_newest_observation(spark: SparkSession, source: DataFrame, out_dir: str, checkpoint: str,
                             ties: Sequence[str] = ("id_obs",), available_now: bool = True, merge_after: int = MERGE_AFTER):
    """Run ST2 in update mode (``checkpoint``: the stream's own lasting folder): every micro-batch writes the stays whose
    newest observation changed as a part of their own (overwrite, so a
    replayed batch is idempotent), and once there are more than ``merge_after``
    parts, one part in their place.  Nothing is collected on the driver but the
    names of the parts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        part = f"part={batch_id}"
        batch.write.mode("overwrite").parquet(f"{out_dir}/{part}")
        parts = [p.rsplit("/", 1)[1] for p in _parts(own, out_dir, batch_id)] + [part]
        if len(parts) > merge_after:
            rows = own.read.schema(batch.schema).parquet(*[f"{out_dir}/{p}" for p in parts])
            merged = f"merged={batch_id}"
            _newest_of_parts(rows, ties).select(*batch.columns).write.mode("overwrite").parquet(f"{out_dir}/{merged}")
            parts = [merged]
        own.createDataFrame([(p,) for p in parts], "part string").coalesce(1).write.mode("overwrite").json(f"{out_dir}/_manifest/n={batch_id}")

    writer = (newest_observation_stream(source, ties).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    with state_on_disk(source.sparkSession):
        return writer.start()


def read_newest_observation(spark: SparkSession, out_dir: str, ties: Sequence[str] = ("id_obs",)) -> DataFrame:
    """The current answer of ST2: the rows of the parts that count are
    candidates, the greatest per stay wins (the same aggregate once more).
    What is read is the merged part and at most ``merge_after`` small ones,
    however many micro-batches there were."""
    return _newest_of_parts(spark.read.parquet(*_parts(spark, out_dir)), ties)


def compact_newest_observation(spark: SparkSession, out_dir: str, target: str, ties: Sequence[str] = ("id_obs",)) -> None:
    """Write the current answer as one table into a new folder."""
    read_newest_observation(spark, out_dir, ties).write.mode("errorifexists").parquet(target)

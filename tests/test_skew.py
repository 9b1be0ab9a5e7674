"""A key that holds a third of all rows: results stay exact and the heavy
steps are reduced on the map side."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from wardlake.operators.latest import flag_first_per_key, latest_per_key


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_hot_stay_newest_observation(spark):
    n = 90_000
    obs = spark.range(0, n, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000 + 100).alias("id_stay"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_interval(mins=(F.col("id") % 5000).cast("int")))
        .alias("observed_at"),
        F.col("id").alias("id_obs"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))
    top = latest_per_key(obs, ["id_stay"], ["observed_at", "id_obs"])
    plan = _plan(top)
    assert "partial_max" in plan and "Window" not in plan
    got = {r.id_stay: r.id_obs for r in top.collect()}
    # brute force for the hot key: newest time, then greatest id
    hot = (obs.filter("id_stay = 7").orderBy(F.desc("observed_at"), F.desc("id_obs")).first())
    assert got[7] == hot.id_obs
    assert len(got) == 1001


def test_hot_bed_first_request(spark):
    n = 60_000
    req = spark.range(0, n, 1, 12).select(
        F.col("id").alias("request_id"),
        (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_interval(secs=((F.col("id") * 7919) % n).cast("int")))
        .alias("requested_at"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("bed"))
    flagged = flag_first_per_key(req, ["bed"], ["requested_at", "request_id"], "first")
    assert "Window" not in _plan(flagged)
    # the winners come back on the request, not on the hot bed
    keys = [x for x in _plan(flagged).splitlines() if x.startswith("Left keys")]
    assert keys and all("request_id" in x and "bed" not in x for x in keys)
    winners = {r.bed: r.request_id for r in flagged.filter("first").collect()}
    assert len(winners) == 51
    hot = req.filter("bed = 1").orderBy("requested_at", "request_id").first()
    assert winners[1] == hot.request_id
    assert flagged.count() == n  # every request kept


def test_hot_foreign_key(spark):
    """A third of the rows name one parent; the wide rows are not shuffled by that key."""
    from wardlake.operators import checks
    child = spark.range(0, 60_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500).cast("bigint").alias("id_stay"),
        F.lit("long remark").alias("remark"))
    parent = spark.range(0, 490).select(F.col("id").alias("id_stay"))
    good, bad = checks.violations(child, [checks.foreign_key("id_stay", parent)])
    assert bad.count() == child.where("id_stay >= 490").count() > 0
    assert good.count() + bad.count() == 60_000 and good.columns == child.columns
    assert not any("Exchange" in x and "remark" in x for x in _plan(bad).splitlines())


def test_hot_stay_is_split_in_a_sort_merge_join(spark, seed):
    """A third of the prescriptions are one stay's: with sort-merge joins forced, no task of the join has more than
    three times the median's rows, and the answer is the plain join's."""
    from wardlake.operators import hot, reads
    n = 120_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 20_000 + 100).cast("bigint")
    presc = spark.range(0, n, 1, 6).select(F.col("id").alias("id_prescription"), key.alias("id_stay"), F.lit("d").alias("drug"),
                                           F.lit(1).alias("dose"), F.lit(1).alias("frequency"), F.lit("x").alias("instructions"))
    stay = spark.range(0, 25_000).selectExpr("id id_stay", "1L id_patient", "id % 50 id_room", "timestamp_ntz'2025-01-01 00:00:00' date_in",
                                             "cast(null as timestamp_ntz) date_out")
    assert hot.hot_keys(presc, "id_stay", 5_000) == {7: 8} and hot.hot_keys(presc, "id_stay") == {}
    t = seed.replace(stay=stay.select(*seed.stay.columns), prescription=presc.select(*seed.prescription.columns))
    plain = presc.join(stay.select("id_stay"), on="id_stay", how="right").groupBy("id_stay").agg(F.count("drug").alias("n"), F.sum("id_prescription").alias("s"))
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        split = hot.join_split(presc, stay.select("id_stay", "id_room"), "id_stay", hot_rows=5_000)
        assert "SortMergeJoin" in _plan(split) and "_salt" in _plan(split)
        sizes = sorted(r["count"] for r in split.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 12 and sizes[-1] <= 3 * sizes[6], sizes
        got = reads.stay_summary(t, hot_rows=5_000).groupBy("id_stay").agg(F.count("drug").alias("n"), F.sum("id_prescription").alias("s"))
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
        assert got.count() == 25_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_duplicated_hot_key_is_no_hot_join(spark):
    """A third of the rows repeat one primary key and one foreign key: one aggregate finds the broken keys of all
    rules, and the rows meet them without being shuffled."""
    from wardlake.operators import checks
    child = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("bigint").alias("id"),
        F.when(F.col("id") % 3 == 1, F.lit(-5)).otherwise(F.col("id") % 500).cast("bigint").alias("id_stay"), F.lit("long remark").alias("remark"))
    parent = spark.range(0, 490).select(F.col("id").alias("id_stay"))
    rules = [checks.primary_key("id"), checks.foreign_key("id_stay", parent), checks.not_null("remark"), checks.primary_key("id", "id_stay")]
    good, bad = checks.violations(child, rules)
    by = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert by["primary_key:id"] == 20_000
    assert by["foreign_key:id_stay"] == child.where("id <> -1 and (id_stay = -5 or id_stay >= 490)").count()
    assert set(by) == {"primary_key:id", "foreign_key:id_stay"} and good.count() == 60_000 - sum(by.values())
    assert "Exchange hashpartitioning" not in _plan(bad) and "SortMergeJoin" not in _plan(bad)


def _with_conf(spark, conf, run):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _even(df):
    """The final plan, and the rows by task: none has more than three times the median's."""
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.max(F.xxhash64(*df.columns)))
    n = sorted(r["count"] for r in sizes.collect())
    assert n[-1] <= 3 * n[len(n) // 2], n
    return sizes._jdf.queryExecution().executedPlan().toString()


NO_STATIC_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12",
                       "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_existence_of_a_hot_key(spark):
    """A third of a batch names one stay, a sixth one that does not exist, some none: the rows meet the missing keys only."""
    from wardlake.operators import changes
    n = 60_000
    batch = spark.range(0, n, 1, 8).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 6 == 1, -3)
        .when(F.col("id") % 100 == 50, F.lit(None)).otherwise(F.col("id")).cast("bigint").alias("id_stay"))
    stay = spark.range(0, 50_000).selectExpr("id id_stay").union(spark.createDataFrame([(7,), (7,)], "id_stay bigint"))

    def run():
        flagged = changes._exists(batch, stay, "id_stay", "id_stay", "_stay")
        assert "BroadcastHashJoin" in _even(flagged)
        got = {r.request_id: r._stay for r in flagged.collect()}
        want = {r.request_id: r.id_stay is not None and 0 <= r.id_stay < 50_000 for r in batch.collect()}
        assert got == want and flagged.count() == n
    _with_conf(spark, {**NO_STATIC_BROADCAST, "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}, run)


def test_hot_bed_lookup_is_split(spark, seed):
    """A third of a batch wants one bed and a fifth none, and the beds are too many for a broadcast: their rows are
    dealt out, and every request gets the state of its bed."""
    from wardlake.operators import changes, hot
    n = 120_000
    batch = spark.range(0, n, 1, 12).select(
        F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 15 < 5, F.lit(None))
        .otherwise(F.col("id") % 30_000).cast("bigint").alias("bed"))
    room = spark.range(0, 29_000).selectExpr("id id_room", "id % 40 id_service", "id % 2 = 0 available")
    t = seed.replace(room=seed.room.limit(0).unionByName(room, allowMissingColumns=True).select(*seed.room.columns))
    found = hot.hot_values(batch, ["bed", "request_id"], 5_000)
    assert set(found["bed"]) == {7, None} and found["bed"][7] in (8, 9) and found["request_id"] == {}

    def run():
        looked = changes._with_bed(batch, t, found["bed"])
        assert "SortMergeJoin" in _even(looked)
        plain = batch.join(room.withColumnRenamed("id_room", "bed"), on="bed", how="left").selectExpr(
            "request_id", "bed", "id_service bed_service", "coalesce(available, false) bed_free", "available is not null bed_exists")
        got = looked.select(*plain.columns)
        assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0
    _with_conf(spark, {**NO_STATIC_BROADCAST, "spark.sql.adaptive.enabled": "false"}, run)

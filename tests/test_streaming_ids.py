"""Streaming operators, dense ids, cleaning expressions."""

from __future__ import annotations

import datetime as dt
import json
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from wardlake.functions import cleaning as X
from wardlake.operators import reads
from wardlake.operators.ids import assign_dense_ids
from wardlake.streaming import observations as st


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id").alias("request_id"),
                                           F.lit(None).cast("timestamp").alias("requested_at"))
    df = df.orderBy(F.rand(3))  # scrambled input order
    out = assign_dense_ids(df, ["requested_at", "request_id"], "new_id", base=100).collect()
    got = sorted((r.request_id, r.new_id) for r in out)
    assert got == [(i, 101 + i) for i in range(5000)]


def test_newest_observation_stream_equals_batch(spark, seed):
    folder = tempfile.mkdtemp(prefix="wardlake-obs-in-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="wardlake-obs-out-", dir="/tmp") + "/newest"
    obs = seed.observation
    # arrival in two files, newest rows first: order of arrival must not matter
    later = obs.withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")) \
               .withColumn("id_obs", F.col("id_obs") + 100).withColumn("state", F.lit("Later"))
    later.write.parquet(f"{folder}/a")
    obs.write.parquet(f"{folder}/b")
    source = spark.readStream.schema(obs.schema).parquet(f"{folder}/*")
    st.start_newest_observation(spark, source, out_dir, f"{out_dir}-state").awaitTermination()
    streamed = st.read_newest_observation(spark, out_dir)
    batch = reads.newest_observation(seed.replace(observation=obs.unionByName(later)))
    assert rows(streamed, "id_stay", "id_obs", "state") == rows(batch, "id_stay", "id_obs", "state")
    assert {r.state for r in streamed.collect()} == {"Later"}


def test_observation_ingest_stream(spark, seed):
    folder = tempfile.mkdtemp(prefix="wardlake-req-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="wardlake-ing-", dir="/tmp")
    good = dict(request_id=1, requested_at="2025-06-01T08:00:00", id_stay="3", id_nurse="2", state="Ok",
                blood_pressure="120/80", temperature="37.2", heart_rate="80", spo2="97", glucose="5.5",
                weight="70", height="170cm", remark="fine", observed_at="2025-06-01T08:00")
    with open(f"{folder}/batch1.json", "w") as f:
        f.write(json.dumps(good) + "\n")
        f.write("{not json\n")
        f.write(json.dumps(dict(good, request_id=3, id_stay="99")) + "\n")
    st.start_observation_ingest(spark, seed, folder, out_dir, "2025-06-01 00:00:00", f"{out_dir}-state").awaitTermination()
    acc = spark.read.parquet(f"{out_dir}/accepted").collect()
    assert [(r.request_id, r.id_obs, str(r.height)) for r in acc] == [(1, 9, "1.70")]
    rej = rows(spark.read.parquet(f"{out_dir}/rejects"), "reason")
    assert rej == [("malformed",), ("unknown stay",)]
    assert [r.text for r in spark.read.parquet(f"{out_dir}/rejects").collect() if r.text] == ["{not json"]


def test_cleaning_goldens(spark):
    df = spark.createDataFrame([("165.5", "a<b> & \"q\" 's'", "<b>x</b>", "38.456", "1000.0", "2025-02-31",
                                 dt.date(2024, 2, 29), dt.date(2025, 2, 28))],
                               "h string, esc string, tag string, t string, big string, d string, b date, a date")
    r = df.select(
        X.height_m("h").cast("string").alias("h1"), X.height_m(F.lit("170cm")).cast("string").alias("h2"),
        X.height_m(F.lit("0")).cast("string").alias("h3"), X.height_m(F.lit("0"), strict=True).alias("h4"),
        X.escape_html("esc").alias("esc"), X.strip_tags("tag").alias("tag"),
        X.to_decimal("t", 5, 2).cast("string").alias("t"), X.to_decimal("big", 5, 2).alias("big"),
        X.valid_date_text("d").alias("d"), X.valid_date_text(F.lit("2025-02-28")).alias("d2"),
        X.age_years("b", F.col("a")).alias("age"),
        X.age_years(F.lit("2030-01-01").cast("date"), F.col("a")).alias("future"),
        X.truthy(F.lit("Yes")).alias("yes"), X.is_empty(F.lit("0")).alias("empty"),
    ).collect()[0]
    assert (r.h1, r.h2, r.h3, r.h4) == ("1.66", "1.70", "0.00", None)
    assert r.esc == "a&lt;b&gt; &amp; &quot;q&quot; &#039;s&#039;" and r.tag == "x"
    assert r.t == "38.46" and r.big is None
    assert (r.d, r.d2) == (False, True)
    assert r.age == 0 and r.future == 4
    assert r.yes is True and r.empty is True


def test_markup_height_time_and_empty_goldens(spark):
    """Worked by hand from what the source's functions are documented to do."""
    texts = {"temp < 38 and spo2 > 95": "temp < 38 and spo2 > 95", "a<!-- x > y -->b": "ab", "a<b": "a",
             "<a t='>'>k</a> z": "k z", "x <": "x <", "p <!-- open": "p ", "a <b t='x> y": "a ", "a <b t=\"x' > y\">z": "a z",
             "<!-->k": "k", "<!--->k": "k", "<!-- it's -->k": "k", "<a t='<!-- '>k": "k", "a <> b": "a  b", "<b\n>k</b\n>": "k",
             "": "", "1 <2 and 3> 2": "1  2", "<br/>k<?php echo 1 ?>": "k"}
    df = spark.createDataFrame(list(texts.items()), "i string, want string")
    assert [(r.i, r.got) for r in df.select("i", X.strip_tags("i").alias("got")).collect()] == list(texts.items())
    n = 10_000_000  # what is left open at the end of a long text costs no stack
    for open_ in ("<b ", "<b t='", "<!-- ", "<b t=''", "<b 'x'\"y\""):
        long = spark.range(1).select(F.concat(F.lit("k" + open_), F.repeat(F.lit("x='1' "), n // 6), F.lit("'")).alias("t"))
        assert long.select(X.strip_tags("t").alias("t")).first().t == "k"
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:  # a wall-clock time that this zone skips
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2025-03-09T02:30",)], "t string")
        assert df.select(X.parse_timestamp("t", "2000-01-01 00:00:00").cast("string").alias("t")).first().t == "2025-03-09 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    r = spark.range(1).select(X.height_m(F.lit("17000cm")).alias("tall"), X.height_m(F.lit("1.7e2")).cast("string").alias("exp"),
                              *[X.is_empty(F.lit(v)).alias(f"e{i}") for i, v in enumerate(["", "0", "false", "0.0"])]).first()
    assert r.tall is None and r.exp == "1.70"
    assert [r.e0, r.e1, r.e2, r.e3] == [True, True, False, False]
    names = spark.createDataFrame([("Ionuț",), ("Nguyễn",), ("Jose\u0301",), ("Łódź",)], "n string")
    assert [r.f for r in names.select(X.fold("n").alias("f")).collect()] == ["ionut", "nguyen", "jose", "lodz"]


def test_json_answers_keep_nulls(spark, seed):
    import tempfile as tf

    from wardlake.operators import reads as R
    from wardlake.sources import sinks
    df = R.patient_card(seed, "2025-06-01", patients=[1])
    text = df.select(sinks.answer_json(df).alias("j")).collect()[0].j
    assert json.loads(text)["id_patient"] == 1 and "phone" in json.loads(text)
    out = tf.mkdtemp(prefix="wardlake-json-", dir="/tmp") + "/free"
    sinks.write_answers(R.free_rooms(seed), out)
    back = spark.read.json(out)
    assert back.count() == 4
    nested = sinks.keyed_answers(R.free_rooms(seed), "id_service", "rooms").collect()
    assert sorted(len(r.rooms) for r in nested) == [1, 1, 1, 1]


def test_ingest_stream_ids_continue_across_batches(spark, seed):
    folder = tempfile.mkdtemp(prefix="wardlake-req2-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="wardlake-ing2-", dir="/tmp")
    good = dict(request_id=1, requested_at="2025-06-01T08:00:00", id_stay="3", id_nurse="2", state="Ok",
                blood_pressure="120/80", temperature="37.2", heart_rate="80", spo2="97", glucose="5.5",
                weight="70", height="170", remark="fine", observed_at="2025-06-01T08:00")
    with open(f"{folder}/a.json", "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(dict(good, request_id=2)) + "\n")
    q = st.start_observation_ingest(spark, seed, folder, out_dir, "2025-06-01 00:00:00", f"{out_dir}-state")
    q.awaitTermination()
    with open(f"{folder}/b.json", "w") as f:
        f.write(json.dumps(dict(good, request_id=3)) + "\n")
    # a new start with the same checkpoint goes on: only b.json is new, ids continue
    st.start_observation_ingest(spark, seed, folder, out_dir, "2025-06-01 00:00:00", f"{out_dir}-state").awaitTermination()
    acc = sorted((r.request_id, r.id_obs) for r in spark.read.parquet(f"{out_dir}/accepted").collect())
    assert acc == [(1, 9), (2, 10), (3, 11)]


def test_json_requests_split_malformed(spark):
    from wardlake import schemas as S
    from wardlake.sources.requests import read_json_requests
    folder = tempfile.mkdtemp(prefix="wardlake-json-req-", dir="/tmp")
    with open(f"{folder}/r.json", "w") as f:
        f.write(json.dumps({"request_id": 1, "id_stay": "3", "action": "discharge", "id_room": "3"}) + "\n")
        f.write("{broken\n")
    good, bad = read_json_requests(spark, folder, S.STATUS_REQ)
    assert [r.request_id for r in good.collect()] == [1]
    assert [r.reason for r in bad.collect()] == ["malformed"]


def test_a_request_sent_again_is_taken_once_and_new_versions_are_seen(spark, seed):
    folder = tempfile.mkdtemp(prefix="wardlake-req3-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="wardlake-ing3-", dir="/tmp")
    good = dict(request_id=1, requested_at="2025-06-01T08:00:00", id_stay="3", id_nurse="2", state="Ok",
                blood_pressure="120/80", temperature="37.2", heart_rate="80", spo2="97", glucose="5.5",
                weight="70", height="170", remark="fine", observed_at="2025-06-01T08:00")
    version = [seed]

    def put(name, *requests):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in requests))

    def run():
        st.start_observation_ingest(spark, lambda: version[0], folder, out_dir, "2025-06-01 00:00:00", f"{out_dir}-state").awaitTermination()

    put("a", good, good, "{broken", "{broken too", dict(good, request_id=2, id_stay="99"))
    run()
    # sent again after a restart, with an old time; and a stay that only the next version knows
    version[0] = seed.replace(stay=seed.stay.unionByName(seed.stay.where("id_stay = 3").withColumn("id_stay", F.lit(99).cast("bigint"))))
    put("b", dict(good, requested_at="2020-01-01T00:00:00"), dict(good, request_id=3, id_stay="99", requested_at="2019-01-01T00:00:00"))
    run()
    assert sorted(r.request_id for r in spark.read.parquet(f"{out_dir}/accepted").collect()) == [1, 3]
    assert rows(spark.read.parquet(f"{out_dir}/rejects"), "reason") == [("malformed",), ("malformed",), ("unknown stay",)]


def test_newest_observation_output_does_not_grow_with_the_batches(spark, seed):
    import random

    folder = tempfile.mkdtemp(prefix="wardlake-gen-in-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="wardlake-gen-out-", dir="/tmp") + "/newest"
    obs = seed.observation
    hours = list(range(7))
    random.Random(2).shuffle(hours)
    parts = [obs.withColumn("observed_at", F.col("observed_at") + F.expr(f"INTERVAL {h} HOUR")).withColumn("id_obs", F.col("id_obs") + 100 * h) for h in hours]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{folder}/f{i}")
    source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    st.start_newest_observation(spark, source, out_dir, f"{out_dir}-state", merge_after=2).awaitTermination()
    live = st._parts(spark, out_dir)
    assert 1 <= len(live) <= 2 and len(list(__import__("pathlib").Path(out_dir).glob("part=*"))) == 7
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    got = st.read_newest_observation(spark, out_dir)
    assert rows(got, "id_stay", "id_obs") == rows(reads.newest_observation(seed.replace(observation=whole)), "id_stay", "id_obs")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" in provider

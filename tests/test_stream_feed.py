"""The feed of the newest-observation query: seven micro-batches, each of files of bounded size."""

from __future__ import annotations

import tempfile
from pathlib import Path

from wardlake.plans import catalog
from wardlake.session import checkpoint_dir
from wardlake.sources.standin import DRIVER_SCHEMAS


def test_a_micro_batch_is_many_files(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="wardlake-feed-", dir="/tmp")
    lines = spark.range(0, 4200, 1, 3).selectExpr(
        "id % 500 l_orderkey", "id % 700 l_partkey", "id % 50 l_suppkey", "cast(id % 7 as int) l_linenumber", "cast(id as double) l_quantity",
        "1.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'N' l_returnflag", "'O' l_linestatus",
        "cast(timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id * 7919 % 4200 as int)) as timestamp_ntz) l_shipdate")
    assert lines.schema.simpleString() == spark.createDataFrame([], DRIVER_SCHEMAS["lineitem"]).schema.simpleString()
    lines.write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(catalog, "FEED_FILE_ROWS", 100, raising=False)
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("newest-obs-*"))
    got = catalog.q_stream_newest_observation(spark, folder)
    assert got.count() == 500
    assert {r.id_stay: r.observed_at for r in got.collect()} == {
        r.l_orderkey: r.at for r in lines.groupBy("l_orderkey").agg({"l_shipdate": "max"}).toDF("l_orderkey", "at").collect()}
    (run,) = set(root.glob("newest-obs-*")) - before
    sizes = [spark.read.parquet(str(f)).count() for f in (run / "in").glob("*.parquet")]
    assert sum(sizes) == 4200 and max(sizes) <= 300
    assert len([f for f in (run / "state" / "offsets").iterdir() if f.name.isdigit()]) == 7

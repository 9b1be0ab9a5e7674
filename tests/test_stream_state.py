"""The newest-observation stream keeps its state on disk, whatever the session's settings."""

from __future__ import annotations

import tempfile
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from wardlake.operators import reads
from wardlake.session import STATE_CONF
from wardlake.streaming import observations as st

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def test_state_is_on_disk_in_any_session(spark, seed):
    folder = tempfile.mkdtemp(prefix="wardlake-state-in-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="wardlake-state-out-", dir="/tmp")
    obs = seed.observation
    later = obs.withColumn("observed_at", F.col("observed_at") + F.expr("INTERVAL 1 HOUR")).withColumn("id_obs", F.col("id_obs") + 100)
    later.write.parquet(f"{folder}/a")
    obs.write.parquet(f"{folder}/b")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        spark.conf.set(PROVIDER, HEAP)
        source = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        st.start_newest_observation(spark, source, f"{out}/newest", f"{out}/state", merge_after=1).awaitTermination()
        assert spark.conf.get(PROVIDER) == HEAP
    finally:
        spark.conf.set(PROVIDER, before[PROVIDER])
    assert {k: spark.conf.get(k, None) for k in STATE_CONF} == before
    offsets = [f.read_text() for f in Path(f"{out}/state/offsets").iterdir() if f.name.isdigit()]
    assert offsets and all("RocksDBStateStoreProvider" in o and HEAP not in o for o in offsets)
    got = st.read_newest_observation(spark, f"{out}/newest")
    assert rows(got, "id_stay", "id_obs") == rows(reads.newest_observation(seed.replace(observation=obs.unionByName(later))), "id_stay", "id_obs")

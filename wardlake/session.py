"""Spark session set-up and the shared checkpoint folder.

The library never creates a global session; callers pass one in.  These
helpers only give a sensible default for scripts and tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Streaming state on local disk with changelog checkpoints, not in the executors' heap; what RocksDB itself
# holds is bounded per executor, and no put reads the old value for a row count. A stream sets these for itself.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

# Settings every job of the library relies on.  AQE re-plans joins with the
# real shuffle sizes (a small side becomes a broadcast there, with its size
# measured, not guessed) and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **STATE_CONF,
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wardlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started within keep their state by ``STATE_CONF``, whatever the
    caller's session says (Spark's own default holds every key in the heap, and
    copies the table of the keys at each micro-batch).  A stream takes the
    settings when it starts; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints and intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it.
    Only when it is unset (local runs, tests) do we pick our own folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.startswith("local"):
            # one machine: a scratch folder is shared by "all executors"
            conf_dir = tempfile.mkdtemp(prefix="wardlake-ckpt-", dir=os.environ.get("WARDLAKE_TMP", "/tmp"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir

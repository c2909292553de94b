"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state"

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE: f"{_STORES}.RocksDBStateStoreProvider",
}


def build_session(app: str = "loghelm", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave ``master`` out and set shuffle partitions to two or three
    times the number of cores; AQE then merges the small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state with timers needs, for streams started inside, whoever built the session.

    Spark's default store holds one column family. Another store that was chosen stays, and a stream goes on with
    the store its checkpoint was begun with.
    """
    before = spark.conf.get(STATE_STORE)
    if before == f"{_STORES}.HDFSBackedStateStoreProvider":
        spark.conf.set(STATE_STORE, ENGINE_CONF[STATE_STORE])
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = spark.conf.get("loghelm.local.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="loghelm-")
        spark.conf.set("loghelm.local.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df):
    """Use the cores on a scan that yields far fewer splits than there are cores.

    A file of a single row group is one split, whatever its size. Only a table
    with less than one split for every four cores is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 4 * df.rdd.getNumPartitions() > cores else df.repartition(cores)

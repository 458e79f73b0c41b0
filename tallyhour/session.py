"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    # dates and hours follow the session zone, so the library always names it
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target the advisory partition size instead of filling every core
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # recording the Python call site of every column doubles the time to build a frame
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # dedup state outgrows executor heap long before it outgrows local disk
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build(app: str = "tallyhour", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def for_state(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session for a query that keeps state, with ``partitions`` or else the configured number of them.

    The first start of such a query fixes its partitions for good, and each holds a store
    to commit in every batch; adaptive execution does not merge them. Choose about the cores the
    query will have.
    """
    session = pin_utc(spark.newSession())
    chosen = str(partitions) if partitions else spark.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", chosen)
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may go without one: it gets a new folder for the run.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/tallyhour/{label}-{uuid.uuid4().hex}"

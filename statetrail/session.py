"""Session settings and the shared folder that durable intermediate data goes to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def build_session(app: str = "statetrail", master: str | None = None, **conf) -> SparkSession:
    """Start (or reuse) a session; keyword names use ``_`` where Spark uses ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


#: Beginnings of the folders that cut units and ranked rows are stored in.
CUT_PREFIX, RANGE_PREFIX = "trail-", "ranges-"


def require_shared_dir(spark: SparkSession) -> None:
    """Fail at once, not when the first unit is too large, where the cluster names no folder."""
    if not spark.sparkContext.master.startswith("local"):
        shared_dir(spark)


def remove_intermediate(spark: SparkSession) -> int:
    """Delete what cut units and ranked rows were stored in; returns the number of folders.

    To be called once the frames that read them are done with.
    """
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in (files.listStatus(base) if files.exists(base) else ())
            if s.getPath().getName().startswith((CUT_PREFIX, RANGE_PREFIX))]
    for path in gone:
        files.delete(path, True)
    return len(gone)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; on a cluster a missing setting is an error, since a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="statetrail-"))
    return context.getCheckpointDir()

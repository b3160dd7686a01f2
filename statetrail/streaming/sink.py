"""Files that a stream writes its updates to, and the table they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import stored_log


#: Micro-batches after which updates by key are brought together in one folder.
COMPACT_EVERY = 20


def write_updates(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  keys: list[str] | None = None, **trigger) -> StreamingQuery:
    """Start ``stream``; every micro-batch gets a folder that a retry overwrites.

    So each update counts once, also when a batch is run again after a failure. With ``keys``
    only the newest update of each key is kept of every COMPACT_EVERY folders (``compact``).
    """
    spark, schema = stream.sparkSession, stream.schema
    if not _files(spark, path)[1].exists(_path(spark, f"{path}/batch_id=-1")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        if keys is not None and batch_id and batch_id % COMPACT_EVERY == 0:
            compact(spark, path, schema, keys, batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(write))
    return (writer.trigger(**trigger) if trigger else writer).start()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    base = _path(spark, path)
    return base, base.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_folders(spark: SparkSession, path: str, before: int) -> None:
    """Delete the folders of micro-batches with a number less than ``before``."""
    base, files = _files(spark, path)
    for status in files.listStatus(base) if files.exists(base) else ():
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < before:
            files.delete(status.getPath(), True)


def compact(spark: SparkSession, path: str, schema, keys: list[str], batch_id: int) -> None:
    """Replace the folders of all micro-batches before ``batch_id`` by one with the newest updates.

    The new folder is written beside the others and takes their place when it is complete, so
    that a batch that is run again after a failure goes on from there.
    """
    merged = _path(spark, f"{path}/_before_{batch_id}")
    _, files = _files(spark, path)
    if not files.exists(_path(spark, f"{merged}/_SUCCESS")):
        last_updates(spark, path, schema, keys).write.mode("overwrite").parquet(str(merged))
    drop_folders(spark, path, batch_id)
    files.rename(merged, _path(spark, f"{path}/batch_id={batch_id - 1}"))


def append_log_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of log rows to a table laid out as by ``sources.append_log``."""
    writer = (stored_log(rows).writeStream.format("parquet")
              .partitionBy("day").option("checkpointLocation", checkpoint))
    return (writer.trigger(**trigger) if trigger else writer).start(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  keys: list[str] | None = None) -> None:
    """Work off what is there and stop."""
    write_updates(stream, path, checkpoint, mode, keys, availableNow=True).awaitTermination()


def last_updates(spark: SparkSession, path: str, schema,
                 keys: list[str] | None = None) -> DataFrame:
    """The written rows; with ``keys``, only the newest update of each key."""
    rows = spark.read.option("basePath", path).schema(
        spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long")).schema
    ).parquet(path)
    if keys is None:
        return rows.drop("batch_id")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return (rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
            .drop("_rank", "batch_id"))

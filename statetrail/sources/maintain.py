"""Changes written back to a log that is laid out by day: updated rows and purged units.

Only the days that a change touches are written again. Their new content is staged beside the
log first and then takes the place of the old one, so that a run that failed can be repeated. Units
are purged by a mark, which reads apply, until their rows are taken out day by day.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import LOOKUP_ROWS, small
from .tables import read_log, stored_log, update_where

STAGED, DONE, PURGED = "_staged", "_changes", "_purged"  # readers of the log pass over these


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    path, files = _file(spark, path)
    return files.exists(path)


def _delete(spark: SparkSession, path: str) -> None:
    path, files = _file(spark, path)
    files.delete(path, True)


def _finish(spark: SparkSession, path: str, name: str) -> None:
    """Put the staged days in their place; doing it again changes nothing."""
    staged = f"{path}/{STAGED}/{name}"
    if _exists(spark, f"{staged}/rows/_SUCCESS") and _exists(spark, f"{staged}/days/_SUCCESS"):
        rows = read_log(spark, f"{staged}/rows")
        filled = {r[0] for r in rows.select("day").distinct().collect()}  # days, as below
        (rows.withColumnRenamed("log_id", "id").hint("rebalance", F.col("day")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
        for (day,) in spark.read.schema("day date").parquet(f"{staged}/days").collect():
            if day not in filled:
                _delete(spark, f"{path}/day={day or '__HIVE_DEFAULT_PARTITION__'}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/{DONE}/{name}")
    _delete(spark, staged)


def _rewrite(spark: SparkSession, path: str, name: str, days: DataFrame,
             change: Callable[[DataFrame], DataFrame]) -> None:
    if _exists(spark, f"{path}/{DONE}/{name}/_SUCCESS"):
        return
    staged = f"{path}/{STAGED}/{name}"
    # the list of days is written last: with it, the stage is complete
    if not _exists(spark, f"{staged}/days/_SUCCESS"):
        _delete(spark, staged)
        touched = [r[0] for r in days.distinct().collect()]  # a date for each day of the change
        there = F.col("day").isin([d for d in touched if d is not None])
        there = there | F.col("day").isNull() if None in touched else there
        rows = stored_log(change(read_log(spark, path).filter(there)).drop("day"))
        rows.hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{staged}/rows")
        spark.createDataFrame([(d,) for d in touched], "day date").coalesce(1).write.parquet(f"{staged}/days")
    _finish(spark, path, name)


def rewrite_log(spark: SparkSession, path: str, condition: Column, changes: Mapping[str, Column],
                name: str) -> None:
    """``update_where`` on a stored log; days without a changed row keep their files.

    Rows may change their day: the days that they leave and reach are both written again, and a
    day that loses its last row goes. ``name`` stands for this change: once it is complete a further
    run with the same name does nothing, and after a failure it goes on where the last one
    ended. While the days are put in their place, readers may see some of them changed and others not.
    """
    met = read_log(spark, path).filter(condition)
    after = update_where(met, F.lit(True), changes).select(F.to_date("ts").alias("day"))
    _rewrite(spark, path, name, met.select("day").unionByName(after),
             lambda rows: update_where(rows, condition, changes))


def mark_purged(ids: DataFrame, path: str) -> None:
    """Note that the units in ``ids`` (column ``unit_id``) are purged; the log is not touched."""
    ids.select(F.col("unit_id").cast("long")).filter("unit_id IS NOT NULL").distinct().write.mode(
        "append").parquet(f"{path}/{PURGED}")


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, f"{path}/{PURGED}"):
        return None
    return spark.read.schema("unit_id long").parquet(f"{path}/{PURGED}").distinct()


def read_live_log(spark: SparkSession, path: str) -> DataFrame:
    """The log without the rows of units that are marked as purged."""
    log, marks = read_log(spark, path), _marks(spark, path)
    return log if marks is None else log.join(
        small(marks, 10 * LOOKUP_ROWS), "unit_id", "left_anti").select(*log.columns)


def fold_purged(spark: SparkSession, path: str) -> None:
    """Take the rows of marked units out of the days that hold any, and drop the marks.

    If it fails it can be run again: until the marks are dropped, reads leave the rows out anyway.
    Marks made meanwhile are lost, so nobody else may mark units at the same time.
    """
    marks = _marks(spark, path)
    if marks is None:
        return
    marks = small(marks, 10 * LOOKUP_ROWS)
    days = read_log(spark, path).join(marks, "unit_id", "left_semi").select("day")
    _rewrite(spark, path, f"purge-{uuid.uuid4().hex}", days,
             lambda rows: rows.join(marks, "unit_id", "left_anti").select(*rows.columns))
    _delete(spark, f"{path}/{PURGED}")

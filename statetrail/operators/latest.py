"""Latest row per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_unit(log: DataFrame, key: str = "unit_id", time: str = "ts",
                    tie: str = "log_id") -> DataFrame:
    """The row with the greatest ``time`` per ``key``; ``tie`` decides between equal times.

    Spark keeps one row per key and input partition before the shuffle (WindowGroupLimit), so
    a key with a large share of the rows sends no more than the others.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")

"""Time ranges over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(log: DataFrame, since: Column, until: Column | None = None) -> DataFrame:
    """Rows with ``since <= ts < until``; a log stored by day is pruned by ``day`` as well."""
    kept = F.col("ts") >= since
    if until is not None:
        kept = kept & (F.col("ts") < until)
    if "day" in log.columns:
        kept = kept & (F.col("day") >= F.to_date(since))
        if until is not None:
            kept = kept & (F.col("day") <= F.to_date(until))
    return log.filter(kept)

"""Size-checked use of the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_ROWS = 10_000


def small(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """Hint a broadcast where ``df`` has at most ``limit`` rows, else leave the join to Spark."""
    seen = len(df.select(F.lit(1)).limit(limit + 1).collect())
    return F.broadcast(df) if seen <= limit else df


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list:
    """Rows of a table that has to be small, such as the transition graph."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lookup table of at most {limit} rows is expected: {df.columns}")
    return rows

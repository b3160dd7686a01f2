"""Rows of an entity in time order, with access to their neighbours.

``lead``, ``lag`` and range frames bring all rows of a key into one task. That is fine until a
key holds a large share of the table. A :class:`Trail` therefore counts first. Keys with more
rows than one task should sort are cut into *pieces*: Spark range-partitions and sorts their rows
by (key, time, tie), and so many rows on are a piece. The piece number is stored with the rows in
the shared folder, so that every later read, also after a lost executor, sees the same cut.
Windows then run per (key, piece), and what crosses a piece border comes from one summary row
per piece.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import CUT_PREFIX, shared_dir

ROWS_PER_TASK = 5_000_000
# rows of cut keys that make a range of their own, however small the pieces are
RANGE_ROWS = 200_000
# piece summaries and keys are sent to every task up to so many rows, and shuffled beyond
BROADCAST_ROWS = 100_000
WHOLE = -1  # piece number of a key that was not cut


@dataclass(frozen=True)
class Trail:
    rows: DataFrame
    key: str
    time: str
    tie: str
    piece: str | None = None  # column with the piece number, if any key was cut
    few: bool = True  # whether the piece summaries may be broadcast

    @property
    def group(self) -> list[str]:
        return [self.key] if self.piece is None else [self.key, self.piece]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.time, self.tie)

    @property
    def cut_rows(self) -> DataFrame:
        """Rows of the keys that were cut; the other branch of the union is pruned."""
        return self.rows.filter(F.col(self.piece) > WHOLE)

    def on(self, rows: DataFrame) -> Trail:
        """The same order over rows derived from these."""
        return replace(self, rows=rows)

    def _attach(self, rows: DataFrame, summaries: DataFrame, name: str) -> DataFrame:
        """Add a column of the piece summaries; rows of the key NULL meet theirs too."""
        there = summaries.select(*[F.col(c).alias(f"_{c}_") for c in self.group], name)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in self.group]
        there = F.broadcast(there) if self.few else there
        return rows.join(there, same, "left").drop(*[f"_{c}_" for c in self.group])

    def with_previous(self, **columns: str) -> Trail:
        """Add columns of the row before: ``with_previous(last_state="state")``."""
        return self._neighbour(columns, F.lag, F.max_by)

    def with_next(self, **columns: str) -> Trail:
        """Add columns of the row after."""
        return self._neighbour(columns, F.lead, F.min_by)

    def _neighbour(self, columns, step, border) -> Trail:
        if self.piece is None:
            return self.on(self.rows.select("*", *[
                step(source).over(self.window).alias(name) for name, source in columns.items()]))
        # the border row of each piece, seen from the piece after (or before) it
        values = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
        ends = self.cut_rows.groupBy(self.group).agg(
            border(values, F.struct(self.time, self.tie)).alias("_end"))
        pieces = Window.partitionBy(self.key).orderBy(self.piece)
        across = ends.select(*self.group, step("_end").over(pieces).alias("_across"))
        rows = self._attach(
            self.rows.withColumn("_near", step(values).over(self.window)), across, "_across")
        found = rows.select(*self.rows.columns, F.coalesce("_near", "_across").alias("_found"))
        return self.on(found.select(
            *self.rows.columns, *[F.col(f"_found.{name}").alias(name) for name in columns]))

    def with_rank(self, name: str) -> Trail:
        """Add the row's position within its key, from 1."""
        rank = F.row_number().over(self.window).cast("long")
        if self.piece is None:
            return self.on(self.rows.withColumn(name, rank))
        sizes = self.cut_rows.groupBy(self.group).agg(F.count("*").alias("_n"))
        before = (Window.partitionBy(self.key).orderBy(self.piece)
                  .rowsBetween(Window.unboundedPreceding, -1))
        skipped = sizes.select(*self.group, F.sum("_n").over(before).alias("_skip"))
        rows = self._attach(self.rows.withColumn(name, rank), skipped, "_skip")
        return self.on(rows.select(
            *self.rows.columns,
            (F.col(name) + F.coalesce("_skip", F.lit(0))).alias(name)))

    def with_earlier_time(self, name: str) -> Trail:
        """Add the greatest time of the key that is strictly before the row's own.

        Unlike ``lag`` this steps over rows of equal time.
        """
        # ordered by the time itself, so that a sort by (time, tie) serves this window too
        here = self.on(self.rows.withColumn(name, F.expr(
            f"max({self.time}) OVER (PARTITION BY {', '.join(self.group)} ORDER BY {self.time} "
            "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '0.000001' SECOND PRECEDING)")))
        if self.piece is None:
            return here
        # Rows without an earlier time in their piece all stand at the piece's first time. The
        # answer for them is a last time, or the one before it, of some piece of the key.
        ends = here.cut_rows.groupBy(self.group).agg(
            F.min(self.time).alias("_first"),
            F.max(self.time).alias("_last"),
            F.max_by(name, self.time).alias("_before_last"))
        points = ends.select(self.key, F.explode(F.array(
            F.struct(F.col(self.piece), F.col("_first").alias("_at"),
                     F.lit(None).cast("timestamp").alias("_seen")),
            *[F.struct(F.lit(None).cast("long").alias(self.piece), F.col(at).alias("_at"),
                       F.col(at).alias("_seen")) for at in ("_last", "_before_last")],
        )).alias("_point")).select(self.key, "_point.*").filter("_at IS NOT NULL")
        earlier = (Window.partitionBy(self.key).orderBy(F.unix_micros("_at"))
                   .rangeBetween(Window.unboundedPreceding, -1))
        across = (points.withColumn("_across", F.max("_seen").over(earlier))
                  .filter(F.col(self.piece).isNotNull())
                  .select(*self.group, "_across"))
        rows = self._attach(here.rows, across, "_across")
        return self.on(rows.select(
            *self.rows.columns, F.coalesce(name, "_across").alias(name)))


def trail(rows: DataFrame, key: str = "unit_id", time: str = "ts", tie: str = "log_id",
          rows_per_task: int | None = None) -> Trail:
    """Order ``rows`` per ``key`` by (``time``, ``tie``), cutting the keys that are too large.

    The total comes from the file footers when ``rows`` is a plain scan. Only if it exceeds
    ``rows_per_task`` are the keys counted; those above the limit, of which there are at most
    total / limit, are stored. Pieces grow in number with the rows of these keys, so that none
    holds more than the limit, but for rows of equal (key, time, tie), which stay together. Tasks
    and files grow with the rows, too, and not with the pieces where these are small. Keys and
    piece summaries are broadcast while they are few and shuffled beyond. The key NULL is a key
    like others.
    """
    limit = rows_per_task or ROWS_PER_TASK
    if rows.count() <= limit:
        return Trail(rows, key, time, tie)
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{CUT_PREFIX}{uuid.uuid4().hex}"
    (rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("n"))
     .filter(F.col("n") > limit).write.parquet(f"{path}/keys"))
    hot = spark.read.parquet(f"{path}/keys")
    n_keys, n_rows = hot.agg(F.count("*"), F.sum("n")).first()
    if not n_keys:
        return Trail(rows, key, time, tie)

    keys = hot.select("_hot")
    keys = F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys
    same = rows[key].eqNullSafe(keys["_hot"])
    ranges = ceil(2 * n_rows / max(limit, 2 * RANGE_ROWS))
    equal = Window.partitionBy(key, time, tie)  # served by the ranges and their sort
    (rows.join(keys, same, "left_semi")
     .repartitionByRange(ranges, key, time, tie)
     .sortWithinPartitions(key, time, tie)
     .withColumn("_at", F.monotonically_increasing_id())
     .withColumn("_at", F.min("_at").over(equal))
     .withColumn("piece", _piece(F.col("_at"), limit)).drop("_at")
     .write.parquet(f"{path}/rows"))
    cut = spark.read.parquet(f"{path}/rows")
    uncut = rows.join(keys, same, "left_anti").withColumn("piece", F.lit(WHOLE).cast("long"))
    summaries = ceil(n_rows / limit) + ranges + n_keys
    return Trail(uncut.unionByName(cut), key, time, tie, "piece", summaries <= BROADCAST_ROWS)


def _piece(at: Column, limit: int) -> Column:
    """The piece of the row at a place: number of the range, and of ``limit`` rows in it."""
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    return at - place + F.floor(place / limit)

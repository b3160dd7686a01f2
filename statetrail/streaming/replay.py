"""Signals in large micro-batches, without keyed state in a task.

The stateful job in :mod:`jobs` sorts what a unit brings in a micro-batch inside one task. Where
one unit may bring a large share of a large micro-batch, such as a backlog, this job runs the
batch replay instead, which cuts such units into pieces. The state of all units is a table that
is written anew with every micro-batch, so it suits few large batches rather than many small.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import StateModel
from ..operators.latest import latest_per_unit
from ..plans.machine import signal_outcomes
from .sink import drop_folders

STATE_SCHEMA = "unit_id bigint, event_id bigint, ts timestamp, state bigint"
OUTCOME_SCHEMA = ("unit_id bigint, event_id bigint, ts timestamp, signal_id bigint, "
                  "signal string, payload string, initial_state_id bigint, "
                  "final_state_id bigint, outcome string")


def replay_batches(signals: DataFrame, model: StateModel, path: str, checkpoint: str, *,
                   rows_per_task: int | None = None, **trigger) -> StreamingQuery:
    """Write the outcome of every signal below ``path/outcomes``; see ``last_updates``.

    Micro-batch ``n`` reads the states that ``n - 1`` left and writes its own, each into a
    folder of its number. A batch that is run again after a failure overwrites its folders
    and nothing counts twice.
    """
    spark = signals.sparkSession
    names = signals.columns

    def states(batch_id: int) -> str:
        return f"{path}/states/batch_id={batch_id}"

    def outcomes(batch_id: int) -> str:
        return f"{path}/outcomes/batch_id={batch_id}"

    def run(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(STATE_SCHEMA).parquet(states(batch_id - 1))
        marks = known.select("unit_id", F.struct("ts", "event_id").alias("_mark"))
        # a signal that comes twice within a batch is late the second time, as across batches
        again = F.row_number().over(Window.partitionBy("unit_id", "ts", "event_id").orderBy(
            "signal", "payload")) > 1
        dated = batch.withColumn("_again", again).join(marks, "unit_id", "left")
        dated = dated.withColumn("_late", F.col("_again") | F.coalesce(
            F.struct("ts", "event_id") <= F.col("_mark"), F.lit(False))).persist()
        log = known.select(F.col("event_id").alias("log_id"), "unit_id", "ts",
                           F.col("state").alias("final_state_id"))
        moved = signal_outcomes(replace(model, log=log, log_trail=None),
                                dated.filter("NOT _late").select(*names), rows_per_task)
        reached = F.col("final_state_id").isNotNull()
        moved = moved.withColumn("outcome", F.when(reached, "accepted").otherwise("rejected"))
        late = dated.filter("_late").select(*names).withColumn("outcome", F.lit("late"))
        try:
            (moved.unionByName(late, allowMissingColumns=True)
             .write.mode("overwrite").parquet(outcomes(batch_id)))
        finally:
            dated.unpersist()

        written = spark.read.schema(OUTCOME_SCHEMA).parquet(outcomes(batch_id))
        newest = latest_per_unit(written.filter("outcome <> 'late'"), tie="event_id").select(
            "unit_id", "event_id", "ts",
            F.coalesce("final_state_id", "initial_state_id").alias("state"))
        untouched = known.join(newest.select("unit_id"), "unit_id", "left_anti")
        newest.unionByName(untouched).write.mode("overwrite").parquet(states(batch_id))
        # the batch before may still be asked for by a retry of this one, older ones no more
        drop_folders(spark, f"{path}/states", batch_id - 1)

    start = latest_per_unit(model.log.select("unit_id", "log_id", "ts", "final_state_id"))
    (start.select("unit_id", F.lit(-1).cast("bigint").alias("event_id"), "ts",
                  F.col("final_state_id").alias("state"))
     .write.mode("overwrite").parquet(states(-1)))
    spark.createDataFrame([], OUTCOME_SCHEMA).write.mode("overwrite").parquet(outcomes(-1))
    writer = signals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""The log and the signals as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SIGNAL_FAILED, SIGNAL_OK, SLA_STATES
from ..functions.bounds import default_sla_hours, within
from ..functions.payload import technician
from ..functions.times import HOUR
from ..model import StateModel
from ..operators.latest import latest_per_unit
from ..operators.lookup import bounded_rows
from .processors import ALERT, OUTCOME, OrderedSignalProcessor, SignalProcessor, WaitProcessor


def current_state_stream(log: DataFrame) -> DataFrame:
    """Latest row per unit, in update mode; an older row never replaces a newer one."""
    row = F.struct("log_id", "ts", "final_state_id", "payload")
    newest = F.max_by(row, F.struct("ts", "log_id"))
    return log.groupBy("unit_id").agg(newest.alias("last")).select("unit_id", "last.*")


def throughput_stream(log: DataFrame, model: StateModel, delay: str = "1 day") -> DataFrame:
    """Finished, failed and all signals per day."""
    named = model.signals.withColumnRenamed("id", "signal_id")
    return (log.withWatermark("ts", delay).filter(F.col("signal_id").isNotNull())
            .join(named, "signal_id")
            .groupBy(F.window("ts", "1 day"))
            .agg(F.count_if(F.col("signal_name") == SIGNAL_OK).alias("ok_jobs"),
                 F.count_if(F.col("signal_name") == SIGNAL_FAILED).alias("failed_jobs"),
                 F.count("*").alias("total_transitions"))
            .select(F.col("window.start").alias("day"), "ok_jobs", "failed_jobs",
                    "total_transitions"))


def hourly_partials_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Rows per (hour, unit, technician).

    Streams take no exact distinct count. These partial counts do: their newest updates go
    into ``hourly_from_partials``.
    """
    return (log.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 hour"), "unit_id", technician().alias("technician"))
            .agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("hour"), "unit_id", "technician", "n"))


def hourly_activity_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The columns of ``hourly_activity`` for every hour that the watermark has passed, each once.

    Two stateful steps, one behind the other: distinct units and technicians per hour, then
    their counts. Both run in append mode, so an hour is handed out when no row of it can come
    any more, whatever the micro-batches; rows that come later than ``delay`` are ignored.
    """
    kinds = F.array(F.struct(F.lit(True).alias("is_unit"), F.col("unit_id").cast("string").alias("name")),
                    F.struct(F.lit(False).alias("is_unit"), technician().alias("name")))
    met = (log.withWatermark("ts", delay).select("ts", F.explode(kinds).alias("met"))
           .groupBy(F.window("ts", "1 hour"), "met").agg(F.count("*").alias("n")))
    is_unit = F.col("met.is_unit")
    return (met.groupBy(F.window(F.window_time("window"), "1 hour"))
            .agg(F.sum(F.when(is_unit, F.col("n"))).alias("activity_count"),
                 F.count_if(is_unit).alias("unique_units"),
                 F.count_if(~is_unit).alias("active_technicians"))
            .select(F.col("window.start").alias("hour"), "activity_count", "unique_units",
                    "active_technicians"))


def apply_signals_stream(signals: DataFrame, model: StateModel, delay: str | None = None) -> DataFrame:
    """Move units by a stream of signals; ``outcome`` is accepted, rejected or late.

    Units known to the model's log start from their state there. Needs the RocksDB state
    store (see :mod:`statetrail.session`) and append mode. A signal older than one of its unit
    that was handled in an earlier micro-batch is late. With ``delay`` signals are held until the watermark,
    ``delay`` behind the newest one, has passed them. Then outcomes do not depend on the
    micro-batches, and only signals behind the watermark (or without a time) are late.
    """
    if model.initial_state_id is None:
        raise ValueError("no initial state flagged in the state table")
    named = model.signals.withColumnsRenamed({"id": "signal_id", "signal_name": "signal"})
    rows = signals if delay is None else signals.withWatermark("ts", delay)
    rows = (rows.join(named, "signal", "left")
            .select("unit_id", "event_id", F.unix_micros("ts").alias("at"), "signal_id",
                    "signal", "payload"))
    start = latest_per_unit(model.log.select("unit_id", "log_id", "ts", "final_state_id"))
    start = start.select("unit_id", F.col("final_state_id").alias("state"),
                         F.unix_micros("ts").alias("at"))
    processor = SignalProcessor if delay is None else OrderedSignalProcessor
    moved = rows.groupBy("unit_id").transformWithState(
        processor(model.moves, model.initial_state_id), OUTCOME, "Append",
        "None" if delay is None else "EventTime", initialState=start.groupBy("unit_id"))
    return moved.withColumn("ts", F.timestamp_micros("at")).drop("at")


def sla_alerts_stream(log: DataFrame, model: StateModel, *, states: Sequence[str] = SLA_STATES,
                      hours: float | None = None, delay: str = "10 minutes") -> DataFrame:
    """One row for each stay in ``states`` that outlasts ``hours`` of event time.

    It is handed out once the watermark, ``delay`` behind the newest row, has passed the end of
    the allowed time. A stay of exactly ``hours`` is in time. The rows do not depend on how the
    log is cut into micro-batches, but for rows that come later than ``delay``.
    """
    hours = within("hours", default_sla_hours() if hours is None else hours, 1, 168)
    watched = {row["id"]: row["state_name"] for row in
               bounded_rows(model.state.filter(F.col("state_name").isin(*states))
                            .select("id", "state_name"))}
    rows = (log.withWatermark("ts", delay)
            .select("unit_id", "log_id", "final_state_id", "ts", F.unix_micros("ts").alias("at")))
    alerts = rows.groupBy("unit_id").transformWithState(
        WaitProcessor(frozenset(watched), round(hours * HOUR)), ALERT, "Append", "EventTime")
    return (alerts.join(model.states.withColumnRenamed("id", "state_id"), "state_id")
            .select("unit_id", "state_name", F.timestamp_micros("entered").alias("entered_at"),
                    F.timestamp_micros("due").alias("due_at")))

"""Where the units are now."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import SLA_STATES
from ..functions.bounds import default_sla_hours, within
from ..functions.payload import technician
from ..functions.times import HOUR, MINUTE, exact_average, instant, micros_between
from ..model import StateModel
from ..operators.latest import latest_per_unit


def _now_in(model: StateModel, *columns: Column | str) -> DataFrame:
    """Latest log row of every unit with its state name."""
    last = latest_per_unit(model.log.select(
        "unit_id", "log_id", "ts", F.col("final_state_id").alias("id"), *columns))
    return last.join(model.states, "id").drop("id")


def _with_unit(rows: DataFrame, model: StateModel) -> DataFrame:
    unit = model.unit.select(F.col("id").alias("unit_id"), "unit_name",
                             F.col("unit_details").alias("details"))
    return rows.join(unit, "unit_id")


def units_now(model: StateModel) -> DataFrame:
    """State, technician and age of every unit with a log, in no order."""
    return (_with_unit(_now_in(model, "payload"), model)
            .select("unit_id", "unit_name", F.col("state_name").alias("current_state"),
                    F.col("ts").alias("state_since"), "details",
                    technician().alias("technician")))


def current_units(model: StateModel) -> DataFrame:
    """:func:`units_now`, newest first."""
    return units_now(model).orderBy(F.desc("state_since"), F.desc("unit_id"))


def technician_board(model: StateModel, *, as_of=None) -> DataFrame:
    """Units per technician and state, with their average age in minutes."""
    age = micros_between("ts", instant(as_of))
    return (_now_in(model, "payload")
            .groupBy(technician().alias("technician"), F.col("state_name").alias("state"))
            .agg(F.count("*").alias("cnt"),
                 exact_average(age, MINUTE).alias("avg_time_in_state_minutes"))
            .orderBy("technician", "state"))


def technician_workload(model: StateModel) -> DataFrame:
    """Units per named technician and state."""
    return (_now_in(model, "payload")
            .withColumn("technician", technician(default=None))
            .filter(F.col("technician").isNotNull())
            .groupBy("technician", "state_name").agg(F.count("*").alias("workload"))
            .orderBy("technician", F.desc("workload"), "state_name"))


def sla_breaches(model: StateModel, *, as_of=None, states: Sequence[str] = SLA_STATES,
                 hours: float | None = None) -> DataFrame:
    """Units that have been in one of ``states`` for more than ``hours``."""
    hours = within("hours", default_sla_hours() if hours is None else hours, 1, 168)
    age = micros_between("ts", instant(as_of))
    waiting = _now_in(model).filter(
        F.col("state_name").isin(*states) & (age > round(hours * HOUR)))
    return (_with_unit(waiting, model)
            .select(F.col("unit_id").alias("id"), "unit_name", "state_name",
                    F.col("ts").alias("entered_at"), (age / HOUR).alias("hours_in_state"))
            .orderBy(F.desc("hours_in_state"), "id"))


def state_distribution(model: StateModel, *, top: int | None = None) -> DataFrame:
    """Units per state and their share in percent."""
    units = model.unit.select(F.col("id").alias("unit_id"))
    counted = (_now_in(model).join(units, "unit_id")
               .groupBy("state_name").agg(F.count("*").alias("unit_count")))
    # one row per state by now, so the unpartitioned window is small
    total = F.sum("unit_count").over(Window.partitionBy())
    share = (F.col("unit_count") * 100).cast("decimal(20,0)") / total.cast("decimal(20,0)")
    return _first(counted.withColumn("percentage", F.round(share, 2).cast("double"))
                  .orderBy(F.desc("unit_count"), "state_name"), top)


def bottlenecks(model: StateModel, *, as_of=None, top: int | None = None) -> DataFrame:
    """Units per state with the average and longest wait; needs no unit table."""
    age = micros_between("ts", instant(as_of))
    return _first(_now_in(model).groupBy("state_name")
                  .agg(F.count("*").alias("units_currently_in_state"),
                       exact_average(age, HOUR).alias("avg_hours_in_state"),
                       (F.max(age) / HOUR).alias("max_hours_in_state"))
                  .orderBy(F.desc("avg_hours_in_state"), "state_name"), top)


def worker_units(model: StateModel, worker: str, *, as_of=None) -> DataFrame:
    """Units whose latest log row names ``worker``."""
    held = _now_in(model, "payload").filter(technician(default=None) == worker)
    minutes = micros_between("state_since", instant(as_of)) / MINUTE
    return (_with_unit(held, model)
            .select("unit_id", "unit_name", F.col("state_name").alias("current_state"),
                    F.col("ts").alias("state_since"), "details")
            .withColumn("minutes_in_state", minutes)
            .orderBy(F.desc("state_since"), F.desc("unit_id")))


def unit_status(model: StateModel, unit_ids: DataFrame | Iterable[int]) -> DataFrame:
    """State and details of the asked units; without a log they stand in the initial state.

    A list of ids reaches the log scan as a filter. A table of ids (column ``unit_id``) is
    joined after the log has been cut to one row per unit.
    """
    log, unit = model.log, model.unit
    if isinstance(unit_ids, DataFrame):
        asked = unit_ids.select("unit_id")
    else:
        ids = [int(i) for i in unit_ids]
        asked = log.sparkSession.createDataFrame([(i,) for i in ids], "unit_id bigint")
        log, unit = log.filter(F.col("unit_id").isin(ids)), unit.filter(F.col("id").isin(ids))
    last = latest_per_unit(log.select("unit_id", "log_id", "ts", "final_state_id", "payload"))
    details = unit.select(F.col("id").alias("unit_id"), "unit_details")
    status = F.coalesce("final_state_id", F.lit(model.initial_state_id).cast("bigint"))
    names = model.states.withColumnsRenamed({"id": "status_id", "state_name": "status_name"})
    return (asked.join(last, "unit_id", "left").join(details, "unit_id", "left")
            .select("unit_id", status.alias("status_id"),
                    F.coalesce("payload", "unit_details").alias("details"))
            .join(names, "status_id", "left")
            .select("unit_id", "status_id", "status_name", "details"))


def _first(df: DataFrame, top: int | None) -> DataFrame:
    return df if top is None else df.limit(top)

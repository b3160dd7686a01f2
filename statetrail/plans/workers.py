"""What each technician has done."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SIGNAL_FAILED, SIGNAL_OK
from ..functions.bounds import whole_number
from ..functions.payload import technician
from ..functions.times import MINUTE, days_before, micros_between
from ..model import StateModel
from ..operators.lookup import LOOKUP_ROWS, small
from ..operators.ranges import in_range


def _actions(model: StateModel) -> DataFrame:
    """Signals with the technician and the time since the unit's previous row.

    The previous row may be anyone's, also a creation, so it is found before any filter. Only
    the name, not the payload, goes through the shuffle.
    """
    log = model.trail
    rows = log.rows.select(*log.group, log.time, "signal_id",
                           technician(default=None).alias("technician"))
    timed = log.on(rows).with_earlier_time("earlier").rows
    named = model.signals.withColumnRenamed("id", "signal_id")
    return (timed.filter(F.col("technician").isNotNull()).join(named, "signal_id")
            .withColumn("response", micros_between("earlier", "ts")))


def _measures(actions: DataFrame, *by: str, days: bool = False) -> DataFrame:
    """The metrics of :func:`worker_performance` per ``by``.

    Counting per unit and day first leaves little for the distinct counts to expand.
    """
    keys = [*by, "unit_id"] + (["day"] if days else [])
    if days:
        actions = actions.withColumn("day", F.to_date("ts"))
    met = actions.groupBy(*keys).agg(
        F.count_if(F.col("signal_name") == SIGNAL_OK).alias("ok"),
        F.count_if(F.col("signal_name") == SIGNAL_FAILED).alias("failed"),
        F.count("*").alias("n"),
        F.sum(F.col("response").cast("decimal(18,0)")).alias("response"),
        F.count("response").alias("responses"),
        F.min("ts").alias("first"), F.max("ts").alias("last"))
    average = F.sum("response").cast("double") / (F.sum("responses") * F.lit(float(MINUTE)))
    columns = [
        F.count_distinct("unit_id").alias("total_units_handled"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("successful_completions"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_completions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_actions"),
        F.when(F.sum("responses") > 0, F.round(average, 2)).alias("avg_response_time_minutes"),
        F.min("first").alias("first_activity"), F.max("last").alias("last_activity"),
    ]
    if days:
        columns.append(F.count_distinct("day").alias("active_days"))
    return met.groupBy(*by).agg(*columns)


def worker_performance(model: StateModel) -> DataFrame:
    """Units, results, actions and response time per technician."""
    return _measures(_actions(model), "technician").orderBy(
        F.desc("successful_completions"), "technician")


def worker_detail(model: StateModel, worker: str) -> DataFrame:
    """The same for one technician, in one row; an unknown name gives zeros and NULLs."""
    own = technician(default=None) == worker
    touched = model.log.filter(own).select("unit_id").distinct()
    touched = small(touched, 10 * LOOKUP_ROWS)
    # previous rows are found within a unit, so the units that the worker has touched are enough
    some = replace(model, log=model.log.join(touched, "unit_id", "left_semi"), log_trail=None)
    return _measures(_actions(some).filter(F.col("technician") == worker), days=True)


def worker_history(model: StateModel, worker: str, *, as_of=None, days: int = 30,
                   limit: int = 100, sound_units: bool = False) -> DataFrame:
    """The latest ``limit`` signals of a technician within ``days``.

    Units are named once the rows are chosen. Rows of unknown units do not count; with ``sound_units``
    the caller states that there are none, and the unit table is not asked before.
    """
    since = days_before(as_of, whole_number("days", days, 1, 365))
    own = in_range(model.log, since).filter(technician(default=None) == worker)
    before = model.states.withColumnsRenamed({"id": "initial_state_id",
                                              "state_name": "from_state"})
    after = model.states.withColumnsRenamed({"id": "final_state_id", "state_name": "to_state"})
    unit = model.unit.select(F.col("id").alias("unit_id"), "unit_name")
    rows = (own.select("log_id", "unit_id", "initial_state_id", "final_state_id", "signal_id", "ts")
            .join(model.signals.withColumnRenamed("id", "signal_id"), "signal_id")
            .join(before, "initial_state_id").join(after, "final_state_id"))
    if not sound_units:
        rows = rows.join(unit.select("unit_id"), "unit_id", "left_semi")
    order = [F.desc("ts"), F.desc("log_id")]
    latest = rows.orderBy(*order).limit(limit)
    if limit <= LOOKUP_ROWS:
        latest = F.broadcast(latest)
    return (unit.join(latest, "unit_id").orderBy(*order)
            .select("unit_id", "unit_name", "from_state", "to_state", "signal_name",
                    F.col("ts").alias("timestamp")))

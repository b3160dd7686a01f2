"""What happened when. All of these count by id first and look names up afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SIGNAL_FAILED, SIGNAL_OK
from ..functions.bounds import whole_number
from ..functions.payload import technician
from ..functions.times import day_of, day_range, hour_of, hour_range
from ..model import StateModel
from ..operators.ranges import in_range


def _signalled(log: DataFrame) -> DataFrame:
    return log.filter(F.col("signal_id").isNotNull())


def _named_signal(model: StateModel) -> DataFrame:
    return model.signals.withColumnRenamed("id", "signal_id")


def throughput(model: StateModel, *, as_of=None, days: int | None = 30) -> DataFrame:
    """Finished, failed and all signals per day; ``days=None`` takes the whole log."""
    log = _signalled(model.log)
    if days is not None:
        log = in_range(log, *day_range(as_of, whole_number("days", days, 1, 365)))
    counted = log.groupBy(day_of("ts").alias("day"), "signal_id").agg(F.count("*").alias("n"))

    def total(name):
        return F.sum(F.when(F.col("signal_name") == name, F.col("n")).otherwise(0))

    return (counted.join(_named_signal(model), "signal_id").groupBy("day")
            .agg(total(SIGNAL_OK).alias("ok_jobs"), total(SIGNAL_FAILED).alias("failed_jobs"),
                 F.sum("n").alias("total_transitions"))
            .orderBy("day"))


def transition_heatmap(model: StateModel, *, top: int | None = None) -> DataFrame:
    """How often each (from, signal, to) occurred, most frequent first."""
    counted = (_signalled(model.log).groupBy("initial_state_id", "signal_id", "final_state_id")
               .agg(F.count("*").alias("n")))
    before = model.states.withColumnsRenamed({"id": "initial_state_id",
                                              "state_name": "from_state"})
    after = model.states.withColumnsRenamed({"id": "final_state_id", "state_name": "to_state"})
    named = (counted.join(_named_signal(model), "signal_id").join(before, "initial_state_id")
             .join(after, "final_state_id")
             .groupBy("from_state", "signal_name", "to_state").agg(F.sum("n").alias("cnt"))
             .orderBy(F.desc("cnt"), "from_state", "signal_name", "to_state"))
    return named if top is None else named.limit(top)


def daily_activity(model: StateModel, *, as_of=None, days: int | None = 7) -> DataFrame:
    """Rows and distinct units per day and signal; ``days=None`` takes the whole log."""
    log = _signalled(model.log)
    if days is not None:
        log = in_range(log, *day_range(as_of, whole_number("days", days, 1, 365)))
    counted = (log.groupBy(day_of("ts").alias("day"), "signal_id")
               .agg(F.count("*").alias("activity_count"),
                    F.count_distinct("unit_id").alias("unique_units")))
    return (counted.join(_named_signal(model), "signal_id")
            .select("day", "signal_name", "activity_count", "unique_units")
            .orderBy("day", F.desc("activity_count"), "signal_name"))


def hourly_activity(model: StateModel, *, as_of=None, hours: int | None = 24) -> DataFrame:
    """Rows, units and technicians per hour, creations included; ``hours=None``: whole log."""
    log = model.log
    if hours is not None:
        log = in_range(log, *hour_range(as_of, whole_number("hours", hours, 1, 168)))
    # Units take the one large shuffle. Technicians are few per hour, so that they shrink before
    # theirs. Both distinct counts in one aggregate would expand every row.
    hour = hour_of("ts").alias("hour")
    units = (log.groupBy(hour, "unit_id").agg(F.count("*").alias("n")).groupBy("hour")
             .agg(F.sum("n").alias("activity_count"), F.count("*").alias("unique_units")))
    met = log.select(hour, technician().alias("technician")).distinct()
    technicians = met.groupBy("hour").agg(F.count("*").alias("active_technicians"))
    return units.join(technicians, "hour").orderBy("hour")


def hourly_from_partials(met: DataFrame) -> DataFrame:
    """Sum up (hour, unit_id, technician, n) per hour."""
    return (met.groupBy("hour")
            .agg(F.sum("n").alias("activity_count"),
                 F.count_distinct("unit_id").alias("unique_units"),
                 F.count_distinct("technician").alias("active_technicians"))
            .orderBy("hour"))


def workers_list(model: StateModel) -> DataFrame:
    """Names of all technicians in the log."""
    return (model.log.select(technician(default=None).alias("technician"))
            .filter(F.col("technician").isNotNull()).distinct().orderBy("technician"))

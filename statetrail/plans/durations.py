"""How long units stay in a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import MINUTE, exact_average, instant, micros_between
from ..model import StateModel
from ..operators.trail import Trail

LABELS = {"initial": "initial_state_id", "final": "final_state_id"}


def state_intervals(log: Trail, label: str = "initial") -> DataFrame:
    """Each log row as the interval up to the unit's next row; the last one is open.

    ``label="initial"`` names the state the unit has just left, ``"final"`` the one it is in
    during the interval.
    """
    rows = log.rows.select(
        *log.group, log.tie, F.col(_column(label)).alias("state_id"),
        F.col(log.time).alias("entered_at"))
    ordered = Trail(rows, log.key, "entered_at", log.tie, log.piece)
    return ordered.with_next(left_at="entered_at").rows.select(
        log.key, "state_id", "entered_at", "left_at")


def _column(label: str) -> str:
    if label not in LABELS:
        raise ValueError(f"label must be one of {sorted(LABELS)}, got {label!r}")
    return LABELS[label]


def unit_durations(model: StateModel, unit_id: int | None = None, *, as_of=None,
                   label: str = "initial") -> DataFrame:
    """Timeline of a unit. ``unit_id=None`` gives all units, unsorted, with their ids."""
    own = None if unit_id is None else F.col("unit_id") == unit_id
    log = model.trail_of(_column(label), where=own)
    left_at = F.coalesce("left_at", instant(as_of))
    timeline = (state_intervals(log, label).join(
        model.states.withColumnRenamed("id", "state_id"), "state_id")
        .select("unit_id", "state_name", "entered_at", left_at.alias("left_at"),
                (micros_between("entered_at", left_at) / MINUTE).alias("minutes_spent"),
                F.col("left_at").isNull().alias("is_open")))
    if unit_id is None:
        return timeline
    return timeline.drop("unit_id").orderBy("entered_at", "left_at")


def avg_state_durations(model: StateModel, *, label: str = "initial",
                        top: int | None = None) -> DataFrame:
    """Average, count, shortest and longest closed stay per state, in minutes."""
    stay = micros_between("entered_at", "left_at")
    closed = state_intervals(model.trail_of(_column(label)), label).filter(F.col("left_at").isNotNull())
    named = model.states.withColumnRenamed("id", "state_id")
    rows = (closed.join(named, "state_id").groupBy("state_name")
            .agg(F.round(exact_average(stay, MINUTE)).cast("long").alias("avg_minutes"),
                 F.count("*").alias("total_transitions"),
                 (F.min(stay) / MINUTE).alias("min_minutes"),
                 (F.max(stay) / MINUTE).alias("max_minutes"))
            .orderBy(F.desc("avg_minutes"), "state_name"))
    return rows if top is None else rows.limit(top)

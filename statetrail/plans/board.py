"""Reshaping for display: classes, bands, pivots and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    ERROR_WORDS,
    LIFECYCLE,
    LIFECYCLE_STEP_HOURS,
    RATE_ERROR_BELOW,
    RATE_SUCCESS_ABOVE,
    SIGNAL_FAILED,
    SIGNAL_OK,
    SUCCESS_STATES,
    URGENT_WORDS,
    WAIT_ERROR_ABOVE_HOURS,
    WAIT_WARNING_ABOVE_HOURS,
)
from ..functions.times import (
    MINUTE,
    age_text,
    hour_label,
    instant,
    micros_between,
    rounded,
    state_slug,
)
from ..model import StateModel
from .activity import daily_activity, hourly_activity, transition_heatmap
from .current import bottlenecks, technician_board, units_now
from .durations import unit_durations
from .workers import worker_history, worker_performance


def _any_word(state: str, words) -> Column:
    found = F.col(state).contains(words[0])
    for word in words[1:]:
        found = found | F.col(state).contains(word)
    return found


def unit_class(state: str) -> Column:
    return (F.when(_any_word(state, ERROR_WORDS), "error")
            .when(F.col(state).isin(*SUCCESS_STATES), "success").otherwise(""))


def signal_class(signal: str) -> Column:
    return (F.when(F.col(signal) == SIGNAL_OK, "success")
            .when(F.col(signal) == SIGNAL_FAILED, "error").otherwise(""))


def success_rates(model: StateModel, *, top: int | None = None) -> DataFrame:
    """Worker metrics with the share of successful actions in percent and its band."""
    rate = F.when(F.col("total_actions") > 0, rounded(
        F.col("successful_completions") / F.col("total_actions") * 100)).otherwise(0)
    band = (F.when(F.col("success_rate") > RATE_SUCCESS_ABOVE, "success")
            .when(F.col("success_rate") < RATE_ERROR_BELOW, "error").otherwise(""))
    rows = (zero_defaults(worker_performance(model), "avg_response_time_minutes")
            .withColumn("success_rate", rate).withColumn("band", band))
    return rows if top is None else rows.limit(top)


def bottleneck_bands(model: StateModel, *, as_of=None, top: int | None = None) -> DataFrame:
    wait = F.col("avg_hours_in_state")
    band = (F.when(wait > WAIT_ERROR_ABOVE_HOURS, "error")
            .when(wait > WAIT_WARNING_ABOVE_HOURS, "warning").otherwise(""))
    return bottlenecks(model, as_of=as_of, top=top).withColumn("band", band)


def technician_pivot(model: StateModel, *, as_of=None) -> DataFrame:
    """One row per technician: a map state -> (cnt, avg_time), and all tasks.

    The list collected per technician has at most one entry per state.
    """
    entry = F.struct("state", F.struct(
        "cnt", F.coalesce("avg_time_in_state_minutes", F.lit(0.0)).alias("avg_time")))
    return (technician_board(model, as_of=as_of).groupBy("technician")
            .agg(F.map_from_entries(F.collect_list(entry)).alias("states"),
                 F.sum("cnt").alias("total_tasks"))
            .orderBy("technician"))


def technician_columns(model: StateModel, states: list[str], *, as_of=None) -> DataFrame:
    """One row per technician with a count column per state, 0 where there is none."""
    wide = (technician_board(model, as_of=as_of).groupBy("technician")
            .pivot("state", states).agg(F.sum("cnt")))
    return zero_defaults(wide, *states).orderBy("technician")


def unit_classes(model: StateModel) -> DataFrame:
    return units_now(model).withColumn("unit_class", unit_class("current_state"))


def process_board(model: StateModel, *, as_of=None) -> DataFrame:
    """Units with class, age text and slug; troubled ones first, then the oldest."""
    minutes = rounded(micros_between("state_since", instant(as_of)) / MINUTE)
    return (unit_classes(model)
            .withColumn("is_error", _any_word("current_state", URGENT_WORDS))
            .withColumn("minutes_in_state", minutes)
            .withColumn("time_in_state", age_text(F.col("minutes_in_state")))
            .withColumn("state_slug", state_slug("current_state"))
            .orderBy(F.desc("is_error"), F.asc("state_since"), F.asc("unit_id")))


def history_classes(model: StateModel, worker: str, **window) -> DataFrame:
    return worker_history(model, worker, **window).withColumn(
        "history_class", signal_class("signal_name"))


def first_reached(model: StateModel) -> DataFrame:
    """When each unit first got into each state: (unit_id, state_name, reached_at)."""
    found = (model.log.groupBy("unit_id", F.col("final_state_id").alias("id"))
             .agg(F.min("ts").alias("reached_at")))
    return found.join(model.states, "id").select("unit_id", "state_name", "reached_at")


def lifecycle_progress(model: StateModel) -> DataFrame:
    """Each unit against the usual order of states.

    ``estimated_at`` counts two hours per step back from the current state, an invented
    figure; ``reached_at`` is the time found in the log. Both sides of the join have one row
    per unit and the same partitioning; the steps are unfolded after it.
    """
    reached = (model.log.select("unit_id", "ts", F.col("final_state_id").alias("id"))
               .join(model.states, "id").groupBy("unit_id")
               .agg(*[F.min(F.when(F.col("state_name") == name, F.col("ts"))).alias(f"_at{n}")
                      for n, (name, _) in enumerate(LIFECYCLE, 1)]))
    step = F.explode(F.array(*[
        F.struct(F.lit(n).alias("position"), F.lit(name).alias("state_name"),
                 F.lit(label).alias("label"), F.col(f"_at{n}").alias("reached_at"))
        for n, (name, label) in enumerate(LIFECYCLE, 1)]))
    names = F.array(*[F.lit(name) for name, _ in LIFECYCLE])
    here = F.array_position(names, F.col("current_state")).cast("int")
    steps_back = F.col("here") - F.col("position")
    status = (F.when(F.col("state_name") == F.col("current_state"), "current")
              .when((F.col("state_name") == "parts missing")
                    & F.col("current_state").contains("missing"), "error")
              .when(steps_back > 0, "completed").otherwise(""))
    estimate = (F.when(F.col("status").isin("current", "error"), F.col("state_since"))
                .when(F.col("status") == "completed", F.col("state_since")
                      - F.make_dt_interval(hours=steps_back * LIFECYCLE_STEP_HOURS)))
    return (units_now(model).withColumn("here", here).join(reached, "unit_id", "left")
            .select("unit_id", "unit_name", "current_state", "state_since", "here",
                    step.alias("_step"))
            .select("*", "_step.*").drop("_step")
            .withColumn("status", status).withColumn("estimated_at", estimate)
            .select("unit_id", "unit_name", "current_state", "position", "state_name", "label",
                    "status", "estimated_at", "reached_at"))


def daily_rollup(model: StateModel, *, as_of=None, days: int | None = 7) -> DataFrame:
    """Total per day and a map signal -> count; at most one entry per signal."""
    entry = F.struct("signal_name", "activity_count")
    return (daily_activity(model, as_of=as_of, days=days).groupBy("day")
            .agg(F.sum("activity_count").alias("total"),
                 F.map_from_entries(F.collect_list(entry)).alias("signals"))
            .orderBy("day"))


def heatmap_top(model: StateModel, *, top: int = 10) -> DataFrame:
    return transition_heatmap(model, top=top)


def zero_defaults(df: DataFrame, *columns: str) -> DataFrame:
    """0 for missing measures."""
    return df.fillna(0, subset=list(columns))


def hourly_labels(model: StateModel, *, as_of=None, hours: int | None = 24) -> DataFrame:
    return hourly_activity(model, as_of=as_of, hours=hours).withColumn(
        "label", hour_label("hour"))


def timeline_flags(model: StateModel, unit_id: int | None = None, *, as_of=None,
                   label: str = "initial") -> DataFrame:
    """Timeline with rounded minutes and the class of each stay."""
    return (unit_durations(model, unit_id, as_of=as_of, label=label)
            .withColumn("minutes", rounded(F.col("minutes_spent")))
            .withColumn("stay_class", F.when(F.col("is_open"), "current").otherwise("success")))

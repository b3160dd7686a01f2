"""Creating units, moving them by signals, and checking graphs and finished logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import instant
from ..model import StateModel, literal_table
from ..operators.latest import latest_per_unit
from ..operators.lookup import LOOKUP_ROWS, bounded_rows, small
from ..operators.trail import WHOLE, Trail, trail
from ..session import RANGE_PREFIX, shared_dir
from .replay import OUTCOME_SCHEMA, SIGNAL, START, chainer, composer, replayer


def create_units(model: StateModel, new_units: DataFrame, *, as_of=None,
                 order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Units in the initial state: (unit rows, log rows).

    ``new_units`` has ``unit_name``, ``unit_details`` and a unique column ``order``; ids
    continue after the greatest ones in that order. The rows are range-partitioned by it and
    stored with the number of their range; a rank is the place within the range behind what the
    ranges before it hold. Only the sizes of the ranges go to the driver.
    """
    initial = _initial_state(model)
    ranked = _ranked(new_units.select(F.col(order).alias("_order"), "unit_name", "unit_details"))
    last_unit, last_log = (bounded_rows(table.select(F.max(column)))[0][0] or 0
                           for table, column in ((model.unit, "id"), (model.log, "log_id")))
    units = ranked.select((F.col("_rank") + last_unit).alias("id"), "unit_name", "unit_details")
    log = ranked.select(
        (F.col("_rank") + last_log).alias("log_id"),
        (F.col("_rank") + last_unit).alias("unit_id"),
        initial.alias("initial_state_id"), initial.alias("final_state_id"),
        F.col("unit_details").alias("payload"), F.lit(None).cast("bigint").alias("signal_id"),
        instant(as_of).alias("ts"))
    return units, log


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_rank``, their place by ``_order`` from 1."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{RANGE_PREFIX}{uuid.uuid4().hex}"
    (rows.repartitionByRange("_order").withColumn("_range", F.spark_partition_id())
     .write.parquet(path))
    stored = spark.read.parquet(path)
    skipped, before = [], 0
    for number, n in sorted(stored.groupBy("_range").count().collect()):
        skipped.append((number, before))
        before += n
    offsets = literal_table(spark, skipped, "_range int, _skip bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_order"))
    return (stored.withColumn("_place", place).join(F.broadcast(offsets), "_range")
            .withColumn("_rank", F.col("_place") + F.col("_skip")))


def _initial_state(model: StateModel) -> Column:
    if model.initial_state_id is None:
        raise ValueError("no initial state flagged in the state table")
    return F.lit(model.initial_state_id).cast("bigint")


def signal_outcomes(model: StateModel, signals: DataFrame,
                    rows_per_task: int | None = None) -> DataFrame:
    """Every signal with the state before it and, unless rejected, the state after it.

    Units start from their latest log row, else from the initial state, and take their signals
    in (ts, event_id) order. The state is carried through rows sorted by unit; this sequential
    step has no built-in form that does not collect a unit's rows into an array. A unit too
    large for one task is cut into pieces: each piece is summed up as a function state ->
    state, the functions are chained to find the state each piece starts in, and then all
    pieces are replayed at once.
    """
    _initial_state(model)
    initial, moves, states = model.initial_state_id, model.moves, model.state_ids
    named = model.signals.withColumnsRenamed({"id": "signal_id", "signal_name": "signal"})
    ordered = trail(signals, tie="event_id", rows_per_task=rows_per_task)
    piece = F.lit(WHOLE).cast("long") if ordered.piece is None else F.col(ordered.piece)
    rows = ordered.rows.withColumn("piece", piece).join(named, "signal", "left")
    starts = latest_per_unit(
        model.log.select("unit_id", "log_id", "ts", "final_state_id")).select(
        "unit_id", F.lit(WHOLE).cast("long").alias("piece"), F.col("final_state_id").alias("state"))

    if ordered.piece is not None:
        summed = (rows.filter(F.col("piece") > WHOLE)
                  .select("unit_id", "piece", "ts", "event_id", "signal_id")
                  .repartition("unit_id", "piece")
                  .sortWithinPartitions("unit_id", "piece", "ts", "event_id")
                  .mapInArrow(composer(moves, states),
                              "unit_id bigint, piece bigint, leads array<bigint>"))
        # one row per piece, and the start state of each unit that was cut
        links = summed.unionByName(
            starts.join(ordered.cut_rows.select("unit_id").distinct(), "unit_id", "left_semi"),
            allowMissingColumns=True)
        chained = (links.select("unit_id", "piece", "state", "leads").repartition("unit_id")
                   .sortWithinPartitions("unit_id", "piece")
                   .mapInArrow(chainer(states, initial),
                               "unit_id bigint, piece bigint, state bigint"))
        starts = starts.unionByName(chained)

    marked = rows.withColumn("kind", F.lit(SIGNAL)).unionByName(
        starts.withColumn("kind", F.lit(START)), allowMissingColumns=True)
    return (marked.select("unit_id", "piece", "kind", "ts", "event_id", "signal_id", "signal",
                          "payload", "state")
            .repartition("unit_id", "piece")
            .sortWithinPartitions("unit_id", "piece", "kind", "ts", "event_id")
            .mapInArrow(replayer(moves, initial), OUTCOME_SCHEMA))


def apply_signals(model: StateModel, signals: DataFrame, *, strict: bool = False,
                  rows_per_task: int | None = None,
                  path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Move units by signals: (log rows, rejected signals).

    A signal without a transition from the unit's state leaves the unit where it is.
    ``strict=True`` fails the query on such a signal. Event ids and log ids are one sequence.
    With ``path`` all outcomes are written there first and both frames read them, so that the
    replay runs once, whichever are used.
    """
    outcomes = signal_outcomes(model, signals, rows_per_task)
    if strict:
        complaint = F.concat(F.lit("no transition defined for signal "),
                             F.coalesce("signal", F.lit("NULL")), F.lit(" in state "),
                             F.col("initial_state_id").cast("string"))
        outcomes = outcomes.withColumn("final_state_id", F.coalesce(
            "final_state_id", F.raise_error(complaint).cast("bigint")))
    if path is not None:
        outcomes.write.parquet(path)
        outcomes = outcomes.sparkSession.read.schema(outcomes.schema).parquet(path)
    log = outcomes.filter(F.col("final_state_id").isNotNull()).select(
        F.col("event_id").alias("log_id"), "unit_id", "initial_state_id", "final_state_id",
        "payload", "signal_id", "ts")
    rejected = outcomes.filter(F.col("final_state_id").isNull()).select(
        "event_id", "unit_id", "signal", "payload", "ts",
        F.col("initial_state_id").alias("state_id"))
    return log, rejected


def observed_transitions(log: DataFrame) -> DataFrame:
    """The transition graph that a log shows, with how often each edge was taken."""
    return (log.filter(F.col("signal_id").isNotNull())
            .groupBy("signal_id", F.col("initial_state_id").alias("in_state_id"),
                     F.col("final_state_id").alias("out_state_id"))
            .agg(F.count("*").alias("taken")))


def terminal_states(model: StateModel) -> DataFrame:
    """Each state with its exits, whether it can be reached, and what its flag says.

    ``is_dead_end``: no way out, but not flagged as terminal. The graph is small and checked
    to be so; the walk over it happens on the driver.
    """
    edges = bounded_rows(
        model.transition.select("in_state_id", "out_state_id").distinct(), 10 * LOOKUP_ROWS)
    after: dict[int, set[int]] = {}
    for source, target in edges:
        after.setdefault(source, set()).add(target)
    initial = model.initial_state_id
    reached = set() if initial is None else {initial}
    front = list(reached)
    while front:
        fresh = after.get(front.pop(), set()) - reached
        reached |= fresh
        front.extend(fresh)
    facts = F.broadcast(model.state.sparkSession.createDataFrame(
        [(s, len(after.get(s, ())), s in reached) for s in model.state_ids],
        "id bigint, exits bigint, is_reachable boolean"))
    return (model.state.select("id", "state_name", "is_terminal").join(facts, "id")
            .withColumn("has_no_exit", F.col("exits") == 0)
            .withColumn("is_dead_end", F.col("has_no_exit") & ~F.col("is_terminal"))
            .withColumn("flag_agrees", F.col("has_no_exit") == F.col("is_terminal")))


def audit_log(model: StateModel) -> DataFrame:
    """Rows of a finished log that the state machine could not have written: (log_id, reason).

    ``bad_creation``: a row without a signal that is not initial -> initial;
    ``no_transition``: no edge for (signal, state); ``wrong_target``: the edge leads elsewhere;
    ``chain_break``: the row does not start where the unit's previous row ended;
    ``first_row_not_creation``: the unit's first row has a signal.
    """
    initial = _initial_state(model)
    log = model.trail
    rows: Trail = log.on(log.rows.select(*log.group, log.tie, log.time, "initial_state_id",
                                         "final_state_id", "signal_id"))
    rows = rows.with_previous(previous_id="log_id", previous_state="final_state_id")
    edges = small(model.transition.select(
        "signal_id", F.col("in_state_id").alias("initial_state_id"), "out_state_id"))
    looked_up = rows.rows.join(edges, ["signal_id", "initial_state_id"], "left")
    creation, first = F.col("signal_id").isNull(), F.col("previous_id").isNull()

    def reason(condition, name):
        return F.when(condition, F.lit(name))

    reasons = F.filter(F.array(
        reason(creation & ((F.col("initial_state_id") != initial)
                           | (F.col("final_state_id") != initial)), "bad_creation"),
        reason(~creation & F.col("out_state_id").isNull(), "no_transition"),
        reason(~creation & (F.col("out_state_id") != F.col("final_state_id")), "wrong_target"),
        reason(~first & (F.col("previous_state") != F.col("initial_state_id")), "chain_break"),
        reason(first & ~creation, "first_row_not_creation"),
    ), lambda r: r.isNotNull())
    return looked_up.select("log_id", F.explode(reasons).alias("reason"))

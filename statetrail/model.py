"""The data model: states, signals, transitions, units and the log of transitions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .fixed_values import EDGES, SIGNALS, STATES
from .operators.lookup import LOOKUP_ROWS, bounded_rows, small
from .operators.trail import Trail, trail

STATE_SCHEMA = ("id bigint NOT NULL, state_name string NOT NULL, is_initial boolean NOT NULL, "
                "is_terminal boolean NOT NULL, details string NOT NULL")
SIGNAL_SCHEMA = "id bigint NOT NULL, signal_name string NOT NULL, details string NOT NULL"
TRANSITION_SCHEMA = ("signal_id bigint NOT NULL, in_state_id bigint NOT NULL, "
                     "out_state_id bigint NOT NULL, details string NOT NULL")
UNIT_SCHEMA = "id bigint NOT NULL, unit_name string NOT NULL, unit_details string NOT NULL"
LOG_SCHEMA = ("log_id bigint NOT NULL, unit_id bigint NOT NULL, "
              "initial_state_id bigint NOT NULL, final_state_id bigint NOT NULL, "
              "payload string, signal_id bigint, ts timestamp NOT NULL")
# the log as stored; its key is called ``log_id`` once it is loaded
STORED_LOG_SCHEMA = "id" + LOG_SCHEMA.removeprefix("log_id")
SIGNALS_IN_SCHEMA = ("event_id bigint, unit_id bigint, signal string, payload string, "
                     "ts timestamp")


@dataclass
class StateModel:
    """Five tables. ``log_trail`` is given by callers that have already ordered the log."""

    state: DataFrame
    signal: DataFrame
    transition: DataFrame
    unit: DataFrame
    log: DataFrame
    rows_per_task: int | None = None
    log_trail: Trail | None = None

    @cached_property
    def states(self) -> DataFrame:
        """(id, state_name), ready to join."""
        return small(self.state.select("id", "state_name"))

    @cached_property
    def signals(self) -> DataFrame:
        """(id, signal_name), ready to join."""
        return small(self.signal.select("id", "signal_name"))

    @cached_property
    def trail(self) -> Trail:
        """The log in time order per unit."""
        return self.log_trail or trail(self.log, rows_per_task=self.rows_per_task)

    def trail_of(self, *columns: str, where: Column | None = None) -> Trail:
        """The trail with only some columns of the log, and of rows that are selected by unit.

        Columns and rows are chosen before the log is ordered, so that units that have to be
        cut are stored without the rest.
        """
        needed = ["unit_id", "ts", "log_id", *columns]
        if self.log_trail is not None:
            kept = self.log_trail
            rows = kept.rows if where is None else kept.rows.filter(where)
            return kept.on(rows.select(*dict.fromkeys([*needed, *kept.group])))
        rows = self.log if where is None else self.log.filter(where)
        return trail(rows.select(*needed), rows_per_task=self.rows_per_task)

    @cached_property
    def initial_state_id(self) -> int | None:
        rows = bounded_rows(self.state.filter("is_initial").select(F.min("id").alias("id")))
        return rows[0]["id"]

    @cached_property
    def state_ids(self) -> list[int]:
        return sorted(row["id"] for row in bounded_rows(self.state.select("id")))

    @cached_property
    def moves(self) -> dict[int, dict[int, int]]:
        """Transition function as ``{state: {signal: next state}}``."""
        found: dict[int, dict[int, int]] = {}
        edges = self.transition.select("signal_id", "in_state_id", "out_state_id")
        for signal, before, after in bounded_rows(edges, 10 * LOOKUP_ROWS):
            found.setdefault(before, {})[signal] = after
        return found


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A few rows as a local relation, which Spark plans and reads without a job."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


def state_table(spark: SparkSession, states=STATES) -> DataFrame:
    return literal_table(
        spark, [(n, *state, "{}") for n, state in enumerate(states, 1)], STATE_SCHEMA)


def signal_table(spark: SparkSession, signals=SIGNALS) -> DataFrame:
    return literal_table(
        spark, [(n, name, "{}") for n, name in enumerate(signals, 1)], SIGNAL_SCHEMA)


def edge_table(spark: SparkSession, edges=EDGES) -> DataFrame:
    return literal_table(spark, list(edges), "signal string, in_state string, out_state string")


def seeded_dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, signal and transition tables of the repair workflow."""
    from .sources.tables import resolve_transitions

    state, signal = state_table(spark), signal_table(spark)
    edges, _, _ = resolve_transitions(edge_table(spark), state, signal)
    return state, signal, edges

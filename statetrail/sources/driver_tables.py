"""The test tables as a state log: users are units, their events are signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import (
    LOG_SCHEMA,
    TRANSITION_SCHEMA,
    StateModel,
    literal_table,
    signal_table,
    state_table,
)
from ..operators.trail import Trail, trail

# How event types are read as signals and where each signal leads.
STATES = [
    ("neutral", True, False),
    ("registered", False, False),
    ("assigned", False, False),
    ("start of service", False, False),
    ("end of service", False, False),
    ("parts missing", False, False),
]
# (event type, signal, id of the state it leads to); signal ids are the positions, from 1
SIGNALS = [
    ("signup", "customer call", 2),
    ("view", "assign", 3),
    ("click", "arrive", 4),
    ("purchase", "finished work ok", 5),
    ("error", "finished work failed", 6),
]
# the partial machine that raw events are run through; event types are its signals
RAW_STATES = [*STATES, ("reported", False, True)]
RAW_EDGES = [
    ("signup", "neutral", "registered"),
    ("view", "registered", "assigned"),
    ("click", "assigned", "start of service"),
    ("purchase", "start of service", "end of service"),
    ("error", "start of service", "parts missing"),
    ("view", "parts missing", "start of service"),
    ("click", "parts missing", "assigned"),
    ("signup", "end of service", "registered"),
    ("error", "end of service", "reported"),
]
NEUTRAL = 1


# given here, so that no footer is read just to plan
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("unit_name"),
        F.col("c_mktsegment").alias("unit_details"))


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as incoming signals."""
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("unit_id"), F.col("event_type").alias("signal"),
        F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("ts"))


def mapped_log(spark: SparkSession, sf_dir: str, rows_per_task: int | None = None) -> Trail:
    """Events as a finished log: the first one creates the unit, the others move it.

    The JSON is read once, before the shuffle, and goes through it as a small number.
    """
    rows = raw_signals(spark, sf_dir).select(
        "unit_id", "ts", "event_id", "signal",
        (F.get_json_object("payload", "$.k").cast("int") % 10).alias("k"))
    events = trail(rows, tie="event_id", rows_per_task=rows_per_task)
    ordered = events.with_rank("place").with_previous(last_signal="signal").rows

    def lookup(values, key):
        entries = [F.lit(v) for pair in values for v in pair]
        return F.create_map(*entries)[F.col(key)].cast("bigint")

    ids = [(event, n) for n, (event, _, _) in enumerate(SIGNALS, 1)]
    targets = [(event, state) for event, _, state in SIGNALS]
    neutral = F.lit(NEUTRAL).cast("bigint")
    payloads = F.array(F.lit("{}"), *[F.lit('{"tech": "T%d"}' % k) for k in range(1, 10)])
    mapped = ordered.select(
        *events.group, F.col("event_id").alias("log_id"), "ts",
        F.element_at(payloads, F.col("k") + 1).alias("payload"),
        F.when(F.col("place") > 1, lookup(ids, "signal")).alias("signal_id"),
        F.when(F.col("place") == 1, neutral).otherwise(lookup(targets, "signal"))
        .alias("final_state_id"),
        # a unit's second row starts where its creation has left it
        F.when(F.col("place") <= 2, neutral).otherwise(lookup(targets, "last_signal"))
        .alias("initial_state_id"))
    return Trail(mapped, "unit_id", "ts", "log_id", events.piece)


def mapped_model(spark: SparkSession, sf_dir: str,
                 rows_per_task: int | None = None) -> StateModel:
    """The mapped log as a model, next to the partial machine."""
    log = mapped_log(spark, sf_dir, rows_per_task)
    return StateModel(
        state_table(spark, STATES), signal_table(spark, [name for _, name, _ in SIGNALS]),
        raw_machine(spark)[2], customers(spark, sf_dir), log.rows, rows_per_task, log)


def raw_machine(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, signal and transition tables of the partial machine."""
    state = {name: n for n, (name, _, _) in enumerate(RAW_STATES, 1)}
    signal = {event: n for n, (event, _, _) in enumerate(SIGNALS, 1)}
    edges = literal_table(
        spark, [(signal[s], state[a], state[b], "{}") for s, a, b in RAW_EDGES], TRANSITION_SCHEMA)
    return state_table(spark, RAW_STATES), signal_table(spark, list(signal)), edges


def raw_model(spark: SparkSession, sf_dir: str, rows_per_task: int | None = None) -> StateModel:
    """The partial machine over the customers, nothing logged yet."""
    empty = literal_table(spark, [], LOG_SCHEMA)
    return StateModel(*raw_machine(spark), customers(spark, sf_dir), empty, rows_per_task)

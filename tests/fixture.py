"""The 16-unit scenario: 92 log rows, some of them moved back in time."""

from datetime import datetime, timedelta, timezone

from statetrail.fixed_values import EDGES, SIGNALS, STATES
from statetrail.model import (
    LOG_SCHEMA,
    SIGNALS_IN_SCHEMA,
    UNIT_SCHEMA,
    StateModel,
    seeded_dimensions,
)

UTC = timezone.utc
START = datetime(2025, 1, 10, 12, 0, 0, tzinfo=UTC)
AS_OF = datetime(2025, 1, 10, 13, 0, 0, tzinfo=UTC)

# The scenario's units, as (name, signals in order, technician, signals without
# a technician, days that the unit lies back).
UNITS = [
    ("Repair Job Alpha", ["customer call", "assign", "dispatch", "arrive", "finished work ok",
     "customer notification"], None, [], 0),
    ("Repair Job Beta", ["customer call", "assign", "dispatch", "arrive", "parts missing",
     "parts picked ok", "finished work failed", "time interval"], None, [], 0),
    ("Repair Job Gamma", ["customer call", "assign", "dispatch", "arrive", "parts missing"],
     "Mike Wilson", [], 3),
    ("Repair Job Delta", ["customer call", "assign"], "Lisa Chen", [], 0),
    ("Repair Job Epsilon", ["customer call", "assign", "dispatch", "arrive", "parts missing",
     "parts picked failed"], "James Rodriguez", ["customer call"], 0),
    ("Repair Job Zeta", ["customer call", "assign", "dispatch", "arrive", "finished work ok",
     "customer notification"], "Alex Kim", ["customer call", "customer notification"], 1),
    ("Repair Job Eta", ["customer call", "assign", "dispatch", "arrive", "finished work failed",
     "time interval"], "Maria Santos", ["customer call", "time interval"], 0),
    ("Repair Job Theta", ["customer call", "assign", "dispatch"], "Nina Patel",
     ["customer call"], 0),
    ("Repair Job Iota", ["customer call", "assign", "dispatch", "arrive"], "Oliver Chen",
     ["customer call"], 0),
    ("Repair Job Kappa", ["customer call", "assign", "dispatch", "arrive", "parts missing",
     "parts picked ok", "parts missing", "parts picked ok", "finished work ok",
     "customer notification"], "Rachel Green", ["customer call", "customer notification"], 5),
    ("Quick Job 1", ["customer call", "assign", "dispatch", "arrive", "finished work ok",
     "customer notification"], "Quick Tech", ["customer call", "customer notification"], 1),
    ("Quick Job 2", ["customer call", "assign", "dispatch", "arrive", "finished work failed"],
     "Quick Tech", ["customer call"], 2),
    ("Quick Job 3", ["customer call", "assign", "dispatch", "arrive", "finished work ok",
     "customer notification"], "Quick Tech", ["customer call", "customer notification"], 3),
    ("Incoming Job 1", ["customer call"], None, [], 0),
    ("Incoming Job 2", ["customer call"], None, [], 0),
    ("Incoming Job 3", ["customer call"], None, [], 0),
]
CALL_TAKER = {"Repair Job Gamma": "Sarah", "Repair Job Delta": "Reception"}


def log_rows(shifted=True):
    state = {name: n for n, (name, *_) in enumerate(STATES, 1)}
    signal = {name: n for n, name in enumerate(SIGNALS, 1)}
    edges = {(s, a): b for s, a, b in EDGES}
    rows, log_id = [], 0
    for unit_id, (name, signals, tech, without, back) in enumerate(UNITS, 1):
        here = "neutral"
        for name_of in [None, *signals]:
            log_id += 1
            ts = START + timedelta(seconds=log_id - 1)
            if shifted:
                ts -= timedelta(days=back)
                if name == "Repair Job Delta" and name_of == "assign":
                    ts -= timedelta(days=2)
            if name_of is None:
                rows.append((log_id, unit_id, 1, 1, "{}", None, ts))
                continue
            there = edges[name_of, here]
            who = CALL_TAKER.get(name) if name_of == "customer call" and name in CALL_TAKER else tech
            if name_of in without:
                who = None
            payload = '{"tech": "%s"}' % who if who else "{}"
            rows.append((log_id, unit_id, state[here], state[there], payload,
                         signal[name_of], ts))
            here = there
    return rows


def unit_table(spark):
    return spark.createDataFrame(
        [(n, u[0], "{}") for n, u in enumerate(UNITS, 1)], UNIT_SCHEMA)


def model(spark, rows=None, rows_per_task=None, unit=None):
    log = spark.createDataFrame(log_rows() if rows is None else rows, LOG_SCHEMA)
    return StateModel(*seeded_dimensions(spark), unit or unit_table(spark), log,
                      rows_per_task=rows_per_task)


def signals_in(spark):
    """The scenario's signals in script order, without the time shift."""
    rows = [(log_id, unit, SIGNALS[signal - 1], payload, ts)
            for log_id, unit, _, _, payload, signal, ts in log_rows(shifted=False) if signal]
    return spark.createDataFrame(rows, SIGNALS_IN_SCHEMA)


def rows_of(df, digits=6):
    """Rows as tuples; numbers rounded, times as UTC text."""
    def plain(value):
        if isinstance(value, float):
            return round(value, digits)
        if isinstance(value, datetime):
            return value.strftime("%Y-%m-%d %H:%M:%S.%f")
        return value

    return [tuple(plain(v) for v in row) for row in df.collect()]

"""The scenario's results, worked out by hand from the query texts."""

import fixture as fx
import pytest
import statetrail as st
from pyspark.sql import functions as F
from statetrail.fixed_values import EDGES


@pytest.fixture(scope="module", params=[None, 3], ids=["whole", "cut"])
def model(spark, request):
    """Once with every unit in one task, once with the units of four rows and more cut."""
    found = fx.model(spark, rows_per_task=request.param)
    assert (found.trail.piece is None) == (request.param is None)
    return found


def at(df):
    """Times as text, so that the Python time zone plays no part."""
    return df.select(*[F.date_format(c, "MM-dd HH:mm:ss").alias(c) if t == "timestamp"
                       else F.col(c) for c, t in df.dtypes])


def test_q1_current_units(model):
    rows = fx.rows_of(st.current_units(model).select("unit_name", "current_state", "technician"))
    assert rows == [
        ("Incoming Job 3", "registered", "Unassigned"),
        ("Incoming Job 2", "registered", "Unassigned"),
        ("Incoming Job 1", "registered", "Unassigned"),
        ("Repair Job Iota", "start of service", "Oliver Chen"),
        ("Repair Job Theta", "dispatched", "Nina Patel"),
        ("Repair Job Eta", "assigned", "Unassigned"),
        ("Repair Job Epsilon", "assigned", "James Rodriguez"),
        ("Repair Job Delta", "registered", "Reception"),
        ("Repair Job Beta", "assigned", "Unassigned"),
        ("Repair Job Alpha", "reported", "Unassigned"),
        ("Quick Job 1", "reported", "Unassigned"),
        ("Repair Job Zeta", "reported", "Unassigned"),
        ("Quick Job 2", "parts missing", "Quick Tech"),
        ("Quick Job 3", "reported", "Unassigned"),
        ("Repair Job Gamma", "parts missing", "Mike Wilson"),
        ("Repair Job Kappa", "reported", "Unassigned"),
    ]


BOARD = [
    ("James Rodriguez", "assigned", 1, 59.4833),
    ("Mike Wilson", "parts missing", 1, 4379.65),
    ("Nina Patel", "dispatched", 1, 59.1833),
    ("Oliver Chen", "start of service", 1, 59.1),
    ("Quick Tech", "parts missing", 1, 2938.7),
    ("Reception", "registered", 1, 59.6167),
    ("Unassigned", "assigned", 2, 59.5),
    ("Unassigned", "registered", 3, 58.5167),
    ("Unassigned", "reported", 5, 2939.1133),
]


def test_q2_technician_board(model):
    assert fx.rows_of(st.technician_board(model, as_of=fx.AS_OF), 4) == BOARD


def test_q3_sla_breaches(model):
    rows = fx.rows_of(st.sla_breaches(model, as_of=fx.AS_OF).select(
        "id", "unit_name", "state_name", "hours_in_state"), 4)
    assert rows == [(3, "Repair Job Gamma", "parts missing", 72.9942),
                    (12, "Quick Job 2", "parts missing", 48.9783)]


def test_q4_throughput(model):
    assert fx.rows_of(at(st.throughput(model, as_of=fx.AS_OF, days=7))) == [
        ("01-05 00:00:00", 1, 0, 10), ("01-07 00:00:00", 1, 0, 11),
        ("01-08 00:00:00", 0, 1, 6), ("01-09 00:00:00", 2, 0, 12),
        ("01-10 00:00:00", 1, 2, 37)]


def test_q5_heatmap(model):
    edges = {s: (a, b) for s, a, b in EDGES}
    rows = fx.rows_of(st.transition_heatmap(model))
    counts = {signal: n for _, signal, _, n in rows}
    assert counts == {
        "customer call": 16, "assign": 13, "dispatch": 12, "arrive": 11, "customer notification": 5,
        "finished work ok": 5, "parts missing": 5, "parts picked ok": 3, "finished work failed": 3,
        "time interval": 2, "parts picked failed": 1}
    assert all(edges[signal] == (a, b) for a, signal, b, _ in rows)
    assert [n for *_, n in rows] == sorted((n for *_, n in rows), reverse=True)
    assert fx.rows_of(st.heatmap_top(model)) == rows[:10]


def test_q6_unit_durations(model):
    gamma = fx.rows_of(at(st.unit_durations(model, 3, as_of=fx.AS_OF)))
    assert gamma == [
        ("neutral", "01-07 12:00:16", "01-07 12:00:17", 0.016667, False),
        ("neutral", "01-07 12:00:17", "01-07 12:00:18", 0.016667, False),
        ("registered", "01-07 12:00:18", "01-07 12:00:19", 0.016667, False),
        ("assigned", "01-07 12:00:19", "01-07 12:00:20", 0.016667, False),
        ("dispatched", "01-07 12:00:20", "01-07 12:00:21", 0.016667, False),
        ("start of service", "01-07 12:00:21", "01-10 13:00:00", 4379.65, True)]
    delta = fx.rows_of(at(st.unit_durations(model, 4, as_of=fx.AS_OF)), 4)
    assert delta == [
        ("registered", "01-08 12:00:24", "01-10 12:00:22", 2879.9667, False),
        ("neutral", "01-10 12:00:22", "01-10 12:00:23", 0.0167, False),
        ("neutral", "01-10 12:00:23", "01-10 13:00:00", 59.6167, True)]
    assert st.unit_durations(model, as_of=fx.AS_OF).count() == 92
    assert st.unit_durations(model, 99, as_of=fx.AS_OF).count() == 0


def test_q7_avg_state_durations(model):
    tick = 0.016667
    assert fx.rows_of(st.avg_state_durations(model)) == [
        ("registered", 222, 13, tick, 2879.966667), ("assigned", 0, 11, tick, tick),
        ("dispatched", 0, 10, tick, tick), ("neutral", 0, 28, tick, tick),
        ("parts missing", 0, 3, tick, tick), ("start of service", 0, 11, tick, tick)]
    assert fx.rows_of(st.avg_state_durations(model, label="final")) == [
        ("assigned", 222, 13, tick, 2879.966667), ("dispatched", 0, 11, tick, tick),
        ("end of service", 0, 5, tick, tick), ("neutral", 0, 16, tick, tick),
        ("parts missing", 0, 6, tick, tick), ("registered", 0, 12, tick, tick),
        ("start of service", 0, 13, tick, tick)]


# (events, units) by day and signal
DAYS = {
    "01-05": {"parts missing": (2, 1), "parts picked ok": (2, 1), "arrive": (1, 1),
              "assign": (1, 1), "customer call": (1, 1), "customer notification": (1, 1),
              "dispatch": (1, 1), "finished work ok": (1, 1)},
    "01-07": {"arrive": (2, 2), "assign": (2, 2), "customer call": (2, 2), "dispatch": (2, 2),
              "customer notification": (1, 1), "finished work ok": (1, 1), "parts missing": (1, 1)},
    "01-08": {"assign": (2, 2), "arrive": (1, 1), "customer call": (1, 1), "dispatch": (1, 1),
              "finished work failed": (1, 1)},
    "01-09": {"arrive": (2, 2), "assign": (2, 2), "customer call": (2, 2),
              "customer notification": (2, 2), "dispatch": (2, 2), "finished work ok": (2, 2)},
    "01-10": {"customer call": (10, 10), "assign": (6, 6), "dispatch": (6, 6), "arrive": (5, 5),
              "finished work failed": (2, 2), "parts missing": (2, 2), "time interval": (2, 2),
              "customer notification": (1, 1), "finished work ok": (1, 1), "parts picked failed": (1, 1),
              "parts picked ok": (1, 1)},
}


def test_q8_daily_activity(model):
    expected = set()
    for day, signals in DAYS.items():
        expected.update((f"{day} 00:00:00", signal, *counts) for signal, counts in signals.items())
    rows = fx.rows_of(at(st.daily_activity(model, as_of=fx.AS_OF)))
    assert len(rows) == len(expected) and set(rows) == expected
    rollup = st.daily_rollup(model, as_of=fx.AS_OF).collect()
    assert [r["total"] for r in rollup] == [10, 11, 6, 12, 37]
    assert rollup[2]["signals"] == {"assign": 2, "arrive": 1, "customer call": 1, "dispatch": 1,
                                    "finished work failed": 1}


def test_q9_state_distribution(model):
    assert fx.rows_of(st.state_distribution(model)) == [
        ("reported", 5, 31.25), ("registered", 4, 25.0), ("assigned", 3, 18.75),
        ("parts missing", 2, 12.5), ("dispatched", 1, 6.25), ("start of service", 1, 6.25)]
    assert st.state_distribution(model, top=2).count() == 2


WORKERS = [
    ("Quick Tech", 3, 2, 1, 12, 0.02, "01-07 12:01:21", "01-09 12:01:11", 3),
    ("Alex Kim", 1, 1, 0, 4, 0.02, "01-09 12:00:34", "01-09 12:00:37", 1),
    ("Rachel Green", 1, 1, 0, 8, 0.02, "01-05 12:00:57", "01-05 12:01:04", 1),
    ("James Rodriguez", 1, 0, 0, 5, 0.02, "01-10 12:00:27", "01-10 12:00:31", 1),
    ("Lisa Chen", 1, 0, 0, 1, None, "01-08 12:00:24", "01-08 12:00:24", 1),
    ("Maria Santos", 1, 0, 1, 4, 0.02, "01-10 12:00:41", "01-10 12:00:44", 1),
    ("Mike Wilson", 1, 0, 0, 4, 0.02, "01-07 12:00:18", "01-07 12:00:21", 1),
    ("Nina Patel", 1, 0, 0, 2, 0.02, "01-10 12:00:48", "01-10 12:00:49", 1),
    ("Oliver Chen", 1, 0, 0, 3, 0.02, "01-10 12:00:52", "01-10 12:00:54", 1),
    ("Reception", 1, 0, 0, 1, 0.02, "01-10 12:00:23", "01-10 12:00:23", 1),
    ("Sarah", 1, 0, 0, 1, 0.02, "01-07 12:00:17", "01-07 12:00:17", 1),
]


def test_q10_worker_performance(model):
    assert fx.rows_of(at(st.worker_performance(model))) == [row[:-1] for row in WORKERS]


@pytest.mark.parametrize("expected", [WORKERS[0], WORKERS[4]], ids=lambda row: row[0])
def test_q16_worker_detail(model, expected):
    assert fx.rows_of(at(st.worker_detail(model, expected[0]))) == [expected[1:]]


def test_q16_unknown_worker(model):
    assert fx.rows_of(st.worker_detail(model, "nobody")) == [(0, 0, 0, 0, None, None, None, 0)]


def test_q13_workers_list(model):
    assert [r[0] for r in st.workers_list(model).collect()] == sorted(w[0] for w in WORKERS)


def test_q11_hourly_activity(model):
    rows = [("01-05 12:00:00", 11, 1, 2), ("01-07 12:00:00", 13, 2, 4),
            ("01-08 12:00:00", 7, 2, 3), ("01-09 12:00:00", 14, 2, 3),
            ("01-10 12:00:00", 47, 10, 6)]
    assert fx.rows_of(at(st.hourly_activity(model, as_of=fx.AS_OF, hours=None))) == rows
    assert fx.rows_of(at(st.hourly_activity(model, as_of=fx.AS_OF))) == rows[-1:]
    labels = st.hourly_labels(model, as_of=fx.AS_OF).collect()
    assert [r["label"] for r in labels] == ["12:00"]


def test_q12_bottlenecks(model):
    assert fx.rows_of(st.bottlenecks(model, as_of=fx.AS_OF)) == [
        ("parts missing", 2, 60.98625, 72.994167), ("reported", 5, 48.985222, 120.981944),
        ("assigned", 3, 0.991574, 0.995833), ("dispatched", 1, 0.986389, 0.986389),
        ("start of service", 1, 0.985, 0.985), ("registered", 4, 0.979861, 0.993611)]
    bands = st.bottleneck_bands(model, as_of=fx.AS_OF, top=5).collect()
    assert [r["band"] for r in bands] == ["error", "error", "", "", ""]


def test_q14_worker_units(model):
    def names(worker):
        return [r["unit_name"] for r in st.worker_units(model, worker, as_of=fx.AS_OF).collect()]

    assert names("Quick Tech") == ["Quick Job 2"]
    assert names("Mike Wilson") == ["Repair Job Gamma"]
    assert names("Alex Kim") == []


def test_q15_worker_history(model):
    rows = st.worker_history(model, "Quick Tech", as_of=fx.AS_OF).collect()
    assert len(rows) == 12
    assert [r["timestamp"] for r in rows] == sorted((r["timestamp"] for r in rows), reverse=True)
    assert st.worker_history(model, "Quick Tech", as_of=fx.AS_OF, limit=5).count() == 5
    classes = {(r["signal_name"], r["history_class"]) for r in
               st.history_classes(model, "Quick Tech", as_of=fx.AS_OF).collect()}
    assert ("finished work ok", "success") in classes
    assert ("finished work failed", "error") in classes and ("assign", "") in classes


def test_q17_technician_workload(model):
    assert fx.rows_of(st.technician_workload(model)) == [row[:3] for row in BOARD[:6]]


def test_m2_replays_the_scenario(spark, model):
    empty = fx.model(spark, rows=[])
    log, rejected = st.apply_signals(empty, fx.signals_in(spark),
                                     rows_per_task=model.rows_per_task)
    expected = [(i, u, a, b, p, s) for i, u, a, b, p, s, _ in fx.log_rows(False) if s]
    found = fx.rows_of(log.drop("ts").orderBy("log_id"))
    assert found == expected and len(found) == 76
    assert rejected.count() == 0


def test_m5_terminal_states(model):
    rows = st.terminal_states(model).collect()
    assert [r["state_name"] for r in rows if r["has_no_exit"]] == ["reported"]
    assert all(r["flag_agrees"] and r["is_reachable"] and not r["is_dead_end"] for r in rows)


def test_m6_audit_log(model):
    assert sorted(fx.rows_of(st.audit_log(model))) == [
        (23, "chain_break"), (25, "first_row_not_creation")]


def test_c1_success_rates(model):
    rows = {r["technician"]: r for r in st.success_rates(model).collect()}
    assert (rows["Quick Tech"]["success_rate"], rows["Quick Tech"]["band"]) == (17, "error")
    assert rows["Rachel Green"]["success_rate"] == 13  # 12.5 is rounded up
    assert rows["Lisa Chen"]["avg_response_time_minutes"] == 0


def test_c3_pivots(model):
    rows = {r["technician"]: r for r in st.technician_pivot(model, as_of=fx.AS_OF).collect()}
    assert rows["Unassigned"]["total_tasks"] == 10
    assert rows["Unassigned"]["states"]["assigned"]["cnt"] == 2
    assert round(rows["Unassigned"]["states"]["registered"]["avg_time"], 4) == 58.5167
    wide = {r["technician"]: r for r in st.technician_columns(
        model, ["assigned", "reported"], as_of=fx.AS_OF).collect()}
    assert (wide["Unassigned"]["assigned"], wide["Unassigned"]["reported"]) == (2, 5)
    assert wide["Nina Patel"]["reported"] == 0


def test_c5_process_board(model):
    rows = st.process_board(model, as_of=fx.AS_OF).collect()
    assert [r["unit_name"] for r in rows[:4]] == [
        "Repair Job Gamma", "Quick Job 2", "Repair Job Kappa", "Quick Job 3"]
    first = rows[0]
    assert (first["unit_class"], first["state_slug"]) == ("error", "parts-missing")
    # 4379.65 minutes: the hours are rounded, not cut
    assert (first["minutes_in_state"], first["time_in_state"]) == (4380, "73h 0m")
    assert rows[-1]["time_in_state"] == "58m"
    assert {r["unit_class"] for r in rows if r["current_state"] == "reported"} == {"success"}


def test_c7_lifecycle(model):
    rows = at(st.lifecycle_progress(model)).filter("unit_name = 'Repair Job Iota'").orderBy(
        "position").collect()
    assert [r["status"] for r in rows] == ["completed"] * 4 + ["current"] + [""] * 3
    assert rows[4]["estimated_at"] == rows[4]["reached_at"] == "01-10 12:00:54"
    assert rows[3]["estimated_at"] == "01-10 10:00:54"
    assert rows[0]["reached_at"] == "01-10 12:00:50" and rows[5]["reached_at"] is None
    assert st.lifecycle_progress(model).count() == 16 * 8
    reached = st.first_reached(model).filter("unit_id = 10").count()
    assert reached == 8


def test_c11_open_flag(model):
    rows = st.timeline_flags(model, 3, as_of=fx.AS_OF).collect()
    assert [r["stay_class"] for r in rows] == ["success"] * 5 + ["current"]
    assert rows[-1]["minutes"] == 4380

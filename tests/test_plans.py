"""What the physical plans must look like on stored tables."""

import re

import fixture as fx
import pytest
import statetrail as st
from statetrail.sources import append_log, load_model, validate_model


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    model = fx.model(spark)
    for name, table in (("state", model.state), ("signal", model.signal),
                        ("transition", model.transition), ("sm_unit", model.unit),
                        ("sm_log", model.log)):
        if name == "sm_log":
            append_log(table, f"{path}/{name}")
        else:
            table.write.parquet(f"{path}/{name}")
    return load_model(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_reads(text):
    return [line for line in text.splitlines() if "FileScan" in line and "sm_log" in line]


def shuffles(text):
    kinds = r"hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition"
    return re.findall(f"Exchange ({kinds})", text)


@pytest.mark.parametrize("query", [
    st.transition_heatmap, st.avg_state_durations, st.bottlenecks, st.state_distribution,
    st.sla_breaches, st.throughput, st.daily_activity, st.audit_log, st.unit_durations])
def test_payload_is_not_read_where_it_is_not_used(stored, query):
    reads = log_reads(plan(query(stored)))
    assert reads and not any("payload" in line for line in reads)


@pytest.mark.parametrize("query", [
    st.current_units, st.technician_board, st.bottlenecks, st.sla_breaches])
def test_latest_rows_are_cut_before_the_shuffle(stored, query):
    text = plan(query(stored))
    assert re.search(r"WindowGroupLimit .* Partial", text) and len(log_reads(text)) == 1


@pytest.mark.parametrize("query", [
    lambda m: st.state_intervals(m.trail), lambda m: st.unit_durations(m, as_of=fx.AS_OF),
    st.audit_log, lambda m: m.trail.with_earlier_time("earlier").rows,
    lambda m: m.trail.with_previous(a="ts").with_next(b="ts").with_rank("c").rows])
def test_one_shuffle_serves_all_windows_of_a_unit(stored, query):
    text = plan(query(stored))
    assert [s.split("#")[0] for s in shuffles(text)] == ["hashpartitioning(unit_id"]
    assert len(log_reads(text)) == 1 and text.count("Sort [") == 1


@pytest.mark.parametrize("query", [
    st.transition_heatmap, st.throughput, st.worker_performance,
    lambda m: st.worker_history(m, "a")])
def test_dimensions_are_broadcast(stored, query):
    text = plan(query(stored))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_time_range_reaches_the_files(stored):
    for query in (st.throughput(stored, as_of=fx.AS_OF),
                  st.hourly_activity(stored, as_of=fx.AS_OF),
                  st.worker_history(stored, "a", as_of=fx.AS_OF)):
        read = log_reads(plan(query))[0]
        assert "GreaterThanOrEqual(ts" in read and re.search(r"PartitionFilters: \[[^]]*day", read)


def test_unit_filter_passes_the_window(stored):
    assert "EqualTo(unit_id,3)" in log_reads(plan(st.unit_durations(stored, 3)))[0]
    assert "In(unit_id, [3,4])" in log_reads(plan(st.unit_status(stored, [3, 4])))[0]


def test_technician_filter_stays_above_the_previous_event(stored):
    """The units of the worker are chosen below the window, the worker's own rows above."""
    lines = plan(st.worker_detail(stored, "a")).splitlines()
    window = next(n for n, line in enumerate(lines) if "Window [max(ts" in line)
    wanted = [n for n, line in enumerate(lines) if "Filter" in line and "= a)" in line]
    semi = [n for n, line in enumerate(lines) if "LeftSemi" in line]
    assert min(wanted) < window < min(semi) and max(wanted) > window


def test_hourly_activity_shuffles_the_log_once(stored):
    text = plan(st.hourly_activity(stored, hours=None))
    assert "Expand" not in text
    assert len([s for s in shuffles(text) if s.startswith("hashpartitioning") and "unit_id" in s]) == 1


def test_new_units_are_ranked_without_a_single_task(spark):
    new = spark.createDataFrame([(n, f"u{n}", "{}") for n in range(50)],
                                "seq bigint, unit_name string, unit_details string")
    units, log = st.create_units(fx.model(spark), new, as_of=fx.AS_OF)
    assert not any("SinglePartition" in s for df in (units, log) for s in shuffles(plan(df)))


def test_pieces_hold_only_what_is_asked_for(spark):
    cut = fx.model(spark, rows_per_task=3).trail_of("initial_state_id")
    assert cut.piece and sorted(cut.rows.columns) == [
        "initial_state_id", "log_id", "piece", "ts", "unit_id"]


def test_the_integrity_report_reads_the_log_three_times(stored):
    assert len(log_reads(plan(validate_model(stored)))) == 3


def test_history_keeps_only_the_wanted_rows_per_task(stored):
    assert "TakeOrderedAndProject(limit=100" in plan(st.worker_history(stored, "a"))


@pytest.mark.parametrize("sound", [False, True])
def test_history_names_units_above_the_limit(stored, sound):
    lines = plan(st.worker_history(stored, "a", sound_units=sound)).splitlines()
    cut = next(n for n, line in enumerate(lines) if "TakeOrderedAndProject(limit=100" in line)
    reads = [line for line in lines if "FileScan" in line and "sm_unit" in line]
    above = [line for line in lines[:cut] if "FileScan" in line and "sm_unit" in line]
    semi = [n for n, line in enumerate(lines) if "LeftSemi" in line]
    named = [line for line in reads if "unit_name" in line]
    assert len(named) == 1 and len(reads) == (1 if sound else 2) and named == above
    assert (not semi) if sound else min(semi) > cut


def test_cut_units_share_the_shuffle_too(spark):
    model = fx.model(spark, rows_per_task=3)
    text = plan(st.state_intervals(model.trail))
    assert all(s.startswith(("hashpartitioning(unit_id", "SinglePartition"))
               for s in shuffles(text))

"""Every registered query against DuckDB on the smallest test tables."""

import sys
from pathlib import Path

import pytest
from checks import compare, oracle, registered

SF_DIR = "/root/testdata/sf0.001"
# T3 holds no unit there, so Q14 has nothing to return
EMPTY = {"q14_worker_units"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(registered.queries())


@pytest.mark.parametrize("name", registered.queries())
def test_whole(spark, duck, name):
    found = compare.difference(spark, duck, SF_DIR, name)
    assert found == ("no rows" if name in EMPTY else "")


CUT = [n for n in registered.queries()
       if n.startswith(("q06", "q07", "q10", "q16", "v1", "w4", "m1", "m2", "m6", "c11", "t4"))
       or n in ("q01_current_units", "q05_transition_heatmap", "w1_latest")]


@pytest.mark.parametrize("name", CUT)
def test_cut(spark, duck, monkeypatch, name):
    """The same with every unit of more than 20 rows cut into pieces."""
    monkeypatch.setattr(sys.modules["statetrail.operators.trail"], "ROWS_PER_TASK", 20)
    assert compare.difference(spark, duck, SF_DIR, name) == ""


# What rows are ordered by; a minus stands for descending.
ORDERS = {
    "q01_current_units": ["-state_since", "-unit_id"],
    "q02_technician_board": ["technician", "state"],
    "q03_sla_breaches": ["-hours_in_state", "id"],
    "q05_transition_heatmap": ["-cnt", "from_state", "signal_name", "to_state"],
    "q08_daily_activity": ["day", "-activity_count", "signal_name"],
    "c05_process_board": ["-is_error", "state_since", "unit_id"],
}


@pytest.mark.parametrize("name", ORDERS)
def test_order(spark, duck, name):
    """The rows come in the order in which DuckDB sorts its own."""
    df = registered.queries()[name](spark, SF_DIR)
    keys = [(k.lstrip("-"), k.startswith("-")) for k in ORDERS[name]]
    by = ", ".join(f"{k} DESC" if down else k for k, down in keys)
    columns = ", ".join(k for k, _ in keys)
    theirs = duck.execute(f"SELECT {columns} FROM ({oracle.oracle_sql()[name]}) ORDER BY {by}").fetchall()
    assert [tuple(row[k] for k, _ in keys) for row in df.collect()] == theirs

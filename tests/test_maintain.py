"""Changes written back to a stored log touch their days only, and can be repeated."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from statetrail.model import LOG_SCHEMA
from statetrail.sources import append_log, fold_purged, maintain, mark_purged, read_live_log, read_log, rewrite_log

T0 = datetime(2025, 1, 1, 12, tzinfo=timezone.utc)


@pytest.fixture
def stored(spark, tmp_path):
    """Ten days of three units; unit 3 is alone on the last day."""
    rows = [(10 * day + unit, unit, 1, 2, None, 1, T0 + timedelta(days=day))
            for day in range(10) for unit in (1, 2)] + [(999, 3, 1, 2, None, 1, T0 + timedelta(days=10))]
    path = f"{tmp_path}/log"
    append_log(spark.createDataFrame(rows, LOG_SCHEMA), path)
    return path


def days(spark, path):
    return {r.log_id: r.day.day for r in read_log(spark, path).collect()}


def files(path):
    from pathlib import Path
    return {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in Path(path).glob("day=*")}


def back(n):
    return {"ts": F.col("ts") - F.expr(f"INTERVAL {n} DAYS")}


def test_only_touched_days_are_written(spark, stored):
    before, expected = files(stored), days(spark, stored)
    rewrite_log(spark, stored, F.col("log_id") == 52, back(2), "one")
    assert days(spark, stored) == expected | {52: 4}
    after = files(stored)
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {"day=2025-01-04", "day=2025-01-06"}


def test_a_day_that_loses_all_rows_goes_and_new_days_come(spark, stored):
    rewrite_log(spark, stored, F.col("unit_id") == 3, back(-5), "away")
    assert days(spark, stored)[999] == 16 and "day=2025-01-11" not in files(stored)


def test_a_change_counts_once(spark, stored):
    for _ in range(2):
        rewrite_log(spark, stored, F.col("log_id") == 52, back(1), "once")
    assert days(spark, stored)[52] == 5
    rewrite_log(spark, stored, F.col("log_id") == 52, back(1), "twice")
    assert days(spark, stored)[52] == 4


@pytest.mark.parametrize("where", ["staging", "placing", "marking"])
def test_a_failed_run_can_be_repeated(spark, stored, monkeypatch, where):
    expected = days(spark, stored) | {52: 4}

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if where == "staging":
            patch.setattr(maintain, "_finish", fail)
        elif where == "placing":
            patch.setattr(maintain, "stored_log", fail)
        else:
            patch.setattr(maintain, "DONE", "day=2025-01-01/\0")  # no file can have this name
        with pytest.raises(Exception):
            rewrite_log(spark, stored, F.col("log_id") == 52, back(2), "again")
    rewrite_log(spark, stored, F.col("log_id") == 52, back(2), "again")
    assert days(spark, stored) == expected


def test_nothing_to_change_and_a_null_condition(spark, stored):
    before = files(stored)
    rewrite_log(spark, stored, F.col("log_id") == -1, back(2), "none")
    rewrite_log(spark, stored, F.lit(None).cast("boolean"), back(2), "null")
    assert files(stored) == before


def test_purged_units_are_left_out_and_folded_in(spark, stored):
    before = files(stored)
    assert read_live_log(spark, stored).count() == 21
    ids = spark.createDataFrame([(3,), (3,), (None,), (77,)], "unit_id long")
    mark_purged(ids, stored)
    assert files(stored) == before and read_live_log(spark, stored).count() == 20
    assert read_log(spark, stored).count() == 21
    fold_purged(spark, stored)
    after = files(stored)
    assert read_log(spark, stored).count() == read_live_log(spark, stored).count() == 20
    assert before.keys() - after.keys() == {"day=2025-01-11"}
    assert all(before[d] == after[d] for d in after)
    fold_purged(spark, stored)
    mark_purged(ids.withColumn("unit_id", F.lit(1).cast("long")), stored)
    assert read_live_log(spark, stored).filter("unit_id = 1").count() == 0

"""Reading, writing and maintaining the model tables."""

import json

import fixture as fx
import pytest
import statetrail as st
from pyspark.sql import functions as F
from statetrail.model import StateModel, edge_table, signal_table, state_table
from statetrail.sources import (
    append_log,
    deletable,
    load_model,
    purge_units,
    read_log,
    resolve_transitions,
    to_json_rows,
    update_where,
    upsert_missing,
    validate_model,
    write_json,
)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_load_model(spark, tmp_path, fmt):
    model = fx.model(spark)
    for name, table in (("state", model.state), ("signal", model.signal),
                        ("transition", model.transition), ("sm_unit", model.unit),
                        ("sm_log", model.log.withColumnRenamed("log_id", "id"))):
        writer = table.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.save(f"{tmp_path}/{name}")
    loaded = load_model(spark, str(tmp_path), fmt)
    assert sorted(loaded.log.collect()) == sorted(model.log.collect())
    assert fx.rows_of(st.current_units(loaded)) == fx.rows_of(st.current_units(model))


def test_json_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [json.loads(r[0]) for r in to_json_rows(df).collect()] == [
        {"a": 1, "b": None}, {"a": 2, "b": "x"}]
    write_json(df, f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.schema("a int, b string").json(f"{tmp_path}/out")
                      .collect())) == [(1, None), (2, "x")]


def test_log_is_appended_by_day_and_pruned(spark, tmp_path):
    log, path = fx.model(spark).log, f"{tmp_path}/log"
    append_log(log.filter("unit_id <= 8"), path)
    append_log(log.filter("unit_id > 8"), path)
    stored = read_log(spark, path)
    assert stored.count() == 92
    one_day = stored.filter("day = DATE '2025-01-08'")
    assert one_day.count() == 7
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    timed = stored.filter(F.col("ts") >= F.lit("2025-01-09 00:00:00+00:00").cast("timestamp"))
    assert "GreaterThanOrEqual(ts" in timed._jdf.queryExecution().executedPlan().toString()


def test_model_with_a_log_by_day(spark, tmp_path):
    model = fx.model(spark)
    for name in ("state", "signal", "transition"):
        getattr(model, name).write.parquet(f"{tmp_path}/{name}")
    model.unit.write.parquet(f"{tmp_path}/sm_unit")
    append_log(model.log, f"{tmp_path}/sm_log")
    loaded = load_model(spark, str(tmp_path))
    for query in (st.current_units, st.worker_performance, st.audit_log):
        assert sorted(map(str, query(loaded).collect())) == sorted(
            map(str, query(model).collect()))
    for query in (st.throughput, st.daily_activity, st.hourly_activity):
        assert query(loaded, as_of=fx.AS_OF).collect() == query(model, as_of=fx.AS_OF).collect()


def test_upsert_missing(spark):
    target = spark.createDataFrame([("a", 1)], "name string, v int")
    rows = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), ("c", None)],
                                 "name string, v int")
    expected = [("a", 1), ("b", 2), ("c", None)]
    once = upsert_missing(target, rows, ["name"])
    assert sorted(map(tuple, once.collect())) == expected
    assert sorted(map(tuple, upsert_missing(once, rows, ["name"]).collect())) == expected
    names = upsert_missing(target.select("name"), rows.select("name"), ["name"])
    assert sorted(r[0] for r in names.collect()) == ["a", "b", "c"]


def test_update_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    out = update_where(df, F.col("s") == "a", {"n": F.col("n") * 10})
    assert sorted(map(tuple, out.collect())) == [(2, None), (10, "a")]


def test_resolve_transitions(spark):
    edges = edge_table(spark, [("assign", "registered", "assigned"),
                               ("assign", "registered", "assigned"),
                               ("unheard of", "registered", "assigned"),
                               ("assign", "nowhere", "assigned")])
    known, unknown, conflicts = resolve_transitions(edges, state_table(spark), signal_table(spark))
    assert conflicts.collect() == []
    assert sorted(map(tuple, known.collect())) == [(2, 2, 3, "{}")]
    assert sorted(map(tuple, unknown.collect())) == [
        ("assign", "nowhere", "assigned"), ("unheard of", "registered", "assigned")]


def test_purge_and_restrict(spark):
    model = fx.model(spark)
    unit, log = purge_units(model.unit, model.log,
                            spark.createDataFrame([(1,), (2,), (99,)], "unit_id bigint"))
    assert (unit.count(), log.count()) == (14, 92 - 16)
    free = deletable(model.state, [(model.transition, "in_state_id"),
                                   (model.transition, "out_state_id"),
                                   (model.log, "initial_state_id")])
    assert free.count() == 0
    unused = deletable(model.signal, [(log.filter("signal_id <= 3"), "signal_id")])
    assert sorted(r["id"] for r in unused.collect()) == list(range(4, 12))


def test_sound_model_has_no_findings(spark):
    assert validate_model(fx.model(spark)).count() == 0


def test_each_broken_rule_is_found(spark):
    good = fx.model(spark)
    twice = good.log.unionByName(good.log.filter("log_id = 5"))
    log = twice.withColumn("signal_id", F.when(F.col("log_id") == 7, 77)
                           .otherwise(F.col("signal_id")))
    states = [("neutral", True, False), ("registered", True, False), ("registered", False, False)]
    nulls = good.unit.unionByName(spark.createDataFrame(
        [(50, None, "{}")], "id bigint, unit_name string, unit_details string"))
    bad = StateModel(state_table(spark, states), good.signal, good.transition,
                     nulls.filter("id <> 16"), log)
    found = {(r["check"], r["table"], r["key"]): r["n"] for r in validate_model(bad).collect()}
    assert found[("unique", "log", "5")] == 2
    assert found[("unique", "state", "registered")] == 2
    assert found[("single_initial", "state", "is_initial")] == 2
    assert found[("foreign_key", "log", "signal_id=77")] == 1
    assert found[("foreign_key", "log", "unit_id=16")] == 2
    assert found[("foreign_key", "transition", "in_state_id=5")] == 3  # three signals leave it
    assert found[("not_null", "unit", "unit_name")] == 1
    none = StateModel(state_table(spark, [("a", False, False)]), *[
        getattr(good, n) for n in ("signal", "transition", "unit", "log")])
    assert validate_model(none).filter("check = 'single_initial'").first()["n"] == 0

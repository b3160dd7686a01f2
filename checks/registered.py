"""Every query over the test tables, in the form the comparison with DuckDB needs.

Times leave as TIMESTAMP_NTZ. Minutes are rounded to 8 digits and hours to 10: with whole
microseconds these have no ties, so both engines round the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import statetrail as st
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from statetrail.functions import technician, technician_id_or_name
from statetrail.model import LOG_SCHEMA, StateModel, signal_table, state_table
from statetrail.operators import latest_per_unit
from statetrail.session import configure, shared_dir
from statetrail.sources import (
    append_log,
    deletable,
    fold_purged,
    load_model,
    mark_purged,
    purge_units,
    read_live_log,
    read_log,
    resolve_transitions,
    rewrite_log,
    to_json_rows,
    update_where,
    upsert_missing,
    validate_model,
)
from statetrail.sources.driver_tables import (
    SIGNALS,
    STATES,
    customers,
    mapped_log,
    mapped_model,
    raw_model,
    raw_signals,
    read_table,
)
from statetrail.streaming import (
    OUTCOME_SCHEMA,
    apply_signals_stream,
    current_state_stream,
    hourly_activity_stream,
    hourly_partials_stream,
    last_updates,
    replay_batches,
    run_available,
    sla_alerts_stream,
    throughput_stream,
)

AS_OF = "2024-01-31 00:00:00"
WORKER = "T3"
UNIT = 3
CUT_ROWS = 40
SLA_HOURS = 6
LOG_COLUMNS = ["log_id", "unit_id", "initial_state_id", "final_state_id", "payload",
               "signal_id", "ts"]

Query = Callable[[SparkSession, str], DataFrame]


def session(spark: SparkSession) -> SparkSession:
    """Runtime settings; a local session gets a partition per core instead of Spark's 200."""
    configure(spark)
    context = spark.sparkContext
    if context.master.startswith("local"):
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", min(now, context.defaultParallelism))
    return spark


def plain(df: DataFrame, digits: int = 8) -> DataFrame:
    """Times without zone, fractions rounded."""
    return df.select(*[
        F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp"
        else F.round(name, digits).alias(name) if kind == "double"
        else F.col(name)
        for name, kind in df.dtypes])


def mapped(query: Callable[[StateModel], DataFrame], digits: int = 8) -> Query:
    return lambda spark, sf_dir: plain(query(mapped_model(session(spark), sf_dir)), digits)


def raw(query: Callable[[StateModel, DataFrame], DataFrame]) -> Query:
    def run(spark, sf_dir):
        model = raw_model(session(spark), sf_dir)
        return plain(query(model, raw_signals(spark, sf_dir)))

    return run


def moved_back(model: StateModel) -> StateModel:
    """The log with all failures moved back by two days, out of their order."""
    failed = F.col("final_state_id") == 6
    log = update_where(model.log, failed, {"ts": F.col("ts") - F.expr("INTERVAL 2 DAYS")})
    return StateModel(model.state, model.signal, model.transition, model.unit,
                      log.select(*LOG_COLUMNS), model.rows_per_task)


# Where a query is about building blocks only, it is spelled out here.

def latest(model):
    return latest_per_unit(model.log).select(*LOG_COLUMNS)


def previous_event(model):
    return model.trail.with_earlier_time("earlier").rows.select("log_id", "ts", "earlier")


def pivoted(model):
    return (st.technician_pivot(model, as_of=AS_OF)
            .select("technician", "total_tasks", F.explode("states").alias("state", "_v"))
            .select("technician", "total_tasks", "state", "_v.cnt",
                    F.col("_v.avg_time").alias("avg_time")))


def rolled_up(model):
    return st.daily_rollup(model, days=None).select(
        "day", "total", F.explode("signals").alias("signal_name", "n"))


def zero_filled(model):
    named = model.signals.withColumnRenamed("id", "signal_id")
    done = (model.log.join(named, "signal_id").groupBy("unit_id")
            .agg(F.count_if(F.col("signal_name") == "finished work ok").alias("ok_jobs")))
    units = model.unit.select(F.col("id").alias("unit_id"))
    return st.zero_defaults(units.join(done, "unit_id", "left"), "ok_jobs")


def created_units(spark, sf_dir):
    """Every order becomes a unit, behind the units and log rows there are."""
    model = mapped_model(session(spark), sf_dir)
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("unit_name"),
        F.col("o_orderpriority").alias("unit_details"))
    units, log = st.create_units(model, orders, as_of=AS_OF)
    return plain(units.join(log, units["id"] == log["unit_id"]).drop("id"))


def terminal(spark, sf_dir):
    """Terminal states of the graph that the replayed events show."""
    model = raw_model(session(spark), sf_dir)
    log, _ = st.apply_signals(model, raw_signals(spark, sf_dir))
    seen = StateModel(model.state, model.signal, st.observed_transitions(log), model.unit, log)
    return st.terminal_states(seen)


def resolved(model):
    """The edges of the log, by name, turned into ids."""
    edges = st.transition_heatmap(model).select(
        F.col("signal_name").alias("signal"), F.col("from_state").alias("in_state"),
        F.col("to_state").alias("out_state"))
    known, _, _ = resolve_transitions(edges, model.state, model.signal)
    return known.select("signal_id", "in_state_id", "out_state_id")


def planted_edges(model):
    """All edges of the log, and behind them the same signals and states leading back."""
    taken = st.transition_heatmap(model).select(
        F.col("signal_name").alias("signal"), F.col("from_state").alias("in_state"),
        F.col("to_state").alias("out_state"))
    back = taken.select("signal", "in_state", F.col("in_state").alias("out_state"))
    return taken.withColumn("seq", F.lit(1)).unionByName(back.withColumn("seq", F.lit(2)))


def resolved_in_order(model):
    known, _, _ = resolve_transitions(planted_edges(model), model.state, model.signal, "seq")
    return known.select("signal_id", "in_state_id", "out_state_id")


def conflicting(model):
    _, _, conflicts = resolve_transitions(planted_edges(model), model.state, model.signal, "seq")
    return conflicts


def cut(query):
    """The same query with every unit of more than CUT_ROWS rows cut into pieces."""
    def run(spark, sf_dir):
        session(spark)
        model = mapped_model(spark, sf_dir)
        some = StateModel(model.state, model.signal, model.transition, model.unit,
                          model.log.select(*LOG_COLUMNS), CUT_ROWS)
        return plain(query(some))

    return run


def cut_signals(spark, sf_dir):
    """Raw signals replayed piece by piece."""
    model = raw_model(session(spark), sf_dir)
    return plain(st.apply_signals(model, raw_signals(spark, sf_dir), rows_per_task=CUT_ROWS)[0])


def payload_fields(spark, sf_dir):
    """Technician by id or name, and the last of duplicate keys, in payloads made from events."""
    session(spark)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.concat(F.lit("T"), k.cast("string"))
    payload = F.concat(
        F.lit('{"tech": "old", "tech": "'), name, F.lit('", "technician_id": "'),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("I"), k.cast("string"))), F.lit('"}'))
    return read_table(spark, sf_dir, "events").select("event_id", payload.alias("payload")).select(
        "event_id", technician(last_duplicate=True).alias("last_tech"), technician().alias("first_tech"),
        technician_id_or_name().alias("id_or_name"))


def upserted(spark, sf_dir):
    """Customers without events are added to those that have some."""
    units = customers(session(spark), sf_dir)
    active = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return upsert_missing(units.join(active, "id", "left_semi"),
                          units.withColumn("unit_details", F.lit("NEW")), ["id"])


def integrity(spark, sf_dir):
    """The log against the suppliers as units, and a state table with two initial states."""
    model = mapped_model(session(spark), sf_dir)
    units = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("unit_name"),
        F.lit("{}").alias("unit_details"))
    states = [(name, first or name == "registered", last) for name, first, last in STATES]
    return validate_model(StateModel(
        state_table(spark, states), signal_table(spark, [name for _, name, _ in SIGNALS]),
        model.transition.filter("out_state_id <= 6"), units, model.log))


def purged(model):
    done = st.units_now(model).filter("current_state = 'end of service'").select("unit_id")
    return purge_units(model.unit, model.log, done)[1].select("log_id", "unit_id", "ts")


def json_rows(model):
    return to_json_rows(st.units_now(model).select(
        "unit_id", "unit_name", "current_state", "technician"))


def unused_customers(model):
    return deletable(model.unit, [(model.log, "unit_id")])


def wide_board(model):
    return st.technician_columns(model, [name for name, _, _ in STATES], as_of=AS_OF)


def appended(spark, sf_dir):
    """The log written by day and read back."""
    path, _, _ = folders(session(spark))
    append_log(mapped_log(spark, sf_dir).rows.select(*LOG_COLUMNS), path)
    return plain(read_log(spark, path))


def rewritten(spark, sf_dir):
    """All failures moved back by two days in the stored log; it is read back."""
    path, _, _ = folders(session(spark))
    append_log(mapped_log(spark, sf_dir).rows.select(*LOG_COLUMNS), path)
    rewrite_log(spark, path, F.col("final_state_id") == 6,
                {"ts": F.col("ts") - F.expr("INTERVAL 2 DAYS")}, "failures")
    return plain(read_log(spark, path).select("log_id", "unit_id", "ts", technician().alias("technician")))


def purged_by_mark(fold: bool) -> Query:
    """Finished units are marked as purged; with ``fold`` their rows are taken out of the files too."""
    def run(spark, sf_dir):
        path, _, _ = folders(session(spark))
        model = mapped_model(spark, sf_dir)
        append_log(model.log.select(*LOG_COLUMNS), path)
        mark_purged(st.units_now(model).filter("current_state = 'end of service'"), path)
        if fold:
            fold_purged(spark, path)
        log = read_log(spark, path) if fold else read_live_log(spark, path)
        return plain(log.select("log_id", "unit_id", "ts"))

    return run


def loaded(spark, sf_dir):
    """Where every unit is, from stored tables; the log is laid out by day."""
    path, _, _ = folders(session(spark))
    model = mapped_model(spark, sf_dir)
    for name, table in (("state", model.state), ("signal", model.signal),
                        ("transition", model.transition), ("sm_unit", model.unit)):
        table.write.parquet(f"{path}/{name}")
    append_log(model.log.select(*LOG_COLUMNS), f"{path}/sm_log")
    return plain(st.current_units(load_model(spark, path)))


def status(model):
    """Asked for every customer, most of which have no log."""
    return st.unit_status(model, model.unit.select(F.col("id").alias("unit_id")))


# Streams read files, so the mapped log is written to the shared folder first.

def folders(spark):
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def log_stream(spark, sf_dir, path):
    mapped_log(spark, sf_dir).rows.select(*LOG_COLUMNS).write.parquet(path)
    return spark.readStream.schema(LOG_SCHEMA).parquet(path)


def streamed(job, keys, mode="update", finish=lambda df: df) -> Query:
    def run(spark, sf_dir):
        session(spark)
        source, out, checkpoint = folders(spark)
        model = mapped_model(spark, sf_dir)
        stream = job(log_stream(spark, sf_dir, source), model)
        run_available(stream, out, checkpoint, mode)
        return plain(finish(last_updates(spark, out, stream.schema, keys)))

    return run


def signal_stream(spark, sf_dir, **limits):
    schema = read_table(spark, sf_dir, "events").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .options(**limits).parquet(sf_dir)
            .select("event_id", F.col("user_id").alias("unit_id"),
                    F.col("event_type").alias("signal"), F.col("props").alias("payload"),
                    F.col("ts").cast("timestamp").alias("ts")))


def accepted(rows):
    return plain(rows.filter("outcome = 'accepted'").select(
        F.col("event_id").alias("log_id"), "unit_id", "initial_state_id", "final_state_id",
        "payload", "signal_id", "ts"))


def streamed_signals(spark, sf_dir):
    """Keyed state; the limit per trigger bounds the rows of a unit that a task sorts.

    Files are taken in the order they were written. Where that is not the order of time,
    ``replayed_signals`` is the job to use.
    """
    session(spark)
    _, out, checkpoint = folders(spark)
    stream = apply_signals_stream(signal_stream(spark, sf_dir, maxBytesPerTrigger=1 << 30),
                                  raw_model(spark, sf_dir))
    run_available(stream, out, checkpoint, "append")
    return accepted(last_updates(spark, out, stream.schema))


def ordered_signals(spark, sf_dir):
    """Signals wait for the watermark, so the order of files does not matter."""
    session(spark)
    _, out, checkpoint = folders(spark)
    stream = apply_signals_stream(signal_stream(spark, sf_dir), raw_model(spark, sf_dir), "10 minutes")
    run_available(stream, out, checkpoint, "append")
    return accepted(last_updates(spark, out, stream.schema))


def replayed_signals(spark, sf_dir):
    """All files at once; large units are replayed in pieces."""
    session(spark)
    _, out, checkpoint = folders(spark)
    replay_batches(signal_stream(spark, sf_dir), raw_model(spark, sf_dir), out, checkpoint,
                   availableNow=True).awaitTermination()
    return accepted(last_updates(spark, f"{out}/outcomes", OUTCOME_SCHEMA))


def queries() -> dict[str, Query]:
    return {
        "q01_current_units": mapped(st.current_units),
        "q02_technician_board": mapped(lambda m: st.technician_board(m, as_of=AS_OF)),
        "q03_sla_breaches": mapped(
            lambda m: st.sla_breaches(m, as_of=AS_OF, hours=SLA_HOURS), 10),
        "q04_throughput": mapped(lambda m: st.throughput(m, as_of=AS_OF)),
        "q05_transition_heatmap": mapped(st.transition_heatmap),
        "q06_unit_durations": mapped(lambda m: st.unit_durations(m, as_of=AS_OF).drop("is_open")),
        "q06_one_unit": mapped(lambda m: st.unit_durations(m, UNIT, as_of=AS_OF).drop("is_open")),
        "q07_avg_state_durations": mapped(st.avg_state_durations),
        "q07_avg_final": mapped(lambda m: st.avg_state_durations(m, label="final")),
        "q08_daily_activity": mapped(lambda m: st.daily_activity(m, days=None)),
        "q08_week": mapped(lambda m: st.daily_activity(m, as_of=AS_OF)),
        "q09_state_distribution": mapped(st.state_distribution),
        "q10_worker_performance": mapped(st.worker_performance),
        "q11_hourly_activity": mapped(lambda m: st.hourly_activity(m, hours=None)),
        "q11_day": mapped(lambda m: st.hourly_activity(m, as_of=AS_OF)),
        "q12_bottlenecks": mapped(lambda m: st.bottlenecks(m, as_of=AS_OF), 10),
        "q13_workers_list": mapped(st.workers_list),
        "q14_worker_units": mapped(lambda m: st.worker_units(m, WORKER, as_of=AS_OF)),
        "q15_worker_history": mapped(lambda m: st.worker_history(m, WORKER, as_of=AS_OF)),
        "q15_sound_units": mapped(lambda m: st.worker_history(m, WORKER, as_of=AS_OF, sound_units=True)),
        "q16_worker_detail": mapped(lambda m: st.worker_detail(m, WORKER)),
        "q17_technician_workload": mapped(st.technician_workload),
        "v1_intervals_initial": mapped(lambda m: st.state_intervals(m.trail)),
        "v1_intervals_final": mapped(lambda m: st.state_intervals(m.trail, "final")),
        "w1_latest": mapped(latest),
        "w3_share": mapped(lambda m: st.state_distribution(m).select("state_name", "percentage")),
        "w4_prev_event": mapped(previous_event),
        "c01_success_rate": mapped(lambda m: st.success_rates(m).select(
            "technician", "success_rate", "band", "avg_response_time_minutes")),
        "c02_bottleneck_bands": mapped(
            lambda m: st.bottleneck_bands(m, as_of=AS_OF, top=5), 10),
        "c03_technician_pivot": mapped(pivoted),
        "c03_technician_columns": mapped(wide_board),
        "c04_unit_classes": mapped(lambda m: st.unit_classes(m).select(
            "unit_id", "current_state", "unit_class")),
        "c05_process_board": mapped(lambda m: st.process_board(m, as_of=AS_OF)),
        "c06_history_classes": mapped(lambda m: st.history_classes(m, WORKER, as_of=AS_OF)),
        "c07_lifecycle": mapped(st.lifecycle_progress),
        "c08_daily_rollup": mapped(rolled_up),
        "c09_heatmap_top": mapped(st.heatmap_top),
        "c10_zero_defaults": mapped(zero_filled),
        "c11_open_flag": mapped(lambda m: st.timeline_flags(m, as_of=AS_OF)),
        "x14_hour_labels": mapped(lambda m: st.hourly_labels(m, hours=None)),
        "w4_cut": cut(previous_event),
        "v1_cut": cut(lambda m: st.state_intervals(m.trail)),
        "q07_cut": cut(st.avg_state_durations),
        "m6_cut": cut(lambda m: st.audit_log(moved_back(m))),
        "m2_cut": cut_signals,
        "x11_payload_fields": payload_fields,
        "m1_create_units": created_units,
        "m2_apply_signals": raw(lambda m, s: st.apply_signals(m, s)[0]),
        "m2_rejected": raw(lambda m, s: st.apply_signals(m, s)[1]),
        "m4_unit_status": mapped(status),
        "m5_terminal_states": terminal,
        "m6_audit_log": mapped(lambda m: st.audit_log(moved_back(m))),
        "l1_load_model": loaded,
        "l2_json_rows": mapped(json_rows),
        "l3_upsert_missing": upserted,
        "l4_resolve_transitions": mapped(resolved),
        "l4_first_edge_wins": mapped(resolved_in_order),
        "l4_conflicts": mapped(conflicting),
        "l5_append_log": appended,
        "l6_shift_time": mapped(lambda m: moved_back(m).log.select(
            "log_id", "unit_id", "ts", technician().alias("technician"))),
        "l6_rewritten_days": rewritten,
        "l7_integrity": integrity,
        "l8_purge_units": mapped(purged),
        "l8_marked": purged_by_mark(fold=False),
        "l8_folded": purged_by_mark(fold=True),
        "l8_deletable": mapped(unused_customers),
        "t1_current_state": streamed(lambda log, m: current_state_stream(log), ["unit_id"]),
        "t2_throughput": streamed(throughput_stream, ["day"]),
        "t3_hourly_activity": streamed(
            lambda log, m: hourly_partials_stream(log), ["hour", "unit_id", "technician"],
            finish=st.hourly_from_partials),
        "t3_hourly_final": streamed(lambda log, m: hourly_activity_stream(log), None, "append"),
        "t4_apply_signals": streamed_signals,
        "t4_in_time_order": ordered_signals,
        "t4_replay_batches": replayed_signals,
        "t5_sla_alerts": streamed(
            lambda log, m: sla_alerts_stream(log, m, hours=SLA_HOURS), None, "append"),
    }

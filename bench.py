"""Time the queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The events are mapped to a log once,
which is stored and loaded as a user would load it, so that the times are those of the
queries. All queries run twice, from building the plan to the last row on the driver: ``first``
compiles code, ``queries`` is the second pass. Streams, loading and all queries that bring their
own tables are timed as they are registered.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import statetrail as st  # noqa: E402
from checks import registered  # noqa: E402
from statetrail.session import build_session  # noqa: E402
from statetrail.sources import append_log, load_model  # noqa: E402

AS_OF, WORKER, UNIT = registered.AS_OF, registered.WORKER, registered.UNIT

ON_STORED = {
    "q01_current_units": st.current_units,
    "q02_technician_board": lambda m: st.technician_board(m, as_of=AS_OF),
    "q03_sla_breaches": lambda m: st.sla_breaches(m, as_of=AS_OF, hours=6),
    "q04_throughput": lambda m: st.throughput(m, as_of=AS_OF),
    "q05_transition_heatmap": st.transition_heatmap,
    "q06_unit_durations": lambda m: st.unit_durations(m, as_of=AS_OF),
    "q06_one_unit": lambda m: st.unit_durations(m, UNIT, as_of=AS_OF),
    "q07_avg_state_durations": st.avg_state_durations,
    "q08_daily_activity": lambda m: st.daily_activity(m, days=None),
    "q08_week": lambda m: st.daily_activity(m, as_of=AS_OF),
    "q09_state_distribution": st.state_distribution,
    "q10_worker_performance": st.worker_performance,
    "q11_hourly_activity": lambda m: st.hourly_activity(m, hours=None),
    "q11_day": lambda m: st.hourly_activity(m, as_of=AS_OF),
    "q12_bottlenecks": lambda m: st.bottlenecks(m, as_of=AS_OF),
    "q13_workers_list": st.workers_list,
    "q14_worker_units": lambda m: st.worker_units(m, WORKER, as_of=AS_OF),
    "q15_worker_history": lambda m: st.worker_history(m, WORKER, as_of=AS_OF),
    "q16_worker_detail": lambda m: st.worker_detail(m, WORKER),
    "q17_technician_workload": st.technician_workload,
    "v1_intervals": lambda m: st.state_intervals(m.trail),
    "w4_prev_event": lambda m: m.trail.with_earlier_time("earlier").rows,
    "c05_process_board": lambda m: st.process_board(m, as_of=AS_OF),
    "c07_lifecycle": st.lifecycle_progress,
    "m4_unit_status": registered.status,
    "m6_audit_log": st.audit_log,
}
AS_REGISTERED = """m1_create_units m2_apply_signals m5_terminal_states l1_load_model l3_upsert_missing
l4_resolve_transitions l5_append_log l7_integrity l8_purge_units t1_current_state t2_throughput
t3_hourly_activity t3_hourly_final t4_apply_signals t4_in_time_order t4_replay_batches t5_sla_alerts
l6_rewritten_days l8_marked l8_folded""".split()

SETTINGS = {
    "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_driver_memory": "8g",
    "spark_sql_codegen_cache_maxEntries": "1000",
    # a laptop-sized table still uses all cores
    "spark_sql_adaptive_coalescePartitions_minPartitionSize": "128k"}


def stored_model(spark, sf_dir: str) -> st.StateModel:
    path, _, _ = registered.folders(spark)
    model = registered.mapped_model(registered.session(spark), sf_dir)
    for name, table in (("state", model.state), ("signal", model.signal),
                        ("transition", model.transition), ("sm_unit", model.unit)):
        table.write.parquet(f"{path}/{name}")
    append_log(model.log.select(*registered.LOG_COLUMNS), f"{path}/sm_log")
    return load_model(spark, path)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, **SETTINGS)
    spark.sparkContext.setLogLevel("ERROR")
    listed, passes = registered.queries(), []
    start = time.perf_counter()
    model = stored_model(spark, sf_dir)
    prepared = round(time.perf_counter() - start, 3)
    jobs = {name: lambda q=query: q(model).collect() for name, query in ON_STORED.items()}
    jobs |= {name: lambda n=name: listed[n](spark, sf_dir).collect() for name in AS_REGISTERED}
    for _ in range(2):
        times = {}
        for name, job in jobs.items():
            start = time.perf_counter()
            job()
            times[name] = round(time.perf_counter() - start, 3)
        passes.append(times)
    spark.stop()
    first, second = passes
    print(json.dumps({"metric": "second_pass_total", "value": round(sum(second.values()), 3), "unit": "sec",
                      "queries": second, "first": first, "prepared": prepared,
                      "settings": {k.replace("_", "."): v for k, v in SETTINGS.items()},
                      "cpus": int(cpus), "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()

"""The same queries for DuckDB, written from what they mean rather than from the Spark plans."""

from __future__ import annotations

from statetrail.fixed_values import LIFECYCLE
from statetrail.sources.driver_tables import RAW_EDGES, RAW_STATES, SIGNALS, STATES

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
WORKER = "T3"


def _values(rows) -> str:
    def text(v):
        if isinstance(v, bool):
            return str(v).lower()
        return f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'"

    return "VALUES " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


DIMENSIONS = f"""
st(id, state_name) AS ({_values([(n, s[0]) for n, s in enumerate(STATES, 1)])}),
sig(event_type, id, signal_name, leads_to) AS ({_values(
    [(event, n, name, to) for n, (event, name, to) in enumerate(SIGNALS, 1)])})"""

LOG = f"""WITH {DIMENSIONS},
numbered AS (
  SELECT event_id AS log_id, user_id AS unit_id, ts, event_type,
         CAST(props ->> '$.k' AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
stepped AS (
  SELECT n.*, CASE WHEN rn = 1 THEN 1 ELSE s.leads_to END AS final_state_id,
         CASE WHEN rn = 1 THEN NULL ELSE s.id END AS signal_id
  FROM numbered n JOIN sig s USING (event_type)),
log AS (
  SELECT log_id, unit_id, CAST(coalesce(
           lag(final_state_id) OVER (PARTITION BY unit_id ORDER BY ts, log_id), 1) AS BIGINT)
           AS initial_state_id,
         CAST(final_state_id AS BIGINT) AS final_state_id,
         CASE WHEN k % 10 = 0 THEN '{{}}'
              ELSE concat('{{"tech": "T', CAST(k % 10 AS VARCHAR), '"}}') END AS payload,
         CASE WHEN k % 10 = 0 THEN NULL ELSE concat('T', CAST(k % 10 AS VARCHAR)) END AS tech,
         signal_id, ts
  FROM stepped),
unit AS (SELECT c_custkey AS id, c_name AS unit_name, c_mktsegment AS details FROM customer),
latest AS (
  SELECT l.*, s.state_name, epoch_us({NOW}) - epoch_us(ts) AS age
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ts DESC, log_id DESC) AS pos
        FROM log) l JOIN st s ON s.id = l.final_state_id
  WHERE pos = 1),
stays AS (
  SELECT log_id, unit_id, initial_state_id, final_state_id, ts AS entered_at,
         lead(ts) OVER (PARTITION BY unit_id ORDER BY ts, log_id) AS left_at
  FROM log),
earlier AS (
  SELECT a.log_id, max(b.ts) AS earlier
  FROM log a LEFT JOIN log b ON b.unit_id = a.unit_id AND b.ts < a.ts
  GROUP BY a.log_id),
actions AS (
  SELECT l.*, g.signal_name, epoch_us(l.ts) - epoch_us(e.earlier) AS response
  FROM log l JOIN sig g ON g.id = l.signal_id JOIN earlier e USING (log_id)
  WHERE tech IS NOT NULL),
heat AS (
  SELECT a.state_name AS from_state, g.signal_name, b.state_name AS to_state, count(*) AS cnt
  FROM log l JOIN st a ON a.id = l.initial_state_id JOIN st b ON b.id = l.final_state_id
  JOIN sig g ON g.id = l.signal_id GROUP BY ALL),
current_units AS (
  SELECT u.id AS unit_id, u.unit_name, l.state_name AS current_state, l.ts AS state_since,
         u.details, coalesce(l.tech, 'Unassigned') AS technician
  FROM unit u JOIN latest l ON l.unit_id = u.id),
board AS (
  SELECT coalesce(tech, 'Unassigned') AS technician, state_name AS state, count(*) AS cnt,
         round(CAST(sum(age) AS DOUBLE) / (count(*) * 60000000.0::DOUBLE), 8)
           AS avg_time_in_state_minutes
  FROM latest GROUP BY ALL),
daily AS (
  SELECT date_trunc('day', ts) AS day, signal_name, count(*) AS activity_count,
         count(DISTINCT unit_id) AS unique_units
  FROM log JOIN sig ON sig.id = log.signal_id GROUP BY ALL),
hourly AS (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS activity_count,
         count(DISTINCT unit_id) AS unique_units,
         count(DISTINCT coalesce(tech, 'Unassigned')) AS active_technicians
  FROM log GROUP BY ALL),
jobs AS (
  SELECT date_trunc('day', ts) AS day,
         count(*) FILTER (WHERE signal_name = 'finished work ok') AS ok_jobs,
         count(*) FILTER (WHERE signal_name = 'finished work failed') AS failed_jobs,
         count(*) AS total_transitions
  FROM log JOIN sig ON sig.id = log.signal_id
  WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-02-01 00:00:00'
  GROUP BY ALL),
shares AS (
  SELECT s.state_name, count(*) AS unit_count,
         CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS percentage
  FROM unit u JOIN latest s ON s.unit_id = u.id GROUP BY s.state_name),
waits AS (
  SELECT state_name, count(*) AS units_currently_in_state,
         round(CAST(sum(age) AS DOUBLE) / (count(*) * 3600000000.0::DOUBLE), 10)
           AS avg_hours_in_state,
         round(max(age) / 3600000000.0::DOUBLE, 10) AS max_hours_in_state
  FROM latest GROUP BY ALL),
history AS (
  SELECT l.unit_id, u.unit_name, a.state_name AS from_state, b.state_name AS to_state,
         g.signal_name, l.ts AS timestamp
  FROM log l JOIN unit u ON u.id = l.unit_id JOIN st a ON a.id = l.initial_state_id
  JOIN st b ON b.id = l.final_state_id JOIN sig g ON g.id = l.signal_id
  WHERE l.tech = '{WORKER}' AND l.ts >= {NOW} - INTERVAL 30 DAY
  ORDER BY l.ts DESC, l.log_id DESC LIMIT 100)
"""

MEASURES = """
count(DISTINCT unit_id) AS total_units_handled,
count(*) FILTER (WHERE signal_name = 'finished work ok') AS successful_completions,
count(*) FILTER (WHERE signal_name = 'finished work failed') AS failed_completions,
count(*) AS total_actions,
round(CAST(sum(response) AS DOUBLE) / (count(response) * 60000000.0::DOUBLE), 2)
  AS avg_response_time_minutes,
min(ts) AS first_activity, max(ts) AS last_activity"""


def durations(state: str) -> str:
    length = "(epoch_us(left_at) - epoch_us(entered_at))"
    return LOG + f"""
SELECT state_name,
       CAST(round(CAST(sum({length}) AS DOUBLE) / (count(*) * 60000000.0::DOUBLE)) AS BIGINT)
         AS avg_minutes,
       count(*) AS total_transitions,
       round(min({length}) / 60000000.0::DOUBLE, 8) AS min_minutes,
       round(max({length}) / 60000000.0::DOUBLE, 8) AS max_minutes
FROM stays JOIN st ON st.id = {state}
WHERE left_at IS NOT NULL GROUP BY state_name"""


def timeline(extra: str = "") -> str:
    minutes = f"""(epoch_us(coalesce(left_at, {NOW})) - epoch_us(entered_at))
      / 60000000.0::DOUBLE"""
    return LOG + f"""
SELECT unit_id, state_name, entered_at, coalesce(left_at, {NOW}) AS left_at,
       round({minutes}, 8) AS minutes_spent {extra.format(minutes=minutes)}
FROM stays JOIN st ON st.id = initial_state_id"""


RATE = "CAST(floor(successful_completions / total_actions * 100 + 0.5) AS BIGINT)"
BAND = "CASE WHEN {0} > {1} THEN '{2}' WHEN {3} THEN '{4}' ELSE '' END"
MINUTES_NOW = "CAST(floor(age / 60000000.0::DOUBLE + 0.5) AS BIGINT)"

# Raw events through the partial machine, one recursion step per event of a unit.
REPLAY = f"""WITH RECURSIVE
st(id, state_name, is_initial, is_terminal) AS ({_values(
    [(n, *s) for n, s in enumerate(RAW_STATES, 1)])}),
sig(signal, id) AS ({_values([(e, n) for n, (e, _, _) in enumerate(SIGNALS, 1)])}),
names(signal, in_state, out_state) AS ({_values(RAW_EDGES)}),
edge AS (
  SELECT n.signal, g.id AS signal_id, a.id AS in_state, b.id AS out_state
  FROM names n JOIN sig g USING (signal) JOIN st a ON a.state_name = n.in_state
  JOIN st b ON b.state_name = n.out_state),
ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT e.user_id, e.rn, CAST(1 AS BIGINT) AS before, x.out_state AS after,
         coalesce(x.out_state, 1) AS here
  FROM ev e LEFT JOIN edge x ON x.signal = e.event_type AND x.in_state = 1
  WHERE e.rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, w.here, x.out_state, coalesce(x.out_state, w.here)
  FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.rn = w.rn + 1
  LEFT JOIN edge x ON x.signal = e.event_type AND x.in_state = w.here),
moved AS (
  SELECT e.event_id, e.user_id AS unit_id, w.before, w.after, e.props, e.event_type,
         g.id AS signal_id, e.ts
  FROM walk w JOIN ev e USING (user_id, rn) JOIN sig g ON g.signal = e.event_type)
"""

ACCEPTED = REPLAY + """
SELECT event_id AS log_id, unit_id, before AS initial_state_id, after AS final_state_id,
       props AS payload, signal_id, ts
FROM moved WHERE after IS NOT NULL"""

SHIFTED = LOG + """,
shifted AS (
  SELECT log_id, unit_id, initial_state_id, final_state_id, tech, signal_id,
         CASE WHEN final_state_id = 6 THEN ts - INTERVAL 2 DAY ELSE ts END AS ts
  FROM log)
"""

CURRENT = "SELECT unit_id, unit_name, current_state, state_since, details, technician"


def oracle_sql() -> dict[str, str]:
    found = _plain_sql()
    for name, same in (CUT_AS | WRITTEN_AS).items():
        found[name] = found[same]
    return found


#: Queries over cut units give the rows of the plain ones.
CUT_AS = {"w4_cut": "w4_prev_event", "v1_cut": "v1_intervals_initial", "m2_cut": "m2_apply_signals",
          "q07_cut": "q07_avg_state_durations", "m6_cut": "m6_audit_log"}
#: Changes that are written back to a stored log give the rows of those that are not.
WRITTEN_AS = {"l6_rewritten_days": "l6_shift_time", "l8_marked": "l8_purge_units", "l8_folded": "l8_purge_units"}


def _plain_sql() -> dict[str, str]:
    raw_edges = _values([
        (next(n for n, (e, _, _) in enumerate(SIGNALS, 1) if e == s),
         [x[0] for x in RAW_STATES].index(a) + 1, [x[0] for x in RAW_STATES].index(b) + 1)
        for s, a, b in RAW_EDGES])
    error = ("contains(current_state, 'missing') OR contains(current_state, 'failed') "
             "OR contains(current_state, 'error')")
    unit_class = (f"CASE WHEN {error} THEN 'error' WHEN current_state IN "
                  "('reported', 'end of service') THEN 'success' ELSE '' END")
    steps = "VALUES " + ", ".join(
        f"({n}, '{name}', '{label}')" for n, (name, label) in enumerate(LIFECYCLE, 1))
    return {
        "q01_current_units": LOG + CURRENT + " FROM current_units",
        "q02_technician_board": LOG + "SELECT * FROM board",
        "q03_sla_breaches": LOG + """
SELECT u.id, u.unit_name, l.state_name, l.ts AS entered_at,
       round(age / 3600000000.0::DOUBLE, 10) AS hours_in_state
FROM latest l JOIN unit u ON u.id = l.unit_id
WHERE state_name IN ('parts missing', 'assigned') AND age > 6 * 3600000000""",
        "q04_throughput": LOG + "SELECT * FROM jobs",
        "q05_transition_heatmap": LOG + "SELECT * FROM heat",
        "q06_unit_durations": timeline(),
        "q07_avg_state_durations": durations("initial_state_id"),
        "q07_avg_final": durations("final_state_id"),
        "q06_one_unit": LOG + f"""
SELECT state_name, entered_at, coalesce(left_at, {NOW}) AS left_at,
       round((epoch_us(coalesce(left_at, {NOW})) - epoch_us(entered_at)) / 60000000.0::DOUBLE, 8)
         AS minutes_spent
FROM stays JOIN st ON st.id = initial_state_id WHERE unit_id = 3""",
        "q08_week": LOG + """
SELECT * FROM daily WHERE day >= DATE '2024-01-25' AND day < DATE '2024-02-01'""",
        "q11_day": LOG + """
SELECT * FROM hourly
WHERE hour >= TIMESTAMP '2024-01-30 00:00:00' AND hour < TIMESTAMP '2024-01-31 00:00:00'""",
        "q08_daily_activity": LOG + "SELECT * FROM daily",
        "q09_state_distribution": LOG + "SELECT * FROM shares",
        "q10_worker_performance": LOG + f"""
SELECT tech AS technician, {MEASURES} FROM actions GROUP BY tech""",
        "q11_hourly_activity": LOG + "SELECT * FROM hourly",
        "q12_bottlenecks": LOG + "SELECT * FROM waits",
        "q13_workers_list": LOG + """
SELECT DISTINCT tech AS technician FROM log WHERE tech IS NOT NULL""",
        "q14_worker_units": LOG + f"""
SELECT u.id AS unit_id, u.unit_name, l.state_name AS current_state, l.ts AS state_since,
       u.details, round(age / 60000000.0::DOUBLE, 8) AS minutes_in_state
FROM latest l JOIN unit u ON u.id = l.unit_id WHERE l.tech = '{WORKER}'""",
        "q15_worker_history": LOG + "SELECT * FROM history",
        "q15_sound_units": LOG + "SELECT * FROM history",
        "q16_worker_detail": LOG + f"""
SELECT {MEASURES}, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM actions WHERE tech = '{WORKER}'""",
        "q17_technician_workload": LOG + """
SELECT tech AS technician, state_name, count(*) AS workload
FROM latest WHERE tech IS NOT NULL GROUP BY ALL""",
        "v1_intervals_initial": LOG + """
SELECT unit_id, initial_state_id AS state_id, entered_at, left_at FROM stays""",
        "v1_intervals_final": LOG + """
SELECT unit_id, final_state_id AS state_id, entered_at, left_at FROM stays""",
        "w1_latest": LOG + """
SELECT log_id, unit_id, initial_state_id, final_state_id, payload, signal_id, ts FROM log
WHERE (unit_id, ts) IN (SELECT (unit_id, max(ts)) FROM log GROUP BY unit_id)""",
        "w3_share": LOG + "SELECT state_name, percentage FROM shares",
        "w4_prev_event": LOG + """
SELECT log_id, ts, earlier FROM log JOIN earlier USING (log_id)""",
        "c01_success_rate": LOG + f""",
m AS (SELECT tech AS technician, {MEASURES} FROM actions GROUP BY tech)
SELECT technician, {RATE} AS success_rate,
       {BAND.format(RATE, 80, 'success', RATE + ' < 60', 'error')} AS band,
       coalesce(avg_response_time_minutes, 0) AS avg_response_time_minutes
FROM m""",
        "c02_bottleneck_bands": LOG + f"""
SELECT *, {BAND.format('avg_hours_in_state', 24, 'error', 'avg_hours_in_state > 8', 'warning')}
         AS band
FROM waits ORDER BY avg_hours_in_state DESC, state_name LIMIT 5""",
        "c03_technician_pivot": LOG + """
SELECT technician, CAST(sum(cnt) OVER (PARTITION BY technician) AS BIGINT) AS total_tasks,
       state, cnt, avg_time_in_state_minutes AS avg_time
FROM board""",
        "c03_technician_columns": LOG + "SELECT technician, " + ", ".join(
            f"""CAST(coalesce(sum(cnt) FILTER (WHERE state = '{name}'), 0) AS BIGINT) AS "{name}\""""
            for name, _, _ in STATES) + " FROM board GROUP BY technician",
        "c04_unit_classes": LOG + f"""
SELECT unit_id, current_state, {unit_class} AS unit_class FROM current_units""",
        "c05_process_board": LOG + f""",
aged AS (SELECT c.*, {MINUTES_NOW} AS m FROM current_units c JOIN latest USING (unit_id))
{CURRENT}, {unit_class} AS unit_class,
       contains(current_state, 'missing') OR contains(current_state, 'failed') AS is_error,
       m AS minutes_in_state,
       CASE WHEN m > 60 THEN concat(CAST(floor(m / 60 + 0.5) AS BIGINT), 'h ', m % 60, 'm')
            ELSE concat(m, 'm') END AS time_in_state,
       regexp_replace(current_state, '\\s+', '-', 'g') AS state_slug
FROM aged""",
        "c06_history_classes": LOG + """
SELECT *, CASE signal_name WHEN 'finished work ok' THEN 'success'
               WHEN 'finished work failed' THEN 'error' ELSE '' END AS history_class
FROM history""",
        "c07_lifecycle": LOG + f""",
step(position, state_name, label) AS ({steps}),
reached AS (SELECT unit_id, state_name, min(ts) AS reached_at
            FROM log JOIN st ON st.id = final_state_id GROUP BY ALL)
SELECT c.unit_id, c.unit_name, c.current_state, s.position, s.state_name, s.label,
       CASE WHEN s.position = h.position THEN 'current'
            WHEN s.position < h.position THEN 'completed' ELSE '' END AS status,
       CASE WHEN s.position <= h.position
            THEN c.state_since - to_hours(2 * (h.position - s.position)) END AS estimated_at,
       r.reached_at
FROM current_units c JOIN step h ON h.state_name = c.current_state JOIN step s ON true
LEFT JOIN reached r ON r.unit_id = c.unit_id AND r.state_name = s.state_name""",
        "c08_daily_rollup": LOG + """
SELECT day, CAST(sum(activity_count) OVER (PARTITION BY day) AS BIGINT) AS total, signal_name,
       activity_count AS n
FROM daily""",
        "c09_heatmap_top": LOG + """
SELECT * FROM heat ORDER BY cnt DESC, from_state, signal_name, to_state LIMIT 10""",
        "c10_zero_defaults": LOG + """
SELECT u.id AS unit_id,
       count(g.id) FILTER (WHERE g.signal_name = 'finished work ok') AS ok_jobs
FROM unit u LEFT JOIN log l ON l.unit_id = u.id LEFT JOIN sig g ON g.id = l.signal_id
GROUP BY u.id""",
        "c11_open_flag": timeline(""", left_at IS NULL AS is_open,
       CAST(floor({minutes} + 0.5) AS BIGINT) AS minutes,
       CASE WHEN left_at IS NULL THEN 'current' ELSE 'success' END AS stay_class"""),
        "x14_hour_labels": LOG + """
SELECT *, concat(CAST(hour(hour) AS VARCHAR), ':00') AS label FROM hourly""",
        "m1_create_units": LOG + f""",
top AS (SELECT (SELECT max(id) FROM unit) AS u, (SELECT max(log_id) FROM log) AS l),
o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT concat('Order ', CAST(o_orderkey AS VARCHAR)) AS unit_name,
       o_orderpriority AS unit_details, top.l + n AS log_id, top.u + n AS unit_id,
       CAST(1 AS BIGINT) AS initial_state_id, CAST(1 AS BIGINT) AS final_state_id,
       o_orderpriority AS payload, CAST(NULL AS BIGINT) AS signal_id, {NOW} AS ts
FROM o, top""",
        "m2_apply_signals": ACCEPTED,
        "m2_rejected": REPLAY + """
SELECT event_id, unit_id, event_type AS signal, props AS payload, ts, before AS state_id
FROM moved WHERE after IS NULL""",
        "m4_unit_status": LOG + """
SELECT u.id AS unit_id, coalesce(l.final_state_id, 1) AS status_id,
       coalesce(l.state_name, 'neutral') AS status_name, coalesce(l.payload, u.details) AS details
FROM unit u LEFT JOIN latest l ON l.unit_id = u.id""",
        "m5_terminal_states": REPLAY + """,
seen AS (SELECT DISTINCT before, after FROM moved WHERE after IS NOT NULL),
reached(id) AS (
  SELECT CAST(1 AS BIGINT) UNION SELECT s.after FROM reached r JOIN seen s ON s.before = r.id),
facts AS (
  SELECT st.id, state_name, is_terminal,
         (SELECT count(*) FROM seen WHERE before = st.id) AS exits,
         st.id IN (SELECT id FROM reached) AS is_reachable
  FROM st)
SELECT *, exits = 0 AS has_no_exit, exits = 0 AND NOT is_terminal AS is_dead_end,
       (exits = 0) = is_terminal AS flag_agrees
FROM facts""",
        "m6_audit_log": SHIFTED + f""",
edge(signal_id, in_state, out_state) AS ({raw_edges}),
chained AS (
  SELECT s.*, lag(final_state_id) OVER (PARTITION BY unit_id ORDER BY ts, log_id) AS last,
         row_number() OVER (PARTITION BY unit_id ORDER BY ts, log_id) AS rn
  FROM shifted s),
joined AS (
  SELECT c.*, e.out_state FROM chained c
  LEFT JOIN edge e ON e.signal_id = c.signal_id AND e.in_state = c.initial_state_id)
SELECT log_id, 'bad_creation' AS reason FROM joined
WHERE signal_id IS NULL AND (initial_state_id <> 1 OR final_state_id <> 1)
UNION ALL SELECT log_id, 'no_transition' FROM joined
WHERE signal_id IS NOT NULL AND out_state IS NULL
UNION ALL SELECT log_id, 'wrong_target' FROM joined
WHERE signal_id IS NOT NULL AND out_state <> final_state_id
UNION ALL SELECT log_id, 'chain_break' FROM joined WHERE rn > 1 AND last <> initial_state_id
UNION ALL SELECT log_id, 'first_row_not_creation' FROM joined
WHERE rn = 1 AND signal_id IS NOT NULL""",
        "l1_load_model": LOG + CURRENT + " FROM current_units",
        "l2_json_rows": LOG + """
SELECT CAST(to_json({'unit_id': unit_id, 'unit_name': unit_name, 'current_state': current_state,
                     'technician': technician}) AS VARCHAR) AS value
FROM current_units""",
        "l3_upsert_missing": """
SELECT c_custkey AS id, c_name AS unit_name,
       CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN c_mktsegment ELSE 'NEW' END
         AS unit_details
FROM customer""",
        "l4_resolve_transitions": LOG + """
SELECT DISTINCT signal_id, initial_state_id AS in_state_id, final_state_id AS out_state_id
FROM log WHERE signal_id IS NOT NULL""",
        "l4_first_edge_wins": LOG + """
SELECT DISTINCT signal_id, initial_state_id AS in_state_id, final_state_id AS out_state_id
FROM log WHERE signal_id IS NOT NULL""",
        "l4_conflicts": LOG + """
SELECT DISTINCT signal_name AS signal, st.state_name AS in_state, st.state_name AS out_state,
       final_state_id AS kept_state_id
FROM log JOIN sig ON sig.id = signal_id JOIN st ON st.id = initial_state_id
WHERE initial_state_id <> final_state_id""",
        "x11_payload_fields": """
SELECT event_id, concat('T', k) AS last_tech, 'old' AS first_tech,
       CASE WHEN CAST(k AS INTEGER) % 3 = 0 THEN 'old' ELSE concat('I', k) END AS id_or_name
FROM (SELECT event_id, props ->> '$.k' AS k FROM events)""",
        "l5_append_log": LOG + """
SELECT log_id, unit_id, initial_state_id, final_state_id, payload, signal_id, ts,
       CAST(ts AS DATE) AS day
FROM log""",
        "l6_shift_time": SHIFTED + """
SELECT log_id, unit_id, ts, coalesce(tech, 'Unassigned') AS technician FROM shifted""",
        "l7_integrity": LOG + """
SELECT 'foreign_key' AS "check", 'log' AS "table", concat('unit_id=', unit_id) AS "key",
       count(*) AS n
FROM log WHERE unit_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY unit_id
UNION ALL SELECT 'unique', 'log', CAST(log_id AS VARCHAR), count(*) FROM log
GROUP BY log_id HAVING count(*) > 1
UNION ALL SELECT 'unique', 'unit', CAST(s_suppkey AS VARCHAR), count(*) FROM supplier
GROUP BY s_suppkey HAVING count(*) > 1
UNION ALL SELECT 'single_initial', 'state', 'is_initial', 2""",
        "l8_purge_units": LOG + """
SELECT log_id, unit_id, ts FROM log WHERE unit_id NOT IN
  (SELECT unit_id FROM current_units WHERE current_state = 'end of service')""",
        "l8_deletable": """
SELECT c_custkey AS id, c_name AS unit_name, c_mktsegment AS unit_details
FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
        "t1_current_state": LOG + """
SELECT unit_id, log_id, ts, final_state_id, payload FROM latest""",
        "t2_throughput": LOG + """
SELECT date_trunc('day', ts) AS day,
       count(*) FILTER (WHERE signal_name = 'finished work ok') AS ok_jobs,
       count(*) FILTER (WHERE signal_name = 'finished work failed') AS failed_jobs,
       count(*) AS total_transitions
FROM log JOIN sig ON sig.id = log.signal_id GROUP BY ALL""",
        "t3_hourly_activity": LOG + "SELECT * FROM hourly",
        "t3_hourly_final": LOG + """
SELECT * FROM hourly WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR""",
        "t4_apply_signals": ACCEPTED,
        "t4_in_time_order": f"""
SELECT * FROM ({ACCEPTED}) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
        "t4_replay_batches": ACCEPTED,
        "t5_sla_alerts": LOG + """
SELECT unit_id, state_name, entered_at, entered_at + INTERVAL 6 HOUR AS due_at
FROM stays JOIN st ON st.id = final_state_id
WHERE state_name IN ('parts missing', 'assigned')
  AND (left_at IS NULL OR left_at > entered_at + INTERVAL 6 HOUR)
  AND entered_at + INTERVAL 6 HOUR < (SELECT max(ts) FROM log) - INTERVAL 10 MINUTE""",
    }

"""Streams worked off in several micro-batches give the batch results."""

import random
import time
from datetime import datetime, timedelta, timezone

import fixture as fx
import pytest
import statetrail as st
from pyspark.sql import functions as F
from statetrail.model import LOG_SCHEMA, SIGNALS_IN_SCHEMA
from statetrail.sources import read_log
from statetrail.streaming import (
    OUTCOME_SCHEMA,
    append_log_stream,
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

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


class Feed:
    """A folder of files, one micro-batch each time it is worked off."""

    def __init__(self, spark, path, schema, job, mode="update", keys=None):
        self.spark, self.path, self.schema, self.mode, self.keys = spark, path, schema, mode, keys
        (path / "in").mkdir()
        self.stream = job(spark.readStream.schema(schema).parquet(f"{path}/in"))

    def push(self, rows):
        rows = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        run_available(self.stream, f"{self.path}/out", f"{self.path}/checkpoint", self.mode)
        return self

    def table(self):
        return last_updates(self.spark, f"{self.path}/out", self.stream.schema, self.keys)


def thirds(df, column):
    """Three parts in the order of a column."""
    first, second = df.approxQuantile(column, [0.33, 0.66], 0.0)
    c = F.col(column)
    return df.filter(c <= first), df.filter((c > first) & (c <= second)), df.filter(c > second)


def test_t1_current_state(spark, tmp_path):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA, current_state_stream, keys=["unit_id"])
    # not in time order: older rows that come later must not win
    for part in thirds(model.log, "log_id"):
        feed.push(part)
    got = {(r["unit_id"], r["log_id"], r["final_state_id"]) for r in feed.table().collect()}
    from statetrail.operators import latest_per_unit
    assert got == {(r["unit_id"], r["log_id"], r["final_state_id"])
                   for r in latest_per_unit(model.log).collect()}


def test_t2_throughput(spark, tmp_path):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA, lambda s: throughput_stream(s, model), keys=["day"])
    for part in thirds(model.log.withColumn("at", F.unix_micros("ts").cast("double")), "at"):
        feed.push(part.drop("at"))
    assert sorted(fx.rows_of(feed.table())) == fx.rows_of(st.throughput(model, days=None))


def test_t2_drops_what_is_later_than_the_watermark(spark, tmp_path):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA, lambda s: throughput_stream(s, model), keys=["day"])
    def row(n, days):
        return (n, 1, 1, 2, None, 1, T0 + timedelta(days=days))
    feed.push([row(1, 0)]).push([row(2, 5)]).push([row(3, 0), row(4, 5)])
    assert sorted(r["total_transitions"] for r in feed.table().collect()) == [1, 2]


def test_t3_hourly_activity(spark, tmp_path):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA, hourly_partials_stream,
                keys=["hour", "unit_id", "technician"])
    for part in thirds(model.log.withColumn("at", F.unix_micros("ts").cast("double")), "at"):
        feed.push(part.drop("at"))
    assert fx.rows_of(st.hourly_from_partials(feed.table())) == fx.rows_of(
        st.hourly_activity(model, hours=None))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_t3_hands_out_each_hour_once(spark, tmp_path, parts):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA, lambda s: hourly_activity_stream(s, "0 seconds"), "append")
    rows = sorted(model.log.collect(), key=lambda r: r["ts"])
    last = max(r["ts"] for r in rows).replace(minute=0, second=0, microsecond=0)
    size = -(-len(rows) // parts)
    for start in range(0, len(rows), size):
        feed.push([tuple(r) for r in rows[start:start + size]])
    closed = st.hourly_activity(model, hours=None).filter(F.col("hour") < F.lit(last))
    assert closed.count() >= 4
    assert sorted(fx.rows_of(feed.table())) == sorted(fx.rows_of(closed))


def test_t3_ignores_what_is_behind_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, LOG_SCHEMA, lambda s: hourly_activity_stream(s, "1 hour"), "append")

    def row(n, hours, payload=None):
        return (n, n % 2, 1, 2, payload, 1, T0 + timedelta(hours=hours))

    # 3 is out of order within the delay, 5 too late
    feed.push([row(1, 0.1), row(2, 0.2, '{"tech": "A"}')]).push([row(4, 1.1)]).push([row(3, 0.9)])
    feed.push([row(6, 6)]).push([row(5, 0.5), row(8, 9)])
    found = [tuple(r)[1:] for r in sorted(feed.table().collect(), key=lambda r: r["hour"])]
    assert found == [(3, 2, 2), (1, 1, 1), (1, 1, 1)]


class SignalFeed(Feed):
    """Signals moved by keyed state, or by replaying each micro-batch in pieces."""

    def __init__(self, spark, path, model, replayed):
        super().__init__(spark, path, SIGNALS_IN_SCHEMA, lambda s: s if replayed
                         else apply_signals_stream(s, model), "append")
        self.model, self.replayed = model, replayed

    def push(self, rows):
        if not self.replayed:
            return super().push(rows)
        rows = rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, self.schema)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        if not (self.path / "checkpoint").exists():
            self.query = replay_batches(self.stream, self.model, f"{self.path}/out",
                                        f"{self.path}/checkpoint", rows_per_task=2)
        self.query.processAllAvailable()
        return self

    def table(self):
        if not self.replayed:
            return super().table()
        self.query.stop()
        return last_updates(self.spark, f"{self.path}/out/outcomes", OUTCOME_SCHEMA)


@pytest.mark.parametrize("replayed", [False, True], ids=["state", "replay"])
def test_t4_equals_the_batch(spark, tmp_path, replayed):
    model = fx.model(spark, rows=[])
    signals = fx.signals_in(spark)
    feed = SignalFeed(spark, tmp_path, model, replayed)
    for part in thirds(signals, "event_id"):
        feed.push(part)
    columns = ["event_id", "unit_id", "initial_state_id", "final_state_id", "signal_id", "ts"]
    got = sorted(fx.rows_of(feed.table().filter("outcome = 'accepted'").select(columns)))
    batch = st.signal_outcomes(model, signals).select(columns)
    assert got == sorted(fx.rows_of(batch)) and len(got) == 76


@pytest.mark.parametrize("replayed", [False, True], ids=["state", "replay"])
def test_t4_late_rejected_and_known_units(spark, tmp_path, replayed):
    # unit 3 of the scenario stands in ``parts missing``
    model = fx.model(spark)
    feed = SignalFeed(spark, tmp_path, model, replayed)
    at = [fx.AS_OF + timedelta(seconds=n) for n in range(5)]
    feed.push([(101, 3, "parts picked ok", None, at[1]), (102, 3, "dispatch", None, at[2]),
               (103, 70, "customer call", None, at[1])])
    feed.push([(104, 3, "finished work ok", None, at[0]),
               (105, 3, "finished work ok", None, at[3]), (106, 70, "assign", None, at[2])])
    got = {r["event_id"]: (r["outcome"], r["initial_state_id"], r["final_state_id"])
           for r in feed.table().collect()}
    assert got == {101: ("accepted", 8, 5), 102: ("rejected", 5, None),
                   103: ("accepted", 1, 2), 104: ("late", None, None),
                   105: ("accepted", 5, 6), 106: ("accepted", 2, 3)}


def test_t5_one_alert_per_stay(spark, tmp_path):
    model = fx.model(spark)
    feed = Feed(spark, tmp_path, LOG_SCHEMA,
                lambda s: sla_alerts_stream(s, model, hours=2, delay="0 seconds"), "append")

    def row(log_id, unit, state, hours):
        return (log_id, unit, 1, state, None, 1, T0 + timedelta(hours=hours))

    # 1 waits in ``assigned`` from 0, 2 leaves in time, 3 is not watched
    feed.push([row(1, 1, 3, 0), row(2, 2, 3, 0), row(3, 3, 2, 0)])
    feed.push([row(4, 2, 4, 1)])
    feed.push([row(5, 9, 2, 1.9)])
    assert feed.table().count() == 0
    feed.push([row(6, 9, 2, 3)])
    first = feed.table().collect()
    assert [(r["unit_id"], r["state_name"]) for r in first] == [(1, "assigned")]
    assert first[0]["due_at"] - first[0]["entered_at"] == timedelta(hours=2)
    # a second stay gives a second alert, the first one is not repeated
    feed.push([row(7, 1, 8, 4)])
    feed.push([row(8, 9, 2, 8)])
    assert sorted((r["unit_id"], r["state_name"]) for r in feed.table().collect()) == [
        (1, "assigned"), (1, "parts missing")]


def test_log_stream_is_appended_by_day(spark, tmp_path):
    model = fx.model(spark)
    model.log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(f"{tmp_path}/in")
    append_log_stream(stream, f"{tmp_path}/log", f"{tmp_path}/checkpoint",
                      availableNow=True).awaitTermination()
    stored = read_log(spark, f"{tmp_path}/log")
    assert stored.count() == 92 and stored.filter("day = DATE '2025-01-08'").count() == 7


def test_streams_check_their_arguments(spark):
    model = fx.model(spark)
    with pytest.raises(ValueError):
        sla_alerts_stream(model.log, model, hours=0)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_t5_does_not_depend_on_the_micro_batches(spark, tmp_path, parts):
    model = fx.model(spark, rows=[])
    feed = Feed(spark, tmp_path, LOG_SCHEMA,
                lambda s: sla_alerts_stream(s, model, hours=2, delay="10 minutes"), "append")

    def row(log_id, unit, state, hours):
        return (log_id, unit, 1, state, None, 1, T0 + timedelta(hours=hours))

    # unit 1 leaves ``assigned`` after 30 hours, 2 after exactly two, 3 a second later; 4 stays
    # on, 5 enters once more at the same time; 6 is seen out of order, within the delay
    rows = [row(1, 1, 3, 0), row(2, 2, 3, 0), row(3, 3, 3, 0), row(4, 4, 3, 0), row(5, 5, 3, 0),
            row(6, 5, 3, 0), row(7, 6, 2, 0.1), row(8, 6, 3, 0.05), row(9, 2, 4, 2),
            row(10, 3, 4, 2 + 1 / 3600), row(11, 5, 4, 2.5), row(12, 1, 4, 30), row(13, 9, 2, 31)]
    size = -(-len(rows) // parts)
    for start in range(0, len(rows), size):
        feed.push(rows[start:start + size])
    found = sorted((r["unit_id"], r["entered_at"]) for r in feed.table().collect())
    assert [unit for unit, _ in found] == [1, 3, 4, 5]


def test_t5_ignores_what_is_behind_the_watermark(spark, tmp_path):
    model = fx.model(spark, rows=[])
    feed = Feed(spark, tmp_path, LOG_SCHEMA,
                lambda s: sla_alerts_stream(s, model, hours=1, delay="0 seconds"), "append")

    def row(log_id, unit, state, hours):
        return (log_id, unit, 1, state, None, 1, T0 + timedelta(hours=hours))

    feed.push([row(1, 1, 4, 5)]).push([row(2, 2, 4, 6)]).push([row(3, 1, 3, 1)]).push([row(4, 2, 4, 9)])
    assert feed.table().count() == 0


def test_t5_late_rows_take_no_others_with_them(spark, tmp_path):
    feed = Feed(spark, tmp_path, LOG_SCHEMA, lambda s: sla_alerts_stream(
        s, fx.model(spark, rows=[]), hours=1, delay="0 seconds"), "append")

    def row(log_id, unit, state, hours):
        return (log_id, unit, 1, state, None, 1, T0 + timedelta(hours=hours))

    feed.push([row(1, 1, 3, 5)]).push([row(2, 2, 4, 5.5)])
    feed.push([row(3, 1, 4, 1), row(4, 3, 3, 7), row(5, 2, 3, 6)]).push([row(6, 4, 4, 20)])
    assert sorted((r["unit_id"], r["state_name"]) for r in feed.table().collect()) == [
        (1, "assigned"), (2, "assigned"), (3, "assigned")]


def test_updates_by_key_are_brought_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("statetrail.streaming.sink.COMPACT_EVERY", 4)
    rows = [(n, n % 3, 1, 2, None, 1, T0 + timedelta(hours=n)) for n in range(10)]
    (tmp_path / "in").mkdir()
    stream = current_state_stream(spark.readStream.schema(LOG_SCHEMA).parquet(f"{tmp_path}/in"))
    for row in rows:
        spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in")
        run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", keys=["unit_id"])
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch_id=")]) <= 6
    table = last_updates(spark, f"{tmp_path}/out", stream.schema, ["unit_id"])
    assert {(r["unit_id"], r["log_id"]) for r in table.collect()} == {(0, 9), (1, 7), (2, 8)}


@pytest.mark.parametrize("replayed", [False, True], ids=["state", "replay"])
def test_t4_a_signal_that_comes_twice_is_late(spark, tmp_path, replayed):
    feed = SignalFeed(spark, tmp_path, fx.model(spark, rows=[]), replayed)
    call = (1, 1, "customer call", "{}", T0)
    feed.push([call, call, (2, 1, "assign", "{}", T0 + timedelta(hours=1))]).push([call])
    assert sorted(r["outcome"] for r in feed.table().collect()) == [
        "accepted", "accepted", "late", "late"]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_t4_in_time_order_whatever_comes_first(spark, tmp_path, parts):
    model = fx.model(spark, rows=[])
    signals = sorted((tuple(r) for r in fx.signals_in(spark).collect()), key=lambda r: r[4])
    delay = (signals[-1][4] - signals[0][4]).total_seconds() + 60
    mixed = list(signals)
    random.Random(7).shuffle(mixed)
    size = -(-len(mixed) // parts)
    (tmp_path / "in").mkdir()
    for start in range(0, len(mixed), size):
        spark.createDataFrame(mixed[start:start + size], SIGNALS_IN_SCHEMA).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SIGNALS_IN_SCHEMA).option("maxFilesPerTrigger", 1)
    stream = apply_signals_stream(source.parquet(f"{tmp_path}/in"), model, f"{delay:.0f} seconds")

    def table():
        run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append")
        return last_updates(spark, f"{tmp_path}/out", stream.schema)

    assert table().count() == 0
    last = [(10**6, 10**6, "customer call", None, signals[-1][4] + timedelta(seconds=2 * delay))]
    spark.createDataFrame(last, SIGNALS_IN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    columns = ["event_id", "unit_id", "initial_state_id", "final_state_id", "signal_id", "ts"]
    found = table()
    assert found.filter("outcome = 'late'").count() == 0
    batch = st.signal_outcomes(model, fx.signals_in(spark)).select(columns)
    assert sorted(fx.rows_of(found.select(columns))) == sorted(fx.rows_of(batch))


def test_t4_in_time_order_late_repeated_and_known(spark, tmp_path):
    # unit 3 of the scenario stands in ``parts missing``
    feed = Feed(spark, tmp_path, SIGNALS_IN_SCHEMA,
                lambda s: apply_signals_stream(s, fx.model(spark), "10 seconds"), "append")
    at = [fx.AS_OF + timedelta(seconds=n) for n in (0, 1, 2, 3, 60, 120)]
    feed.push([(102, 3, "finished work ok", None, at[2]), (103, 70, "customer call", None, at[3])])
    feed.push([(101, 3, "parts picked ok", None, at[1]), (101, 3, "parts picked ok", None, at[1])])
    feed.push([(200, 90, "customer call", None, at[4])])
    feed.push([(104, 3, "finished work ok", None, at[0]), (201, 90, "no such signal", None, at[5])])
    feed.push([(202, 91, "customer call", None, at[5] + timedelta(minutes=1))])
    got = sorted((r["event_id"], r["outcome"], r["initial_state_id"], r["final_state_id"])
                 for r in feed.table().collect())
    assert got == sorted([
        (101, "accepted", 8, 5), (101, "late", None, None), (102, "accepted", 5, 6),
        (103, "accepted", 1, 2), (104, "late", None, None), (200, "accepted", 1, 2),
        (201, "rejected", 2, None)])


def test_t5_one_unit_of_many_rows(spark, tmp_path):
    """Every stay of a unit with 20,000 rows, in three micro-batches; the time is linear in the rows."""
    model = fx.model(spark, rows=[])
    rng, now, rows = random.Random(3), T0, []
    for n in range(20_000):
        rows.append((n, 1, 1, rng.choice([3, 8, 4]), None, 1, now))
        now += timedelta(minutes=rng.choice([10, 60, 119, 120, 121, 300]))
    rows.append((20_000, 1, 1, 4, None, 1, now))
    expected = [a[0] for a, b in zip(rows, rows[1:]) if a[3] in (3, 8) and b[6] - a[6] > timedelta(hours=2)]
    feed = Feed(spark, tmp_path, LOG_SCHEMA,
                lambda s: sla_alerts_stream(s, model, hours=2, delay="1 hour"), "append")
    took = []
    for start, stop in ((0, 1_000), (1_000, 10_500), (10_500, 20_001)):
        part = rows[start:stop]
        random.Random(start).shuffle(part)
        begun = time.perf_counter()
        feed.push(part)
        took.append(time.perf_counter() - begun)
    feed.push([(30_000, 2, 1, 4, None, 1, now + timedelta(hours=4))])
    at = {r[6]: r[0] for r in rows}
    found = sorted(at[r["entered_at"].replace(tzinfo=timezone.utc)] for r in feed.table().collect())
    assert found == expected and len(expected) > 3_000
    assert took[2] < 10 * max(took[0], 1.5)

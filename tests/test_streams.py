"""Streams over several micro-batches: expiry, timers, restarts, batches that come twice, compaction and sketches."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import oplog
from weftline.sources import tables
from weftline.streaming import jobs, keyed, sinks


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour, minutes=minute)


@pytest.fixture
def replay(spark, tmp_path):
    """Runs a job step by step: each call adds a file of rows to its source and takes what the job has written so far."""

    def start(schema, job):
        source = str(tmp_path / "in")
        os.makedirs(source)

        def step(*rows):
            if rows:
                spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            return jobs.run_all(job(stream), str(tmp_path / "out"), str(tmp_path / "state")).collect()

        return step

    return start


def test_limiter_over_micro_batches(replay, tmp_path):
    """Only admitted events count, also those of earlier batches; what left the window is forgotten."""
    step = replay("user_id long, event_id long, ts timestamp", lambda s: keyed.rate_limit(s.withWatermark("ts", "1 minute"), 2, 3600))
    step((1, 1, at(0)), (1, 2, at(0, 10)), (2, 3, at(0, 5)))
    step((1, 4, at(0, 30)), (1, 5, at(1, 5)))
    got = {r.event_id: (r.accepted, r.retry_after) for r in step((1, 6, at(1, 5)), (2, 7, at(9)))}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 1800), 5: (True, 0), 6: (False, 300), 7: (True, 0)}


def test_a_timer_ends_a_cooldown(replay):
    """A disabled site recovers half an hour after its last failure, though it is silent; its next failure is its first."""
    step = replay("site string, event_id long, ts timestamp", lambda s: keyed.circuit_breaker(s.withWatermark("ts", "1 minute"), 2, 3))
    step(*[("a", i, at(0, i)) for i in range(3)])
    assert not [r for r in step() if r.status == "recovered"]
    out = step(("b", 9, at(2)))
    assert [(r.site, r.ts, r.failures) for r in out if r.status == "recovered"] == [("a", at(0, 32), 0)]
    got = {r.event_id: (r.failures, r.status) for r in step(("a", 10, at(3))) if r.event_id is not None}
    assert got == {0: (1, "healthy"), 1: (2, "degraded"), 2: (3, "disabled"), 9: (1, "healthy"), 10: (1, "healthy")}


def test_failures_of_ten_minutes(replay):
    """Windows come once the watermark has passed them; what is later than that is dropped."""
    step = replay("site string, event_id long, ts timestamp", lambda s: keyed.failure_report(s.withWatermark("ts", "5 minutes")))
    step(("a", 1, at(0, 1)), ("a", 2, at(0, 9)), ("b", 3, at(0, 11)))
    step(("a", 4, at(1)))
    got = {(r.site, r.window_start): r.failures for r in step(("a", 5, at(0, 2)), ("a", 6, at(2)))}
    assert got[("a", at(0))] == 2 and got[("b", at(0, 10))] == 1


def test_stale_requests_fail_with_their_runs(spark, replay):
    schema = "request_id long, kind string, run_id string, state string, ts timestamp"
    step = replay(schema, lambda s: keyed.sweep_stale(s.withWatermark("ts", "1 minute"), 10))
    rows = [(1, "request", None, "INIT", at(0)), (1, "run", "1a", "RUNNING", at(0, 1)), (1, "run", "1b", "COMPLETED", at(0, 2)), (2, "request", None, "INIT", at(0)), (3, "request", None, "COMPLETED", at(0)), (3, "run", "3a", "RUNNING", at(0)), (4, "run", "4a", "RUNNING", at(0))]
    step(*rows)
    later = [(2, "request", None, "VALIDATED", at(0, 8)), (5, "request", None, "INIT", at(0, 15))]
    out = step(*later)
    batch = spark.createDataFrame([(i, s, t) for i, k, _, s, t in [*rows, *later] if k == "request"], "request_id long, state string, updated_at timestamp")
    newest = batch.groupBy("request_id").agg(F.max_by("state", "updated_at").alias("state"), F.max("updated_at").alias("updated_at"))
    runs = spark.createDataFrame([(i, n, s) for i, k, n, s, _ in rows if k == "run"], "request_id long, run_id string, run_state string")
    gone, failed, points = oplog.sweep_stale(newest, runs, "2024-01-01 00:14:00")
    want = {("request", r.request_id, None) for r in gone.collect()} | {("run", r.request_id, r.run_id) for r in failed.collect()} | {("checkpoint", r.request_id, None) for r in points.collect()}
    assert {(r.kind, r.request_id, r.run_id) for r in out} == want == {("request", 1, None), ("checkpoint", 1, None), ("run", 1, "1a")}
    assert {(r.kind, r.request_id) for r in step((6, "request", None, "INIT", at(9)))} == {("request", i) for i in (1, 2, 5)} | {("checkpoint", i) for i in (1, 2, 5)} | {("run", 1)}


def test_stale_requests_of_one_group(replay):
    """Requests that share a timer and a state: each is judged by its own time, and runs from before its end are forgotten when it is opened again."""
    schema = "request_id long, kind string, run_id string, state string, ts timestamp"
    step = replay(schema, lambda s: keyed.sweep_stale(s.withWatermark("ts", "1 minute"), 10, groups=1))
    step((1, "request", None, "INIT", at(0)), (1, "run", "1a", "RUNNING", at(0)), (2, "request", None, "INIT", at(0)), (2, "run", "2a", "RUNNING", at(0, 1)), (3, "run", "3a", "RUNNING", at(0)))
    step((1, "request", None, "COMPLETED", at(0, 2)))
    step((1, "request", None, "INIT", at(0, 4)), (1, "run", "1b", "RUNNING", at(0, 4)), (2, "run", "2a", "COMPLETED", at(0, 4)), (2, "run", "2b", "RUNNING", at(0, 3)))
    out = step((4, "request", None, "INIT", at(0, 12)))
    assert {(r.kind, r.request_id, r.run_id) for r in out} == {("request", 2, None), ("checkpoint", 2, None), ("run", 2, "2b")}
    out = step((5, "request", None, "COMPLETED", at(9)))
    assert {(r.kind, r.request_id, r.run_id, r.previous_state) for r in out if r.request_id != 2} == {(k, i, None, "INIT") for k in ("request", "checkpoint") for i in (1, 4)} | {("run", 1, "1b", "RUNNING")}


def test_request_actions_over_micro_batches(replay):
    step = replay("key string, request_id long, state string, ts timestamp", lambda s: keyed.request_actions(s.withWatermark("ts", "1 minute"), keep=3600 * 5.0))
    step(("k", 1, None, at(0)), ("k", 2, None, at(0, 1)))
    step(("k", 1, "FAILED", at(0, 2)), ("k", 3, None, at(0, 3)), ("k", 2, "COMPLETED", at(0, 4)))
    step(("k", 3, "COMPLETED", at(0, 6)), ("k", 4, None, at(0, 7)), ("j", 5, None, at(0, 7)))
    step(("x", 6, None, at(9)))
    got = {r.request_id: (r.action, r.existing_id) for r in step(("k", 7, None, at(10)))}
    assert got == {1: ("none", None), 2: ("attach", 1), 3: ("retry", 1), 4: ("return", 3), 5: ("none", None), 6: ("none", None), 7: ("none", None)}


def test_a_batch_counts_once(spark, data, tmp_path):
    """A batch that dies between write and commit is written anew; one that comes again after its commit changes nothing."""
    s = spark.read.parquet(f"{data}/events.parquet").select(F.col("event_type").alias("domain"), F.col("user_id").alias("site"), (F.col("value") / 100).alias("score"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("tie"))
    table = sinks.site_memory_sink(spark, str(tmp_path / "m"), ["domain", "site"])
    assert table.read() is None and table.committed() == []
    parts = [s.where(F.col("tie") % 3 == i) for i in range(3)]
    table.apply(parts[0], 0)
    table.prepare(parts[1], 1)  # dies here
    assert table.committed() == [0]
    for i in (1, 0, 1, 2, 2):
        table.apply(parts[i], i)
    assert table.committed() == [1, 2] and sorted(x for x in os.listdir(tmp_path / "m")) == ["ledger", "snapshot-1", "snapshot-2"]
    got = {(r.domain, r.site): (r.query_count, r.success_count, round(r.avg_score, 9)) for r in table.read().collect()}
    assert got == {(r.domain, r.site): (r.query_count, r.success_count, round(r.avg_score, 9)) for r in oplog.site_memory(s, ["domain", "site"]).collect()}


def test_upserts_keep_the_newest(spark, tmp_path):
    table = sinks.upsert_sink(spark, str(tmp_path / "t"), ["k"], ["ts"])
    for i, rows in enumerate(([(1, 5, "a"), (2, 1, "b")], [(1, 3, "late"), (2, 2, "c"), (2, 1, "d")], [(3, 1, "e")])):
        table.apply(spark.createDataFrame(rows, "k long, ts long, v string"), i)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 5, "a"), (2, 2, "c"), (3, 1, "e")]


def test_compaction_touches_days_that_are_over_only(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = [(i, None if i == 9 else at(0) + dt.timedelta(hours=8 * i)) for i in range(10)]
    sinks.write_expiring(spark.createDataFrame(rows, "id long, expires_at timestamp").repartition(1), path)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    assert sinks.compact(spark, path, "2024-01-02 12:00:00") == 2
    after = files()
    assert {r.id for r in spark.read.parquet(path).collect()} == {5, 6, 7, 8, 9}
    untouched = {f for f in before if "2024-01-03" in f or "HIVE" in f}
    assert untouched and all(after[f] == before[f] for f in untouched)
    assert not [f for f in after if "2024-01-01" in f] and sinks.compact(spark, path, "2024-01-02 12:00:00") == 0
    assert files() == after


def test_merged_sketches_bound_quantiles(spark, tmp_path):
    """Medians and 0.9 quantiles of sliding hours from sketches of ten minutes; late rows are dropped past the watermark."""
    rng = np.random.default_rng(0)
    rows = [("a", at(0) + dt.timedelta(seconds=int(s)), float(v)) for s, v in zip(rng.integers(0, 7200, 6000), rng.lognormal(size=6000), strict=True)]
    schema, source = "kind string, ts timestamp, value double", str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    run = lambda: jobs.run_all(jobs.windowed_sketches(spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 minute"), ["kind"]), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    spark.createDataFrame([("a", at(5), 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("a", at(0, 1), 1e9), ("a", at(9), 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    sketches = run()
    assert sketches.where("window_start < timestamp'2024-01-01 02:00:00'").agg(F.sum("n")).first()[0] == 6000
    for r in jobs.sliding_quantiles(sketches, ["kind"], [0.5, 0.9]).where("window_start >= timestamp'2024-01-01' and window_start <= timestamp'2024-01-01 01:00:00'").collect():
        values = np.sort([v for _, t, v in rows if r.window_start <= t < r.window_start + dt.timedelta(hours=1)])
        assert r.n == len(values)
        for q, found in zip((0.5, 0.9), r.quantiles, strict=True):
            assert abs(np.searchsorted(values, found) / len(values) - q) < 0.02


def test_a_clock_needs_no_rows(spark, tmp_path):
    """Times of a clock move the watermark and never reach the state."""
    clock, source = str(tmp_path / "clock"), str(tmp_path / "in")
    keyed.tick(spark, clock)
    spark.createDataFrame([("a", i, at(0, i)) for i in range(3)], "site string, event_id long, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("site string, event_id long, ts timestamp").parquet(source)
    df = keyed.circuit_breaker(keyed.clocked(stream, clock), 2, 3)
    run = lambda: jobs.run_all(df, str(tmp_path / "out"), str(tmp_path / "state"))
    assert run().count() == 3
    keyed.tick(spark, clock, "2024-01-02 00:00:00")
    assert [(r.site, r.status) for r in run().where("event_id is null").collect()] == [("a", "recovered")]


def test_streams_of_tables(spark, data):
    assert tables.read_stream(spark, data, "orders").isStreaming

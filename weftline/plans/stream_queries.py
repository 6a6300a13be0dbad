"""Queries that replay tables as streams into keyed state, timers, snapshot tables and sketches, each held against its batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import oplog
from weftline.plans.data_sql import _ORD
from weftline.plans.log_queries import _FMT, _MEMORY, _REQ
from weftline.sources import tables
from weftline.streaming import jobs, keyed, sinks

#: Longer than the replayed tables: their files are not in order of time.
AS_IT_COMES = "5000 days"
SWEPT_AT = "1998-01-01 00:00:00"


def _replayed(spark: SparkSession, stream: DataFrame, job, name: str, end: str, delay: str) -> DataFrame:
    """A job over a stream with a clock: all rows first, then the clock at end, so that every timer fires."""
    clock, out, state = (tables.scratch(spark, x) for x in ("clock", name, "state"))
    keyed.tick(spark, clock)
    df = job(keyed.clocked(stream, clock, delay=delay))
    jobs.run_all(df, out, state)
    keyed.tick(spark, clock, end)
    return jobs.run_all(df, out, state)


def _failures(spark: SparkSession, d: str) -> DataFrame:
    stream = tables.read_log_stream(spark, d).where("event_type = 'error'")
    return stream.select(F.col("user_id").cast("string").alias("site"), "event_id", "ts")


def breaker_recoveries_stream(spark: SparkSession, d: str) -> DataFrame:
    """The ends of cooldowns, at five failures in a row of time, by the next failure or by a timer."""
    out = _replayed(spark, _failures(spark, d), lambda s: keyed.circuit_breaker(s, 3, 5), "broken", "2030-01-01 00:00:00", "60 days")
    return out.where("status = 'recovered'").select("site", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ended"), "failures")


def failure_report_stream(spark: SparkSession, d: str) -> DataFrame:
    """Failures per site and ten minutes, each window once the watermark has passed it."""
    out = _replayed(spark, _failures(spark, d), keyed.failure_report, "report", "2030-01-01 00:00:00", "60 days")
    return out.select("site", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "failures")


def stale_sweep_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests and lineitem as site runs, up to a time, each request with a timer of ten minutes."""
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("INIT")
    end = F.lit(SWEPT_AT).cast("timestamp")
    requests = tables.read_stream(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("request").alias("kind"), F.lit(None).cast("string").alias("run_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    runs = tables.read_stream(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.lit("run").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("RUNNING").alias("state"), F.least(F.col("l_shipdate").cast("timestamp"), end - F.expr("interval 1 day")).alias("ts")
    )
    stream = requests.where(F.col("ts") < end - F.expr("interval 10 minutes")).unionByName(runs)
    out = _replayed(spark, stream, keyed.sweep_stale, "swept", "2020-01-01 00:00:00", AS_IT_COMES)
    return out.select("kind", "request_id", F.coalesce("run_id", F.lit("")).alias("run_id"), "state", "previous_state")


def request_actions_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests, each finished a second later: what to do with a request by the newest one of its key."""
    o = tables.read_stream(spark, d, "orders")
    done = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("INIT")
    at = F.col("o_orderdate").cast("timestamp")
    rows = F.array(F.struct(F.lit(None).cast("string").alias("state"), at.alias("ts")), F.struct(done.alias("state"), (at + F.expr("interval 1 second")).alias("ts")))
    stream = o.select(F.concat_ws("|", "o_orderpriority", F.col("o_custkey") % 100).alias("key"), F.col("o_orderkey").alias("request_id"), F.explode(rows).alias("r")).select("key", "request_id", "r.state", "r.ts")
    out = jobs.run_all(keyed.request_actions(stream.withWatermark("ts", AS_IT_COMES), keep=5000 * 86_400.0), tables.scratch(spark, "acted"), tables.scratch(spark, "state"))
    return out.select("request_id", "action", "existing_id")


def site_memory_stream(spark: SparkSession, d: str) -> DataFrame:
    """Site memory from the log as a stream, batch by batch into a table that counts each once."""
    s = tables.read_log_stream(spark, d).select(F.col("event_type").alias("domain"), F.col("user_id").alias("site"), (F.col("value") / 100).alias("score"), F.col("ts").alias("created_at"), F.col("event_id").alias("tie"))
    table = sinks.site_memory_sink(spark, tables.scratch(spark, "memory"), ["domain", "site"])
    df = sinks.run_into(s, table, tables.scratch(spark, "state"))
    return df.select("domain", "site", F.round(F.col("avg_score") * F.col("query_count"), 4).alias("total_score"), "query_count", "success_count", F.round("last_score", 6).alias("last_score"))


def request_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and type, upserted batch by batch."""
    s = tables.read_log_stream(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    df = sinks.run_into(s, sinks.upsert_sink(spark, tables.scratch(spark, "newest"), ["user_id", "event_type"], ["ts", "event_id"]), tables.scratch(spark, "state"))
    return df.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


def cache_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cache rows that expire after 30 days, by day, after a compaction."""
    path = tables.scratch(spark, "cache")
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.lit(30), hours=(F.col("o_orderkey") % 24).cast("int"))).alias("expires_at"))
    sinks.write_expiring(rows.repartition(F.to_date("expires_at")), path)
    sinks.compact(spark, path, "1997-01-01 12:00:00")
    return spark.read.parquet(path).select("o_orderkey", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


def latency_sketch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Values per type and sliding day from merged half-day sketches, with how many values are at most the sketch's median: within 3 % of half."""
    stream = tables.read_log_stream(spark, d).select("event_type", "ts", "value")
    sketches = _replayed(spark, stream, lambda s: jobs.windowed_sketches(s, ["event_type"], width="12 hours"), "sketches", "2030-01-01 00:00:00", "60 days")
    found = tables.stored(jobs.sliding_quantiles(sketches, ["event_type"], [0.5], "24 hours", "12 hours"), "quantiles")
    at = F.window(F.col("ts"), "24 hours", "12 hours")
    values = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").select("event_type", "value", at.alias("w")).select("event_type", "value", F.col("w.start").alias("window_start"))
    both = values.join(found.hint("merge"), ["event_type", "window_start"])
    per = both.groupBy("event_type", "window_start", "n").agg(F.count_if(F.col("value") <= F.col("quantiles")[0]).alias("below"), F.count_if(F.col("value") < F.col("quantiles")[0]).alias("under"))
    bound = 0.03 * F.col("n") + 1
    return per.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", ((F.col("below") >= F.col("n") / 2 - bound) & (F.col("under") <= F.col("n") / 2 + bound)).alias("within"))


def latency_histogram_stream(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative buckets of values per type and two-day window, from the append-mode histograms of days."""
    stream = tables.read_log_stream(spark, d).select("event_type", "ts", (F.col("value") * 100).alias("ms"))
    per_day = _replayed(spark, stream, lambda s: jobs.windowed_histogram(s, ["event_type"], oplog.STAGE_MS, "ms", "1 day"), "histogram", "2030-01-01 00:00:00", "60 days")
    rows = per_day.select("event_type", F.window("window_start", "2 days").alias("w"), F.posexplode("counts").alias("i", "n"))
    per = rows.groupBy("event_type", F.col("w.start").alias("window_start"), "i").agg(F.sum("n").alias("n"))
    le = F.get(F.array(*[F.lit(float(b)) for b in oplog.STAGE_MS]), F.col("i"))
    return per.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), le.alias("le"), "n")


QUERIES = {
    f.__name__: f
    for f in (breaker_recoveries_stream, failure_report_stream, stale_sweep_stream, request_actions_stream, site_memory_stream, request_upsert_stream, cache_compacted, latency_sketch_stream, latency_histogram_stream)
}

_STALE = f"(SELECT * FROM {_REQ} WHERE state = 'INIT' AND updated_at < TIMESTAMP '{SWEPT_AT}' - INTERVAL 10 MINUTE)"
ORACLES = {
    "breaker_recoveries_stream": f"""
WITH RECURSIVE e AS (SELECT user_id, ts, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
w AS (
  SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT w.user_id, e.i, CASE WHEN w.n >= 5 AND e.s - w.s >= 1800 THEN 1 ELSE w.n + 1 END, e.s, e.ts FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT w.user_id::VARCHAR AS site, strftime(w.ts + INTERVAL 30 MINUTE, {_FMT}) AS ended, 0 AS failures FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 WHERE w.n >= 5 AND (e.s IS NULL OR e.s - w.s >= 1800)""",
    "failure_report_stream": f"SELECT user_id::VARCHAR AS site, strftime(time_bucket(INTERVAL 10 MINUTE, ts), {_FMT}) AS window_start, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL",
    "stale_sweep_stream": f"""
SELECT unnest(['request', 'checkpoint']) AS kind, request_id, '' AS run_id, 'FAILED' AS state, state AS previous_state FROM {_STALE}
UNION ALL SELECT 'run', q.request_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), 'FAILED', 'RUNNING' FROM lineitem JOIN {_STALE} q ON l_orderkey = q.request_id WHERE l_linestatus <> 'F'""",
    "request_actions_stream": f"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS i FROM (
    SELECT domain || '|' || intent_hash AS key, request_id, unnest([NULL, state]) AS change, unnest([created_at, created_at + INTERVAL 1 SECOND]) AS ts FROM {_ORD})),
w AS (
  SELECT key, 0::BIGINT AS i, NULL::BIGINT AS newest, NULL::VARCHAR AS state, NULL::BIGINT AS request_id, NULL::VARCHAR AS action, NULL::BIGINT AS existing_id FROM (SELECT DISTINCT key FROM m)
  UNION ALL
  SELECT key, i, CASE WHEN change IS NULL AND a IN ('none', 'retry') THEN r ELSE newest END, CASE WHEN change IS NOT NULL THEN CASE WHEN r = newest THEN change ELSE state END WHEN a IN ('none', 'retry') THEN 'INIT' ELSE state END,
    r, CASE WHEN change IS NULL THEN a END, newest
  FROM (SELECT m.key, m.i, m.change, m.request_id AS r, w.newest, w.state, CASE WHEN w.state IS NULL THEN 'none' WHEN w.state = 'COMPLETED' THEN 'return' WHEN w.state = 'FAILED' THEN 'retry' ELSE 'attach' END AS a FROM w JOIN m ON m.key = w.key AND m.i = w.i + 1))
SELECT request_id, action, existing_id FROM w WHERE action IS NOT NULL""",
    "site_memory_stream": _MEMORY,
    "request_upsert_stream": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 4) AS value FROM events GROUP BY ALL",
    "cache_compacted": f"""
SELECT o_orderkey, strftime(e, {_FMT}) AS expires_at FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 30 DAY + INTERVAL 1 HOUR * (o_orderkey % 24) AS e FROM orders) WHERE e > TIMESTAMP '1997-01-01 12:00:00'""",
    "latency_histogram_stream": f"""
SELECT event_type, strftime(time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, le, count(*) FILTER (value * 100 <= le) AS n
FROM events, (SELECT unnest([{", ".join(f"{float(b)}::DOUBLE" for b in oplog.STAGE_MS)}]) AS le) GROUP BY ALL""",
    "latency_sketch_stream": f"""
SELECT event_type, strftime(w, {_FMT}) AS window_start, count(*) AS n, true AS within FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL""",
}

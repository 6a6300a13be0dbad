"""Keyed state over the operational log with event-time timers: limiter, breaker, stale sweep, request deduplication.

Each job is a processor of transformWithStateInPandas. State lives in named variables of the state store (RocksDB), a
timer per key forgets what is over, so state grows with the active keys. Of a key's rows in a micro-batch only
times and ids are held, as arrays of 16 bytes a row, and taken in order of time; a source's trigger bounds a micro-batch.
The stale sweep, whose keys have few rows each, takes them in groups.

A stream's watermark moves with its rows. clocked adds a second source whose rows carry nothing but a time: they move
the watermark and never reach the state, so that timers also fire when the log is silent or has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.oplog import FINISHED, TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIMITED = "user_id bigint, event_id bigint, us bigint, accepted boolean, retry_after double"
BROKEN = "site string, event_id bigint, us bigint, failures bigint, status string"
SWEPT = "request_id bigint, kind string, run_id string, state string, previous_state string, us bigint"
MOVED = "request_id bigint, event_id bigint, from_state string, to_state string, verdict string"
ACTED = "key string, request_id bigint, action string, existing_id bigint"
#: Rows of a group of requests in the state of the stale sweep; due is in milliseconds.
CHUNK = pa.schema([("request_id", pa.int64()), ("kind", pa.string()), ("run_id", pa.string()), ("state", pa.string()), ("due", pa.int64())])
#: Rows of a result frame.
SLICE = 10_000


def state_store(spark: SparkSession) -> None:
    """Sets the state store that these jobs need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def clocked(stream: DataFrame, clock: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """stream with the watermark of its own rows and of the times in the parquet folder clock (see tick)."""
    spark = stream.sparkSession
    clock_rows = spark.readStream.schema(f"{ts} timestamp").parquet(clock).withColumn("_clock", F.lit(True))
    both = stream.withColumn("_clock", F.lit(False)).unionByName(clock_rows, allowMissingColumns=True)
    # the condition names ts so that Spark doesn't move it below the watermark, which would then not see the clock
    return both.withWatermark(ts, delay).where(~F.col("_clock") | F.col(ts).isNull()).drop("_clock")


def tick(spark: SparkSession, clock: str, *times: str, ts: str = "ts") -> None:
    """Adds times to a clock; without any it only makes the folder."""
    spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias(ts)).coalesce(1).write.mode("append").parquet(clock)


def _ms(value: float) -> int:
    return int(value * 1000)


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> tuple[np.ndarray, ...]:
    """Microseconds and other columns of a key's rows in order of time, then of the first other column."""
    parts = [(f["us"].to_numpy(), *(f[c].to_numpy() for c in columns)) for f in frames]
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    tie = pd.factorize(cols[1], sort=True)[0] if cols[1].dtype == object else cols[1]
    order = np.lexsort((tie, cols[0]))
    return tuple(c[order] for c in cols)


def _sliced(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for i in range(0, len(frame), SLICE):
        yield frame.iloc[i : i + SLICE]


class _Timed(StatefulProcessor):
    """A processor with one timer per key, whose time is a state variable."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")

    def set_timer(self, at: int, now: int) -> None:
        """The key's timer at a time, at the next watermark if that is over."""
        at = max(at, now + 1)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def admitted(times: list[float], held: list[float], seconds: float, limit: int) -> tuple[list[tuple[bool, float]], list[float]]:
    """Admission of events in order: only admitted ones count in the window. Returns (accepted, retry_after) and the window left."""
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        if len(held) < limit:
            held.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, held[0] + seconds - t))
    return out, held


class RateLimiter(_Timed):
    """State: the window's admitted times, limit at most; the timer empties it when the newest has left the window."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids = _ordered(rows, "event_id")
        held = [h[0] for h in self.held.get()] if self.held.exists() else []
        verdicts, held = admitted((us / 1e6).tolist(), held, self.seconds, self.limit)
        accepted, wait = zip(*verdicts, strict=True)
        if held:
            self.held.put([(h,) for h in held])
            self.set_timer(_ms(held[-1] + self.seconds), timerValues.getCurrentWatermarkInMs())
        yield from _sliced(pd.DataFrame({"user_id": key[0], "event_id": ids, "us": us, "accepted": accepted, "retry_after": wait}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.timer.clear()
        return iter(())


class CircuitBreaker(_Timed):
    """State: the count of failures and the time of the last. The timer ends a cooldown, with a row of its own, or forgets a site long silent."""

    def __init__(self, degraded: int, disabled: int, cooldown: float, keep: float):
        self.degraded, self.disabled, self.cooldown, self.keep = degraded, disabled, cooldown, max(keep, cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n bigint, last double")

    def _rows(self, key, us, ids, counts) -> pd.DataFrame:
        status = ["recovered" if not c else "disabled" if c >= self.disabled else "degraded" if c >= self.degraded else "healthy" for c in counts]
        return pd.DataFrame({"site": key[0], "event_id": pd.array(ids, "Int64"), "us": us, "failures": counts, "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids = _ordered(rows, "event_id")
        n, last = self.count.get() if self.count.exists() else (0, 0.0)
        out: tuple[list, list, list] = ([], [], [])
        for at, event in zip(us.tolist(), ids.tolist(), strict=True):
            t = at / 1e6
            if n >= self.disabled and t - last >= self.cooldown:  # its end lies between two rows of one micro-batch
                n = 0
                for column, value in zip(out, (int((last + self.cooldown) * 1e6), None, 0), strict=True):
                    column.append(value)
            n, last = n + 1, t
            for column, value in zip(out, (at, event, n), strict=True):
                column.append(value)
        self.count.update((n, last))
        self.set_timer(_ms(last + (self.cooldown if n >= self.disabled else self.keep)), timerValues.getCurrentWatermarkInMs())
        yield from _sliced(self._rows(key, np.array(out[0], np.int64), out[1], out[2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.count.get() if self.count.exists() else (0, 0.0)
        self.count.clear()
        self.timer.clear()
        if n >= self.disabled:
            yield self._rows(key, np.array([int((last + self.cooldown) * 1e6)], np.int64), [None], [0])


class StaleSweeper(_Timed):
    """State: what is known of a group of requests, a chunk of rows in order for each micro-batch; the timer, at the earliest time that one of
    them may be stale, fails what has not changed for long and leaves the rest as one chunk. A request alone would take some calls to the
    state store, a millisecond each; a group takes as many."""

    def __init__(self, minutes: float):
        self.us = int(minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.chunks = handle.getListState("chunks", "rows binary")

    def _next(self, rows: pd.DataFrame, now: int) -> None:
        """The timer at the earliest due time of rows, unless it is earlier already."""
        at = max(int(rows["due"].min()), now + 1)
        if not self.timer.exists() or at < self.timer.get()[0]:
            self.set_timer(at, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        batch = pd.concat(rows, ignore_index=True).sort_values(["us", "kind"], kind="stable", ignore_index=True)
        # what comes when its time is over has until the next watermark
        batch["due"] = np.maximum((batch["us"] + self.us) // 1000, now + 1)
        batch = batch[CHUNK.names]
        self.chunks.appendValue((_packed(batch),))
        self._next(batch, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = _known([chunk[0] for chunk in self.chunks.get()])
        # timers fire when the watermark is past their time
        stale = known["at"] <= max(expiredTimerInfo.getExpiryTimeInMs(), now - 1)
        left = known[~stale]
        self.chunks.clear()
        self.timer.clear()
        if len(left):
            self.chunks.put([(_packed(left[CHUNK.names]),)])
            self._next(left.assign(due=left["at"]), now)
        gone = known[stale & known["now"].notna() & ~known["now"].isin(FINISHED)]
        request = gone["kind"] == "request"
        run = (gone["kind"] == "run") & ~gone["state"].isin(FINISHED)
        out = pd.concat([gone[request], gone[request].assign(kind="checkpoint"), gone[run]])
        yield from _sliced(pd.DataFrame({"request_id": out["request_id"], "kind": out["kind"], "run_id": out["run_id"], "state": "FAILED", "previous_state": out["state"], "us": out["at"] * 1000}))


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(rows, CHUNK, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _known(chunks: list[bytes]) -> pd.DataFrame:
    """The last row of each request and of each of its runs, in order, with the request's state now (null without one) and its due time at.

    A run is forgotten when its request is finished at the end of a chunk, the run's own or a later one.
    """
    rows = pd.concat([pa.ipc.open_stream(c).read_all().to_pandas().assign(chunk=i) for i, c in enumerate(chunks)], ignore_index=True)
    requests = rows[rows["kind"] != "run"]
    ends = requests.drop_duplicates(["request_id", "chunk"], keep="last")
    finished = ends[ends["state"].isin(FINISHED)].groupby("request_id")["chunk"].max()
    after = ends[ends["chunk"] > ends["request_id"].map(finished)].groupby("request_id")["chunk"].min()
    # where a request is finished now there is no chunk after
    since = rows["request_id"].map(after).fillna(np.inf).where(rows["request_id"].isin(finished.index), -1)
    rows = rows[(rows["kind"] != "run") | (rows["chunk"] >= since)]
    rows = rows.assign(_run=rows["run_id"].where(rows["kind"] == "run")).drop_duplicates(["request_id", "kind", "_run"], keep="last")
    last = requests.drop_duplicates("request_id", keep="last").set_index("request_id")
    alone = rows.drop_duplicates("request_id", keep="last").set_index("request_id")["due"]
    at = rows["request_id"].map(last["due"]).fillna(rows["request_id"].map(alone)).astype("int64")
    return rows.assign(now=rows["request_id"].map(last["state"]), at=at)


class RequestDeduplicator(_Timed):
    """State: the newest request of an idempotency key and its state; the timer forgets it after keep."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "request_id bigint, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids, states = _ordered(rows, "request_id", "state")
        newest, state = self.newest.get() if self.newest.exists() else (None, None)
        out = []
        for request, change in zip(ids.tolist(), states, strict=True):
            if change is not None:  # a change of state counts for the newest request only
                newest, state = (request, change) if newest is None or request == newest else (newest, state)
                continue
            action = "none" if state is None else "return" if state == "COMPLETED" else "retry" if state == "FAILED" else "attach"
            out.append((request, action, newest))
            if action in ("none", "retry"):
                newest, state = request, "INIT"
        self.newest.update((newest, state))
        self.set_timer(_ms(us[-1] / 1e6 + self.keep), timerValues.getCurrentWatermarkInMs())
        if out:
            requests, actions, existing = zip(*out, strict=True)
            yield from _sliced(pd.DataFrame({"key": key[0], "request_id": requests, "action": actions, "existing_id": pd.array(existing, "Int64")}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.timer.clear()
        return iter(())


class StateMachine(_Timed):
    """State: where a request is; the timer forgets it after keep."""

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids, before, after = _ordered(rows, "event_id", "from_state", "to_state")
        order = np.argsort(ids, kind="stable")  # transitions follow their numbers
        ids, before, after = ids[order], before[order], after[order]
        now = self.now.get()[0] if self.now.exists() else "INIT"
        verdicts = []
        for a, b in zip(before, after, strict=True):
            verdicts.append("STALE" if a != now else "applied" if b in TRANSITIONS.get(a, ()) else "INVALID_TRANSITION")
            now = b if verdicts[-1] == "applied" else now
        self.now.update((now,))
        self.set_timer(_ms(us[-1] / 1e6 + self.keep), timerValues.getCurrentWatermarkInMs())
        yield from _sliced(pd.DataFrame({"request_id": key[0], "event_id": ids, "from_state": before, "to_state": after, "verdict": verdicts}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        self.timer.clear()
        return iter(())


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor's rows, times as timestamps; inside they are microseconds, so that no session's time zone matters."""
    state_store(stream.sparkSession)
    rows = stream.withColumn("us", F.unix_micros("ts")).groupBy(key)
    out = rows.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(*[F.timestamp_micros(c).alias("ts") if c == "us" else c for c in out.columns])


def rate_limit(stream: DataFrame, limit: int = 30, seconds: float = 60) -> DataFrame:
    """Per user and event (user_id, event_id, ts, with a watermark): accepted, or how long to wait; rejected events don't count."""
    return _keyed(stream.select("user_id", "event_id", "ts"), "user_id", RateLimiter(limit, seconds), LIMITED)


def circuit_breaker(stream: DataFrame, degraded: int = 5, disabled: int = 10, cooldown: float = 1800, keep: float = 30 * 86_400) -> DataFrame:
    """Per site and failure (site, event_id, ts, with a watermark) the running count and status; a row without event_id, status recovered, where a cooldown ends."""
    return _keyed(stream.select("site", "event_id", "ts"), "site", CircuitBreaker(degraded, disabled, cooldown, keep), BROKEN)


def failure_report(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(site, window_start, failures) of each width of event time, once the watermark has passed it; stream has a watermark on ts."""
    return stream.groupBy(F.window("ts", width), "site").agg(F.count("*").alias("failures")).select("site", F.col("window.start").alias("window_start"), "failures")


def sweep_stale(stream: DataFrame, minutes: float = 10, groups: int = 1024) -> DataFrame:
    """Requests without a change for minutes: rows request, checkpoint and, for each unfinished site run, run, all to be FAILED.

    stream: request_id, kind (request or run), run_id, state, ts, with a watermark. Finished requests are forgotten after as long.
    groups: how many groups of requests share a timer and a state; a group's rows of a micro-batch are held at once.
    """
    grouped = stream.select(F.pmod(F.xxhash64("request_id"), F.lit(groups)).alias("_group"), "request_id", "kind", "run_id", "state", "ts")
    return _keyed(grouped, "_group", StaleSweeper(minutes), SWEPT)


def apply_transitions(stream: DataFrame, keep: float = 30 * 86_400) -> DataFrame:
    """Folds ordered transitions (request_id, event_id, ts, from_state, to_state, with a watermark): applied, STALE if the request is elsewhere, INVALID_TRANSITION."""
    return _keyed(stream.select("request_id", "event_id", "ts", "from_state", "to_state"), "request_id", StateMachine(keep), MOVED)


def request_actions(stream: DataFrame, keep: float = 86_400) -> DataFrame:
    """none, retry, return or attach for each request by the newest one of its key, with that one's id.

    stream: key, request_id, state (null for a new request, else a change of state), ts, with a watermark. A request that is new or a retry
    becomes the newest of its key.
    """
    return _keyed(stream.select("key", "request_id", "state", "ts"), "key", RequestDeduplicator(keep), ACTED)

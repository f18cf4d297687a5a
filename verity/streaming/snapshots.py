"""Streams of tool-call snapshots and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verity.plans.runner import Scorer, score

TERMINAL = ("completed", "failed")
CALL = "traj string, tool_call_id string, title string, status string, snapshots long"


def finished_calls(snapshots: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """One row per call when its terminal snapshot arrives: the newest non-empty title, the status and
    how many snapshots there were. ``snapshots``: traj, tool_call_id, idx, title, status. State is
    kept by call and dropped at the end of it; snapshots after the end begin a new call. With
    ``idle_ms`` a call without a snapshot for so long (of processing time) is given up with status
    ``unfinished``, so calls that never end keep no state; such a stream has a batch at every trigger and
    does not end by itself."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        title, n = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, title, "unfinished", n)], columns=["traj", "tool_call_id", "title", "status", "snapshots"])
            return
        done: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values("idx")
        for one in rows.itertuples():
            title, n = one.title or title, n + 1
            if one.status in TERMINAL:
                done.append((*key, title, one.status, n))
                title, n = "", 0
        if n:
            state.update((title, n))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["traj", "tool_call_id", "title", "status", "snapshots"])

    return snapshots.groupBy("traj", "tool_call_id").applyInPandasWithState(step, CALL, "title string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


SESSION = "traj string, tool_call_id string, title string, status string, snapshots long, begun timestamp, ended timestamp"
UNFINISHED = "unfinished"


class CallSessions(StatefulProcessor):
    """State of one call: its open session, and the greatest place that was seen. A timer in event time
    gives a session up that hears nothing for ``idle_ms``, and forgets the call when it has ended."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "title string, n long, begun timestamp, ended timestamp, last long")

    def _given_up(self, key: tuple, state: tuple) -> tuple:
        return (*key, state[0], UNFINISHED, state[1], state[2], state[3])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        title, n, begun, ended, last = self.call.get() if self.call.exists() else ("", 0, None, None, None)
        done = []
        for one in pd.concat(list(rows)).sort_values(["idx", "ts"]).itertuples():
            if last is not None and one.idx <= last:
                continue  # told before
            at = one.ts.to_pydatetime()
            if n and (at - ended).total_seconds() * 1000 > self.idle_ms:
                done.append(self._given_up(key, (title, n, begun, ended)))
                title, n, begun = "", 0, None
            title, n, begun, ended, last = one.title or title, n + 1, begun or at, at, one.idx
            if one.status in TERMINAL:
                done.append((*key, title, one.status, n, begun, ended))
                title, n, begun = "", 0, None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.call.update((title, n, begun, ended, last))
        self.handle.registerTimer(int(ended.timestamp() * 1000) + self.idle_ms)
        yield self._frame(done)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        state = self.call.get()
        self.call.clear()
        yield self._frame([self._given_up(key, state)] if state[1] else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SESSION.split(", ")])

    def close(self) -> None:
        pass


def call_sessions(snapshots: DataFrame, idle_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """One row per session of a call, as it ends: title, status, snapshots, begun, ended. ``snapshots``:
    traj, tool_call_id, idx, title, status, ts.

    A session goes from a call's first snapshot to its terminal one, or is ``unfinished`` after
    ``idle_ms`` without one; later snapshots begin the next session. A snapshot whose place was seen is
    a repetition and not counted; what comes after the watermark (``late``) is dropped. The state of a
    call is one row, and goes when its timer ends. The stream needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). ``call_sessions_of`` has the same of a table.
    """
    timed = snapshots.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("traj", "tool_call_id").transformWithStateInPandas(CallSessions(idle_ms), outputStructType=SESSION, outputMode="append", timeMode="eventTime")


def call_sessions_of(snapshots: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """The sessions of ``call_sessions`` in a table of snapshots that is complete."""
    own = Window.partitionBy("traj", "tool_call_id")
    fresh = snapshots.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_again", F.row_number().over(Window.partitionBy("traj", "tool_call_id", "idx").orderBy("ts"))).where("_again = 1")
    order = own.orderBy("idx")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > idle_ms * 1000
    begins = F.coalesce(F.lag("status").over(order).isin(*TERMINAL), F.lit(True)) | F.coalesce(gap, F.lit(False))
    numbered = fresh.withColumn("_begins", begins.cast("int")).withColumn("_session", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    newest = F.max_by(F.nullif("title", F.lit("")), F.when(F.coalesce("title", F.lit("")) != "", F.col("idx")))
    last = F.max_by("status", "idx")
    told = numbered.groupBy("traj", "tool_call_id", "_session").agg(F.coalesce(newest, F.lit("")).alias("title"), F.when(last.isin(*TERMINAL), last).otherwise(UNFINISHED).alias("status"), F.count(F.lit(1)).alias("snapshots"), F.min_by("ts", "idx").alias("begun"), F.max_by("ts", "idx").alias("ended"))
    return told.drop("_session")


def event_windows(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and values of events by type in tumbling windows, closed by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")


def event_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events by a gap in time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def score_increments(rows: DataFrame, make: Callable[[], Scorer], path: str, checkpoint: str) -> StreamingQuery:
    """Score the rows that have arrived since the last call, add outputs and failures (``error``) to the
    Parquet files under ``path``, and stop. The checkpoint knows what was scored, so a call that is
    repeated or was broken off scores nothing twice."""
    scored = score(rows, make)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

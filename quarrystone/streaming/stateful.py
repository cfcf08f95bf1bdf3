"""Keyed state of several variables with timers: the end of a task's log, and executors that fall silent.

Both run on `transformWithState`. State of a key is dropped by an event-time timer, so it does not grow with the keys
ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LogEnd(StatefulProcessor):
    """Which numbers of a task's log are missing, as a set of intervals that shrinks as late chunks come.

    The log is complete when the last chunk has come and no number before it is missing. A complete log is announced once; its
    intervals go at once, and a mark that keeps repeats quiet goes `keep_ms` after the last chunk.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gaps = handle.getMapState("gaps", "first long", "last long")
        self.seen = handle.getValueState("seen", "next long, end long, done boolean, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ahead, end, done, timer = self.seen.get() if self.seen.exists() else (0, None, False, None)
        gaps = {k[0]: v[0] for k, v in self.gaps.iterator()} if not done else {}
        latest = None
        for batch in rows:
            for n, last, at in zip(batch["sequence"].tolist(), batch["is_last"].tolist(), batch["at"].tolist()):
                latest = at if latest is None or at > latest else latest
                if done or pd.isna(n):
                    continue
                n = int(n)
                if last is True:
                    end = n
                if n >= ahead:
                    if n > ahead:
                        gaps[ahead] = n - 1
                    ahead = n + 1
                    continue
                first = max((g for g in gaps if g <= n), default=None)
                if first is not None and n <= gaps[first]:
                    stop = gaps.pop(first)
                    if first < n:
                        gaps[first] = n - 1
                    if n < stop:
                        gaps[n + 1] = stop
        quiet = done
        missing = sum(b - a + 1 for a, b in gaps.items()) if end is None else sum(min(b, end) - a + 1 for a, b in gaps.items() if a <= end)
        done = done or (end is not None and not missing)
        self.gaps.clear()
        if not done:
            for first, stop in gaps.items():
                self.gaps.updateValue((first,), (stop,))
        when = max(latest.value // 1_000_000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if timer is None or when > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(when)
            timer = when
        self.seen.update((ahead, end, done, timer))
        if not quiet:
            yield pd.DataFrame({"task_id": [key[0]], "complete": [done], "ended": [end is not None], "missing": [missing]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.gaps.clear()
        self.seen.clear()
        return iter([])


def log_progress(chunks: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """(task_id, complete, ended, missing) whenever chunks of a task arrive. chunks: (task_id string, sequence, is_last, at), a stream.

    `ended` says that the last chunk has come, `missing` how many numbers before it (or before the highest so far) have not. A
    task that is silent for `keep_ms` is forgotten, complete or not.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = chunks.select("task_id", "sequence", "is_last", "at").withWatermark("at", late)
    return rows.groupBy("task_id").transformWithStateInPandas(LogEnd(keep_ms), "task_id string, complete boolean, ended boolean, missing long", "Update", "EventTime")


class Liveness(StatefulProcessor):
    """An executor's status and metrics; a timer at the timeout behind its last heartbeat takes it offline and clears the metrics."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, last long, timer long")
        self.metrics = handle.getValueState("metrics", "cpu double, memory double")

    def _row(self, key, status, last, cpu, memory) -> pd.DataFrame:
        return pd.DataFrame({"executor_id": [key[0]], "status": [status], "last_ms": [last], "cpu": pd.Series([cpu], dtype="float64"), "memory": pd.Series([memory], dtype="float64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last, timer = self.status.get() if self.status.exists() else (None, None, None)
        cpu, memory = self.metrics.get() if self.metrics.exists() else (None, None)
        beats = pd.concat(list(rows)).sort_values(["at", "status", "cpu", "memory"])
        newest = beats.iloc[-1]
        at = newest["at"].value // 1_000_000
        if last is None or at >= last:  # an older heartbeat changes nothing
            said = newest["status"]
            status = "READY" if said in (None, "REGISTERED", "OFFLINE") else said
            last, cpu, memory = at, *(None if pd.isna(newest[c]) else float(newest[c]) for c in ("cpu", "memory"))
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(last + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
            self.status.update((status, last, timer))
            self.metrics.update((cpu, memory))
        yield self._row(key, status, last, cpu, memory)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.status.get()[1]
        self.status.clear()
        self.metrics.clear()
        yield self._row(key, "OFFLINE", last, None, None)


def executors(beats: DataFrame, late: str = "1 minute", timeout_ms: int = 120_000) -> DataFrame:
    """(executor_id, status, last_ms, cpu, memory): the newest heartbeat of each executor, OFFLINE without metrics `timeout_ms` after it (event time).

    beats: (executor_id string, status, cpu, memory, at), a stream.
    """
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = beats.select("executor_id", "status", "cpu", "memory", "at").withWatermark("at", late)
    return rows.groupBy("executor_id").transformWithStateInPandas(Liveness(timeout_ms), "executor_id string, status string, last_ms long, cpu double, memory double", "Update", "EventTime")


class AsOf(StatefulProcessor):
    """Chunks judged by the assignment that held at their event time.

    Chunks wait until the watermark has passed them, as an assignment may come after a chunk that it concerns; of
    assignments those that can still hold for a waiting or coming chunk are kept.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, executor_id string, sequence long, stream string")
        self.held = handle.getListState("held", "at long, executor_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks, given, last = [], [], 0
        for batch in rows:
            for at, kind, executor, sequence, stream in zip(batch["at"], batch["kind"], batch["executor_id"], batch["sequence"], batch["stream"]):
                us = at.value // 1000
                last = max(last, us)
                if kind == "assignment":
                    given.append((us, executor))
                elif not pd.isna(sequence):
                    chunks.append((us, executor, int(sequence), stream or "stdout"))
        for state, fresh in ((self.waiting, chunks), (self.held, given)):
            if fresh:
                state.appendList(fresh)
        if last:
            now = timerValues.getCurrentWatermarkInMs()
            self.handle.registerTimer(max(last // 1000 + 1, now + 1))
            self.handle.registerTimer(max(last // 1000 + self.keep_ms, now + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.held.get(), key=lambda h: (h[0], h[1] or ""))
        ready, later, out = [], [], []
        for c in self.waiting.get():
            (ready if c[0] <= now else later).append(c)
        for at, executor, sequence, stream in sorted(ready, key=lambda c: (c[0], c[2])):
            before = [e for t, e in held if t <= at]
            out.append((key[0], sequence, stream, bool(before) and executor is not None and before[-1] == executor))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        past = [h for h in held if h[0] <= now]
        stay = past[-1:] + [h for h in held if h[0] > now]
        self.held.clear()
        if not later and past and expiredTimerInfo.getExpiryTimeInMs() >= past[-1][0] // 1000 + self.keep_ms and len(stay) == 1:
            stay = []  # silent for so long that the task is forgotten
        if stay:
            self.held.put(stay)
        yield pd.DataFrame(out, columns=["task_id", "sequence", "stream", "authorized"])


def authorized_as_of(chunks: DataFrame, assignments: DataFrame, late: str = "1 hour", keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """(task_id, sequence, stream, authorized): whether the sending executor had the task when a chunk was sent.

    chunks: (task_id string, executor_id string, sequence, stream, at); assignments: (task_id, executor_id, at), a task being its
    executor's from `at` to the next one; both streams. A null executor takes the task away. A chunk is judged once the
    watermark, `late` behind the newest row of either, has passed it; of assignments of one time the last by executor id holds. A task without a row for
    `keep_ms` is forgotten.
    """
    from pyspark.sql import functions as F

    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    sent = chunks.select("task_id", F.lit("chunk").alias("kind"), "executor_id", F.col("sequence").cast("long").alias("sequence"), "stream", "at")
    given = assignments.select("task_id", F.lit("assignment").alias("kind"), "executor_id", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("stream"), "at")
    rows = sent.unionByName(given).withWatermark("at", late)
    return rows.groupBy("task_id").transformWithStateInPandas(AsOf(keep_ms), "task_id string, sequence long, stream string, authorized boolean", "Append", "EventTime")

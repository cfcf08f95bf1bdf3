"""Streaming operators: DataFrame in, DataFrame out, for a stream or, where no state is kept, for a batch too.

State processors keep one small tuple per key through `applyInPandasWithState`, and drop it by event-time timeouts. Sources without an event-time type are cast to `timestamp` before a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone.functions import expr as X

#: Stage plans (fixed values): SCA tasks prepare no rules.
PLAN = ("SOURCE_PREPARE", "RULES_PREPARE", "SCAN_EXEC", "RESULT_PROCESS", "RESULT_REVIEW")
SCA_PLAN = tuple(s for s in PLAN if s != "RULES_PREPARE")

EVENT = "event_id STRING, tenant_id STRING, event STRING, correlation_id STRING, payload STRUCT<task_id: STRING, stage_id: STRING, type: STRING, status: STRING>, created_at TIMESTAMP"
MESSAGE = "type STRING, executor_id STRING, task_id STRING, sequence LONG, stream STRING, content STRING, is_last BOOLEAN, level STRING, status STRING, ts TIMESTAMP"


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str = EVENT) -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return decoded(raw, schema)


def decoded(raw: DataFrame, schema: str = EVENT, value: str = "value") -> DataFrame:
    """Messages as columns; what is not JSON is dropped."""
    text = F.col(value).cast("string")
    return raw.select(F.from_json(text, schema).alias("_m")).where(F.col("_m").isNotNull() & F.try_parse_json(text).isNotNull()).select("_m.*")


def undecoded(raw: DataFrame, value: str = "value") -> DataFrame:
    """The messages `decoded` drops, for a side table."""
    return raw.where(F.try_parse_json(F.col(value).cast("string")).isNull())


def as_messages(events: DataFrame, key: str = "correlation_id") -> DataFrame:
    """(key, value) for a Kafka sink."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish_once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each event id once; repeats within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def by_type(messages: DataFrame) -> dict[str, DataFrame]:
    """The known kinds of agent messages; others are ignored."""
    return {t: messages.where(F.col("type") == t) for t in ("register", "heartbeat", "log_chunk", "task_result")}


def log_chunks(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Chunks of tasks that exist and belong to the sending executor; the stream defaults to stdout, bad ids go."""
    own = tasks.select("task_id", "executor_id").distinct()
    return messages.where(F.col("task_id").isNotNull() & F.col("sequence").isNotNull()).join(own, ["task_id", "executor_id"]).withColumn("stream", F.coalesce("stream", F.lit("stdout")))


def stage_events(stages: DataFrame) -> DataFrame:
    """The event each stage status announces, and whether the task fails with it."""
    return stages.withColumn("event", X.stage_event(F.col("status"))).withColumn("task_failed", F.col("status") == "FAILED")


def trend(events: DataFrame, at: str, kind: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(day, kind, n): the daily trend as a windowed stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def task_states(events: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """(task_id, position, status) whenever events of a task arrive: its place in the plan, and RUNNING, SUCCEEDED or FAILED.

    events: (task_id, task_type, stage_id, stage_type, event, status, at). Success and skipping move on, failure ends
    the task; a StageUpdated counts only when it skips. An event of another stage than the plan expects is
    ignored; events of one batch are taken in order of time, those more than `late` behind the newest one do not count.
    A finished task's outcome is kept for `keep_ms` after its last event, so that stragglers do not start it anew, and is
    then dropped. Plan
    positions depend on each other, so a task's few events that can count are stepped through one by one; what an event
    can do is worked out before, as one number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, status = state.get if state.exists else (0, "RUNNING")
        last, moves = None, []
        for rows in batches:
            times, can = rows["at"].to_numpy("datetime64[ns]").view("int64"), rows["move"].to_numpy()
            last = int(times.max()) if last is None else max(last, int(times.max()))
            (counts,) = (can >= 0).nonzero()
            if status == "RUNNING" and len(counts):
                ids = rows["stage_id"].to_numpy()
                moves += [(times[i], ids[i] is None, ids[i] or "", can[i]) for i in counts]
        moves.sort(key=lambda m: m[:3])
        for *_, move in moves:
            place, does = divmod(int(move), 4)
            if status != "RUNNING" or place != at:
                continue
            if does == FAIL:
                status = "FAILED"
            else:
                at, status = at + 1, "SUCCEEDED" if does == END else status
        state.update((at, status))
        if status != "RUNNING":
            state.setTimeoutTimestamp(max(last // 1_000_000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [key[0]], "position": [at], "status": [status]})

    rows = events.withWatermark("at", late).select("task_id", "stage_id", "at", _move().alias("move"))
    return rows.groupBy("task_id").applyInPandasWithState(step, "task_id string, position int, status string", "position int, status string", "update", GroupStateTimeout.EventTimeTimeout)


NEXT, END, FAIL = 0, 1, 2


def _move() -> Column:
    """What an event does where the plan expects its stage: four times the stage's place, and NEXT, END or FAIL; -1 if it can do nothing."""

    def of(plan: tuple[str, ...]) -> Column:
        place = F.array_position(F.array(*map(F.lit, plan)), F.col("stage_type")).cast("int") - 1
        does = F.when(F.col("status") == "FAILED", FAIL).when(F.col("status").isin("SUCCEEDED", "SKIPPED"), F.when(place == len(plan) - 1, END).otherwise(NEXT))
        return F.when(place >= 0, place * 4 + does)

    idle = F.coalesce(F.col("event") == "StageUpdated", F.lit(False)) & ~F.coalesce(F.col("status") == "SKIPPED", F.lit(False))
    return F.coalesce(F.when(~idle, F.when(F.col("task_type") == "SCA_CHECK", of(SCA_PLAN)).otherwise(of(PLAN))), F.lit(-1))


def liveness(beats: DataFrame, timeout_ms: int = 120_000) -> DataFrame:
    """(executor_id, status, last_ms): READY on the first heartbeat or after OFFLINE, OFFLINE `timeout_ms` after the last (event time).

    beats: (executor_id, status, at) with a watermark on `at`.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[1]
            state.remove()
            yield pd.DataFrame({"executor_id": [key[0]], "status": ["OFFLINE"], "last_ms": [last]})
            return
        rows = pd.concat(list(batches))
        last = max([rows["at"].max().value // 1_000_000, *([state.get[1]] if state.exists else [])])
        said = rows.sort_values("at")["status"].iloc[-1]
        status = "READY" if said in (None, "REGISTERED", "OFFLINE") else said
        state.update((status, last))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"executor_id": [key[0]], "status": [status], "last_ms": [last]})

    return beats.groupBy("executor_id").applyInPandasWithState(step, "executor_id string, status string, last_ms long", "status string, last_ms long", "update", GroupStateTimeout.EventTimeTimeout)


def log_ends(chunks: DataFrame) -> DataFrame:
    """(task_id, complete, missing): whether the last chunk of a task came, and how many numbers before it did not."""
    per = chunks.groupBy("task_id").agg(F.max(F.when(F.col("is_last"), F.col("sequence"))).alias("_end"), F.count_distinct("sequence").alias("_n"))
    return per.select("task_id", F.col("_end").isNotNull().alias("complete"), (F.col("_end") + 1 - F.col("_n")).alias("missing"))


def late_rows(events: DataFrame, at: str, cursor) -> DataFrame:
    """Events before the cursor: what a cursor-based reader would never see."""
    return events.where(F.col(at) < F.lit(cursor))


def run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off all there is, in micro-batches that restart where they stopped."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str = "5 seconds", mode: str = "append"):
    """The event loop: a micro-batch each `every`; the checkpoint is its cursor."""
    return df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

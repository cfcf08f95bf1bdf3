"""Streaming queries: the events table is read as a file stream and worked off to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.plans.registry import query, table
from quarrystone.storage import shared_dir, stored
from quarrystone.streaming import agents, jobs, outbox, stateful


def stream(spark, d, name="events"):
    """The table as a stream. A file stream reads folders, so the file is matched by a glob in its folder."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{name}*")


def finished(df, keys=None, order=None, mode="append"):
    """All output of a stream as a table; with keys, of rows with one key the last in the order."""
    spark = df.sparkSession
    path = shared_dir(spark, "stream")
    jobs.run_once(df, shared_dir(spark, "stream-cursor"), lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(path), mode)
    out = spark.read.parquet(path)
    if keys:
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "_batch").alias("s")).select(*keys, "s.*")
    return out.drop("_batch")


@query("k5_publish_once", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'signup'")
def k5(spark, d):
    e = stream(spark, d).where("event_type = 'signup'").withColumn("at", F.col("ts").cast("timestamp"))
    return finished(jobs.publish_once(e.select("user_id", "event_type", "at"), "user_id", "at", "40 days")).select("user_id", "event_type")


@query("k6_stage_events", "SELECT event_id, CASE event_type WHEN 'view' THEN 'StageStarted' WHEN 'purchase' THEN 'StageCompleted' WHEN 'error' THEN 'StageFailed' ELSE 'StageUpdated' END AS event FROM events")
def k6(spark, d):
    status = F.when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED").otherwise("PENDING")
    return finished(jobs.stage_events(stream(spark, d).withColumn("status", status)).select("event_id", "event"))


@query("k4_authorized_chunks", "SELECT event_id AS sequence, 'stdout' AS stream FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey = event_id % 5")
def k4(spark, d):
    m = stream(spark, d).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("sequence"), (F.col("event_id") % 5).cast("int").alias("executor_id"), F.lit(None).cast("string").alias("stream"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("executor_id"))
    return finished(jobs.log_chunks(m, t)).select("sequence", "stream")


@query("k4_authorized_as_of", """WITH a AS (SELECT user_id, ts, max(CAST(event_id % 3 AS VARCHAR)) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT CAST(c.user_id AS VARCHAR) AS task_id, c.event_id AS sequence, coalesce(CAST(c.event_id % 3 AS VARCHAR) = a.x, FALSE) AS authorized FROM events c ASOF LEFT JOIN a ON c.user_id = a.user_id AND c.ts >= a.ts WHERE c.event_type = 'view'""")
def k4_as_of(spark, d):
    """Purchases hand a user's task to one of three executors, views are the chunks these send; the rows far behind the last event close the stream."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')")
    rows = e.select(F.col("user_id").cast("string").alias("task_id"), F.when(F.col("event_type") == "view", "chunk").otherwise("assignment").alias("kind"), (F.col("event_id") % 3).cast("string").alias("executor_id"), F.col("event_id").cast("long").alias("sequence"), F.lit(None).cast("string").alias("stream"), F.col("ts").cast("timestamp").alias("at"))
    later = lambda years: rows.limit(1).select(F.lit("end").alias("task_id"), F.lit("assignment").alias("kind"), "executor_id", "sequence", "stream", F.make_timestamp(F.year("at") + years, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))
    job = lambda s: stateful.authorized_as_of(s.where("kind = 'chunk'"), s.where("kind = 'assignment'"), "1 day")
    return arrived(spark, [rows, later(1), later(2)], job, ["task_id", "sequence"], "append").drop("stream")


@query("k10_trend_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def k10(spark, d):
    out = finished(jobs.trend(stream(spark, d), "ts", "event_type"), ["day", "event_type"], mode="update")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


_K2 = """WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE event_type <> 'view'),
  s AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN n END) AS bad FROM o GROUP BY user_id)
  SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(least(coalesce(bad, 99), 5, (SELECT count(*) FROM o WHERE o.user_id = s.user_id)) AS INT) AS position,
         CASE WHEN bad < 5 THEN 'FAILED' WHEN (SELECT count(*) FROM o WHERE o.user_id = s.user_id) >= 5 THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status FROM s"""


@query("k2_task_states", _K2)
def k2(spark, d):
    """Every event of a user but views is a stage event of its task, for the stage that its place among them names."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, d, "events").where("event_type <> 'view'").withColumn("n", n)
    e = e.select(F.col("user_id").cast("string").alias("task_id"), F.lit("CODE_CHECK").alias("task_type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("stage_id"),
                 F.get(F.array(*map(F.lit, jobs.PLAN)), F.col("n")).alias("stage_type"), F.lit("StageCompleted").alias("event"),
                 F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCEEDED").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    # a task's events come in three batches, by their place among them, the state carried over in between
    third = F.least(F.floor((F.to_number(F.date_format("at", "dd"), F.lit("99")) - 1) / 10), F.lit(2))
    e = stored(e.withColumn("_third", third.cast("int")), "task-events", "_third")  # numbered once, not once a batch
    steps = [e.where(F.col("_third") == k).drop("_third") for k in range(3)]
    return arrived(spark, steps, lambda s: jobs.task_states(s, "60 days"), ["task_id"])


def arrived(spark, steps, job, keys, mode="update"):
    """A stream whose input arrives in steps, each worked off before the next: the last row of each key."""
    source, cursor, path = (shared_dir(spark, f"stream-{x}") for x in ("steps", "cursor", "out"))
    for rows in steps:
        rows.write.mode("append").parquet(source)
        s = spark.readStream.schema(rows.schema).parquet(source)
        jobs.run_once(job(s), cursor, lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(path), mode)
    out = spark.read.parquet(path)
    return out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keys]), "_batch").alias("s")).select(*keys, "s.*").drop("_batch")


@query("k3_liveness", "SELECT CAST(user_id AS VARCHAR) AS executor_id, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY user_id")
def k3(spark, d):
    b = stream(spark, d).select(F.col("user_id").cast("string").alias("executor_id"), F.lit("REGISTERED").alias("status"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", "60 days")
    return finished(jobs.liveness(b), ["executor_id"], mode="update").select("executor_id", F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd HH:mm").alias("last"))


@query("k3_offline", "SELECT CAST(user_id AS VARCHAR) AS executor_id, 'OFFLINE' AS status, strftime(max(ts), '%Y-%m-%d %H:%M') AS last FROM events GROUP BY user_id")
def k3_offline(spark, d):
    """Long after the last event every executor has gone offline; what says so is the time of one that still beats."""
    b = table(spark, d, "events").select(F.col("user_id").cast("string").alias("executor_id"), F.lit("REGISTERED").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    later = lambda years: b.limit(1).select(F.lit("still-here").alias("executor_id"), "status", F.make_timestamp(F.year("at") + years, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))
    out = arrived(spark, [b, later(1), later(2)], lambda s: jobs.liveness(s.withWatermark("at", "1 day")), ["executor_id"])
    return out.where("executor_id <> 'still-here'").select("executor_id", "status", F.date_format(F.timestamp_millis("last_ms"), "yyyy-MM-dd HH:mm").alias("last"))


@query("k8_log_ends", "SELECT conv_id AS task_id, TRUE AS complete, max(turn) + 1 - count(DISTINCT turn) AS missing FROM conversations GROUP BY conv_id")
def k8(spark, d):
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("end"))
    return jobs.log_ends(c.join(last, "conv_id").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("sequence"), (F.col("turn") == F.col("end")).alias("is_last")))


@query("k8_log_progress", "SELECT CAST(conv_id AS VARCHAR) AS task_id, count(DISTINCT turn) = max(turn) + 1 AS complete, TRUE AS ended, max(turn) + 1 - count(DISTINCT turn) AS missing FROM conversations WHERE NOT (conv_id % 7 = 3 AND turn = 1) GROUP BY conv_id HAVING max(turn) IS NOT NULL")
def k8_progress(spark, d):
    """Turns as chunks that come in three steps, out of order; of some tasks one chunk never comes."""
    c = table(spark, d, "conversations").where("not (conv_id % 7 = 3 and turn = 1) and turn is not null")
    c = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("end")), "conv_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn"))
    rows = c.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("sequence"), (F.col("turn") == F.col("end")).alias("is_last"), at.alias("at"))
    return arrived(spark, [rows.where(F.pmod(F.col("sequence") * 5, F.lit(3)) == k) for k in range(3)], stateful.log_progress, ["task_id"])


@query("k3_cleared_metrics", "SELECT CAST(user_id AS VARCHAR) AS executor_id, 'OFFLINE' AS status, epoch_us(max(ts)) // 1000 AS last_ms, CAST(NULL AS DOUBLE) AS cpu FROM events GROUP BY user_id")
def k3_metrics(spark, d):
    """Heartbeats with metrics; long after the last one every executor is offline and has none."""
    b = table(spark, d, "events").select(F.col("user_id").cast("string").alias("executor_id"), F.lit("READY").alias("status"), F.col("value").cast("double").alias("cpu"), F.lit(1.0).alias("memory"), F.col("ts").cast("timestamp").alias("at"))
    later = lambda years: b.limit(1).select(F.lit("still-here").alias("executor_id"), "status", "cpu", "memory", F.make_timestamp(F.year("at") + years, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))
    out = arrived(spark, [b, later(1), later(2)], lambda s: stateful.executors(s, "1 day"), ["executor_id"])
    return out.where("executor_id <> 'still-here'").select("executor_id", "status", "last_ms", "cpu")


@query("k1_outbox_loop", "SELECT event_id, event_type AS event FROM events WHERE event_type <> 'view'")
def k1_outbox(spark, d):
    """All events through an outbox, in batches in the order of time, each written once."""
    source, cursor, path = (shared_dir(spark, f"outbox-{x}") for x in ("table", "cursor", "out"))
    schema = "event_id long, event string, status string, created_at timestamp"
    e = table(spark, d, "events").select(F.col("event_id").cast("long").alias("event_id"), F.col("event_type").alias("event"), F.when(F.col("event_type") == "view", "PROCESSED").otherwise("PENDING").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    e.write.parquet(source)
    outbox.run_idle(outbox.outbox(spark, source, schema, limit=50_000), cursor, outbox.write_once(path))
    return outbox.written(spark, path, schema).select("event_id", "event")


@query("k9_late_events", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00'")
def k9(spark, d):
    return finished(jobs.late_rows(stream(spark, d), "ts", "2024-01-03 00:00:00").select("event_id"))


@query("a12_decoded_messages", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS event FROM events WHERE event_id % 10 <> 0")
def a12(spark, d):
    e = stream(spark, d)
    raw = e.select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("event")))).alias("value"))
    return finished(jobs.decoded(raw).select("event_id", "event"))


@query("a13_kafka_messages", "SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM events")
def a13(spark, d):
    out = finished(jobs.as_messages(stream(spark, d).select("event_id", "user_id"), "user_id"))
    return out.select("key", F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


@query("a15_agent_messages", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def a15(spark, d):
    e = table(spark, d, "events").withColumn("type", F.when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "click", "log_chunk").otherwise("unknown"))
    out = None
    for rows in jobs.by_type(e).values():
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@agents.agent("stage-signal")
class StageSignal:
    """Speaks up where an error is worth more than a limit."""

    where = "event_type = 'error'"

    def supports(self, row):
        return row["event_type"] == "error"

    def run(self, row):
        return [("HIGH", f"event {row['event_id']}")] if row["value"] > 50 else []


@query("l1_agents", "SELECT event_id, 'HIGH' AS severity FROM events WHERE event_type = 'error' AND value > 50")
def l1(spark, d):
    return agents.run_agents(table(spark, d, "events").select("event_id", "event_type", "value"), ["stage-signal"], "event_id").select("event_id", "severity")


@query("l2_loaded_agents", "SELECT event_id, 'HIGH' AS severity FROM events WHERE event_type = 'error' AND value > 50")
def l2(spark, d):
    """The same agent, found by the name of its module and class."""
    return agents.run_agents(table(spark, d, "events").select("event_id", "event_type", "value"), ["quarrystone.plans.streams:StageSignal"], "event_id").select("event_id", "severity")


@query("l1_agents_sql", "SELECT event_id, 'HIGH' AS severity FROM events WHERE event_type = 'error' AND value > 50")
def l1_sql(spark, d):
    """The agent as a table function in SQL, a partition for each user."""
    agents.register_sql(spark)
    table(spark, d, "events").createOrReplaceTempView("stage_events")
    return spark.sql("SELECT event_id, severity FROM review_agents(TABLE(SELECT event_id, event_type, value, user_id FROM stage_events) PARTITION BY (user_id), 'event_id', 'quarrystone.plans.streams:StageSignal')")


@query("l3_enriched_code", "SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(length(text) AS VARCHAR) || ' characters' ELSE text END AS code FROM documents")
def l3(spark, d):
    """An enricher for the snippets of one kind of path."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("path"), F.col("text").alias("code"))
    said = (lambda path: path == "en", lambda code: code.map(lambda t: None if t is None else f"{len(t)} characters"))
    return agents.enriched(docs, [said], "path", "code").select("doc_id", "code")

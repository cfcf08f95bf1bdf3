"""Aggregates over the findings model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import kpi as K
from quarrystone.operators import relational as R
from quarrystone.plans.registry import query, table
from quarrystone.plans.views import FINDINGS, RANK, REVIEWS, TASKS, day, findings, reviews, tasks


@query("d1_tasks_by_status", f"WITH {TASKS} SELECT status, count(*) AS n FROM t GROUP BY status")
def d1(spark, d):
    return K.counts(tasks(spark, d), "status")


@query("d2_task_kpis", f"""WITH {TASKS} SELECT project_id, count(*) FILTER (WHERE status = 'RUNNING') AS running,
  count(*) FILTER (WHERE status = 'FAILED' AND coalesce(updated_at, created_at) >= TIMESTAMP '2024-01-29 00:00:00') AS failed_24h,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-23 00:00:00') AS total_window,
  coalesce(round(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-23 00:00:00' AND status = 'SUCCEEDED') / nullif(count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-23 00:00:00' AND status IN ('SUCCEEDED', 'FAILED', 'CANCELED')), 0), 6), 0.0) AS success_rate
  FROM t GROUP BY project_id""")
def d2(spark, d):
    out = K.task_kpis(tasks(spark, d), ["project_id"], "2024-01-23 00:00:00", "2024-01-29 00:00:00")
    return out.withColumn("success_rate", F.round("success_rate", 6))


_SEVS = ", ".join(f"count(*) FILTER (WHERE status IN ('OPEN', 'CONFIRMED') AND severity = '{s}') AS {s.lower()}" for s in X.SEVERITIES)


@query("d3_finding_kpis", f"WITH {FINDINGS} SELECT project_id, count(*) FILTER (WHERE status = 'OPEN') AS open, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, {_SEVS} FROM f GROUP BY project_id")
def d3(spark, d):
    return K.finding_kpis(findings(spark, d), ["project_id"])


def _applied(spark, d):
    r = reviews(spark, d).join(findings(spark, d).select("finding_id", "project_id", F.col("status").alias("status_before")), "finding_id")
    return r.select("project_id", F.when(F.col("review_id") % 2 == 0, "AI").otherwise("HUMAN").alias("review_type"),
                    F.when(F.col("quantity") > 20, F.col("created_at")).alias("applied_at"), "status_before",
                    F.nullif("verdict", F.lit("UNCERTAIN")).alias("status_after"))


@query("d4_review_kpis", f"""WITH {FINDINGS}, {REVIEWS} SELECT project_id, count(*) FILTER (WHERE review_id % 2 = 0 AND quantity <= 20) AS queued,
  count(*) FILTER (WHERE review_id % 2 = 0 AND quantity > 20 AND r.created_at >= TIMESTAMP '1996-01-01 00:00:00') AS completed,
  count(*) FILTER (WHERE review_id % 2 = 0 AND quantity > 20 AND r.created_at >= TIMESTAMP '1996-01-01 00:00:00' AND verdict <> 'UNCERTAIN' AND verdict <> status) AS auto_applied
  FROM r JOIN f USING (finding_id) GROUP BY project_id""")
def d4(spark, d):
    return K.review_kpis(_applied(spark, d), ["project_id"], "1996-01-01 00:00:00")


@query("d5_executors_by_status", "SELECT CASE c_nationkey % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'BUSY' WHEN 2 THEN 'DRAINING' ELSE 'OFFLINE' END AS status, count(*) AS n FROM customer GROUP BY 1")
def d5(spark, d):
    return K.counts(table(spark, d, "customer"), X.mapped(F.col("c_nationkey") % 4, {0: "READY", 1: "BUSY", 2: "DRAINING"}, "OFFLINE").alias("status"))


@query("d6_catalog_counts", "SELECT n_regionkey AS tenant, count(DISTINCT n_nationkey) AS projects, count(c_custkey) AS repositories FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def d6(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.groupBy(F.col("n_regionkey").alias("tenant")).agg(F.count_distinct("n_nationkey").alias("projects"), F.count("c_custkey").alias("repositories"))


@query("d7_by_source_mode", "SELECT upper(split_part(p_type, ' ', 1)) AS mode, count(*) AS n FROM part GROUP BY 1")
def d7(spark, d):
    return K.counts(table(spark, d, "part"), F.upper(F.substring_index("p_type", " ", 1)).alias("mode"))


@query("d8_by_status_and_type", f"WITH {TASKS} SELECT 'status' AS dimension, status AS value, count(*) AS n FROM t GROUP BY status UNION ALL SELECT 'type', type, count(*) FROM t GROUP BY type")
def d8(spark, d):
    return K.by_status_and_type(tasks(spark, d))


@query("d9_project_overview", f"""WITH {FINDINGS}, {TASKS}, a AS (SELECT project_id, count(*) FILTER (WHERE status = 'OPEN') AS open FROM f GROUP BY 1),
  b AS (SELECT project_id, count(*) AS tasks, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM t GROUP BY 1)
  SELECT c_custkey AS project_id, coalesce(open, 0) AS open, coalesce(tasks, 0) AS tasks, coalesce(failed, 0) AS failed FROM customer LEFT JOIN a ON c_custkey = a.project_id LEFT JOIN b ON c_custkey = b.project_id""")
def d9(spark, d):
    a = K.finding_kpis(findings(spark, d), ["project_id"]).select("project_id", "open")
    b = tasks(spark, d).groupBy("project_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    return p.join(a, "project_id", "left").join(b, "project_id", "left").na.fill(0)


@query("d10_daily_trend", """WITH s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day),
  a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS new FROM events WHERE event_type = 'signup' GROUP BY 1),
  b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS closed FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(new, 0) AS new, coalesce(closed, 0) AS closed FROM s LEFT JOIN a USING (day) LEFT JOIN b USING (day)""")
def d10(spark, d):
    return _trend(table(spark, d, "events"))


@query("d10_daily_trend_users", """WITH s AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)),
  e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'signup') AS new, count(*) FILTER (WHERE event_type = 'purchase') AS closed FROM events GROUP BY 1, 2)
  SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(new, 0) AS new, coalesce(closed, 0) AS closed FROM s LEFT JOIN e USING (user_id, day)""")
def d10_users(spark, d):
    return _trend(table(spark, d, "events"), ["user_id"])


def _trend(e, keys=()):
    out = K.daily_trend(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "ts", "ts", "2024-01-01", "2024-02-05", keys, e)
    return out.withColumn("day", day("day"))


@query("d11_worst_severity", f"WITH {FINDINGS} SELECT project_id, arg_max(severity, {RANK}) AS severity FROM f GROUP BY project_id")
def d11(spark, d):
    return K.worst(findings(spark, d), ["project_id"])


@query("d12_best_cvss", """SELECT finding_id, source, score FROM (SELECT l_orderkey AS finding_id, l_linenumber AS source, l_discount AS score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def d12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("source"), F.col("l_partkey").alias("part"), F.col("l_discount").alias("score")).alias("s"))
    best = li.groupBy(F.col("l_orderkey").alias("finding_id")).agg(X.best_cvss(F.array_sort(F.collect_list("s"))).alias("b"))
    return best.select("finding_id", F.col("b.source").alias("source"), F.col("b.score").alias("score"))


@query("d13_next_sequence", "SELECT c_custkey AS task_id, coalesce(max(o_orderkey) + 1, 0) AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def d13(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy(F.col("c_custkey").alias("task_id")).agg(F.coalesce(F.max("o_orderkey") + 1, F.lit(0)).alias("next"))


@query("d14_content_digest", """SELECT p_partkey // 50 AS ruleset, sha256(string_agg(CAST(p_partkey AS VARCHAR) || ':' || p_type || ':' || CAST(p_size AS VARCHAR), '|' ORDER BY CAST(p_partkey AS VARCHAR))) AS digest FROM part GROUP BY 1""")
def d14(spark, d):
    """Rule sets of fifty parts each."""
    return K.content_digest(table(spark, d, "part").withColumn("ruleset", F.expr("p_partkey div 50")), ["ruleset"], "p_partkey", "p_type", "p_size")


@query("d15_languages", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents WHERE lang IS NOT NULL GROUP BY source")
def d15(spark, d):
    rules = table(spark, d, "documents").where("lang is not null").select("source", F.array("lang").alias("langs"))
    return K.languages(rules, ["source"]).withColumn("langs", F.array_join("langs", ","))


@query("d16_review_queue", f"WITH {FINDINGS} SELECT severity, count(*) AS n FROM f WHERE status = 'OPEN' AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') GROUP BY severity")
def d16(spark, d):
    return K.counts(findings(spark, d).where((F.col("status") == "OPEN") & F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM")), "severity")


@query("d17_totals", f"WITH {FINDINGS} SELECT project_id, count(*) AS total FROM f GROUP BY project_id")
def d17(spark, d):
    return K.counts(findings(spark, d), "project_id", name="total")


@query("d18_artifact_bytes", "SELECT source AS task, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def d18(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("task")).agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("d20_graph_statistics", """SELECT count(*) AS edges, count(DISTINCT l_returnflag) AS kinds, 0 AS unresolved,
  (SELECT count(DISTINCT n) FROM (SELECT 's' || l_suppkey AS n FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem)) AS nodes FROM lineitem""")
def d20(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "l_returnflag")
    return K.graph_stats(e, "a", "b", "l_returnflag")


@query("d21_permission_catalog", """SELECT p_brand AS "group", array_to_string(list_sort(list(DISTINCT p_brand || ':' || p_type)), ';') AS permissions FROM part GROUP BY p_brand""")
def d21(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("permission"))
    return K.permission_catalog(p).withColumn("permissions", F.array_join("permissions", ";"))


@query("d22_report_severities", f"WITH {FINDINGS} SELECT project_id, severity, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, finding_id) AS k FROM f) WHERE k <= 200 GROUP BY project_id, severity")
def d22(spark, d):
    f = R.first_n(findings(spark, d), ["project_id"], [F.desc("created_at"), F.col("finding_id")], 200)
    return K.counts(f, "project_id", "severity")


@query("d23_usage_packages", """SELECT key, array_to_string(list_sort(list(DISTINCT key)), ',') AS tokens FROM (SELECT lower(replace(p_name, ' ', '-')) AS key FROM part) WHERE length(key) >= 4 GROUP BY key ORDER BY key LIMIT 200""")
def d23(spark, d):
    v = table(spark, d, "part").select(F.translate("p_name", " ", "-").alias("package"), F.lit(None).cast("string").alias("purl"))
    return K.usage_packages(v).withColumn("tokens", F.array_join("tokens", ","))


@query("d25_source_fingerprint", """SELECT l_orderkey AS project, substr(sha256(string_agg(l_partkey || ':' || l_linenumber, '|' ORDER BY CAST(l_partkey AS VARCHAR), l_partkey || ':' || l_linenumber)), 1, 16) AS fingerprint FROM lineitem GROUP BY l_orderkey""")
def d25(spark, d):
    """A project for each order, its lines as files with a time of change."""
    out = K.content_digest(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_linenumber")
    return out.select(F.col("l_orderkey").alias("project"), F.substring("digest", 1, 16).alias("fingerprint"))


@query("d20_index_statistics", """SELECT (SELECT count(*) FROM (SELECT 'c' || p_partkey FROM part UNION SELECT p_type FROM part)) AS types, count(*) AS edges, count(*) FILTER (WHERE p_size % 2 = 0) AS impl_edges, count(*) FILTER (WHERE p_size % 2 <> 0) AS exte_edges,
  count(*) FILTER (WHERE p_size > 25) AS reads, count(*) FILTER (WHERE p_size <= 25) AS writes, count(DISTINCT p_brand) AS fields, count(*) AS beans, (SELECT count(*) FROM supplier) AS injections, count(*) AS entries, count(*) FILTER (WHERE p_size = 50) AS truncated FROM part""")
def d20_index(spark, d):
    """The statistics of the type, field, bean and points-to indexes side by side: one row each."""
    p = table(spark, d, "part")
    types = K.type_stats(p.select(F.concat(F.lit("c"), "p_partkey").alias("child"), F.col("p_type").alias("parent"), F.when(F.col("p_size") % 2 == 0, "IMPL").otherwise("EXTE").alias("kind")))
    fields = K.field_stats(p.select(F.col("p_brand").alias("field"), F.when(F.col("p_size") > 25, "READ").otherwise("WRITE").alias("kind")))
    sets = K.points_to_stats(p.select(F.col("p_partkey").alias("node"), (F.col("p_size") == 50).alias("truncated")))
    one = [df.withColumn("_row", F.lit(1)) for df in (types, fields, K.bean_stats(p, table(spark, d, "supplier")), sets)]
    return one[0].join(one[1], "_row").join(one[2], "_row").join(one[3], "_row").drop("_row")

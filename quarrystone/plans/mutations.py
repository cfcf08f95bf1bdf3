"""Keyed mutations: one part of a driver's table is the target, another the updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import upsert as U
from quarrystone.operators.snapshots import Snapshot
from quarrystone.plans.registry import query, table
from quarrystone.plans.views import FINDINGS, REVIEWS, day, findings, reviews
from quarrystone.storage import shared_dir


def _stamp(text):
    return F.to_timestamp_ntz(F.lit(text))


NOW = "2025-01-01 00:00:00"


@query("i1_finding_ingest", f"""WITH {FINDINGS}, a AS (SELECT *, severity || (finding_id % 3) AS fp FROM f),
  old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fp, status ORDER BY created_at, finding_id) AS n FROM a WHERE finding_id % 2 = 0) WHERE n = 1 OR status = 'RESOLVED'),
  new AS (SELECT * FROM a WHERE finding_id % 2 = 1),
  live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fp, status ORDER BY created_at, finding_id) AS n FROM new WHERE status <> 'RESOLVED') WHERE n = 1)
  SELECT finding_id, status <> 'RESOLVED' AND EXISTS (SELECT 1 FROM live WHERE live.project_id = old.project_id AND live.fp = old.fp AND live.status = old.status) AS refreshed FROM old
  UNION ALL SELECT finding_id, FALSE FROM live WHERE NOT EXISTS (SELECT 1 FROM old WHERE live.project_id = old.project_id AND live.fp = old.fp AND live.status = old.status)
  UNION ALL SELECT finding_id, FALSE FROM new WHERE status = 'RESOLVED'""")
def i1(spark, d):
    a = findings(spark, d).select("finding_id", "project_id", F.concat("severity", (F.col("finding_id") % 3).cast("string")).alias("fingerprint"), "status", "created_at", F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    even = a.where("finding_id % 2 = 0")
    first = U.ingest_findings(even.where("false"), even, _stamp("2024-01-01 00:00:00"))
    out = U.ingest_findings(first, a.where("finding_id % 2 = 1"), _stamp(NOW))
    return out.select("finding_id", F.col("updated_at").isNotNull().alias("refreshed"))


@query("i2_issue_upsert", """WITH t AS (SELECT p_partkey AS issue_key, p_name AS title, 'OLD' AS status FROM part WHERE p_partkey % 3 <> 0),
  u AS (SELECT l_partkey AS issue_key, max(l_quantity) AS q FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
  SELECT coalesce(t.issue_key, u.issue_key) AS issue_key, CASE WHEN u.issue_key IS NOT NULL THEN 'q' || CAST(q AS INT) ELSE title END AS title, coalesce(t.status, 'OPEN') AS status FROM t FULL JOIN u ON t.issue_key = u.issue_key""")
def i2(spark, d):
    t = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("issue_key"), F.col("p_name").alias("title"), F.lit("OLD").alias("status"))
    u = table(spark, d, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("issue_key"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("title"), F.lit("OPEN").alias("status"), "l_quantity")
    return U.upsert(t, u, ["issue_key"], [F.desc("l_quantity")], keep=["status"])


@query("i2_touched_folders", """WITH t AS (SELECT p_partkey AS issue_key, p_name AS title, 'OLD' AS status FROM part WHERE p_partkey % 3 <> 0),
  u AS (SELECT l_partkey AS issue_key, max(l_quantity) AS q FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
  SELECT coalesce(t.issue_key, u.issue_key) AS issue_key, CASE WHEN u.issue_key IS NOT NULL THEN 'q' || CAST(q AS INT) ELSE title END AS title, coalesce(t.status, 'OPEN') AS status FROM t FULL JOIN u ON t.issue_key = u.issue_key""")
def i2_touched(spark, d):
    """The same upsert on a stored snapshot, of which only the folders that the updates fall into are rewritten."""
    t = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("issue_key"), F.col("p_name").alias("title"), F.lit("OLD").alias("status"))
    u = table(spark, d, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("issue_key"), F.concat(F.lit("q"), F.col("l_quantity").cast("int")).alias("title"), F.lit("OPEN").alias("status"), "l_quantity")
    snapshot = Snapshot(spark, shared_dir(spark, "issues"), t.schema, ["issue_key"], parts=16)
    snapshot.create(t)
    snapshot.mutate(u, lambda rows, new: U.upsert(rows, new, ["issue_key"], [F.desc("l_quantity")], keep=["status"]))
    return snapshot.read()


@query("i3_stage_upsert", """WITH t AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_id % 2 = 0), u AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_id % 2 = 1),
  a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM t GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM u GROUP BY 1)
  SELECT coalesce(a.user_id, b.user_id) AS stage_id, coalesce(b.s, a.s) AS status FROM a FULL JOIN b ON a.user_id = b.user_id""")
def i3(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stage_id"), F.col("event_type").alias("status"), "ts", "event_id")
    order = [F.desc("ts"), F.desc("event_id")]
    empty = e.where("false").select("stage_id", "status")
    first = U.upsert(empty, e.where("event_id % 2 = 0"), ["stage_id"], order)
    return U.upsert(first, e.where("event_id % 2 = 1"), ["stage_id"], order)


@query("i4_baseline_replace", "SELECT DISTINCT l_suppkey AS project, l_partkey AS fingerprint FROM lineitem WHERE (l_suppkey % 2 = 0 AND l_returnflag = 'R') OR (l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0 AND l_returnflag = 'R') AND l_returnflag = 'A')")
def i4(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("fingerprint"), "l_returnflag")
    old, new = li.where("l_returnflag = 'A'").select("project", "fingerprint").distinct(), li.where("l_returnflag = 'R' and project % 2 = 0")
    return U.replace_sets(old, new.select("project", "fingerprint"), ["project"])


@query("i5_insert_missing", "SELECT user_id AS id, 'old' AS origin FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'view') UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view')")
def i5(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_type = 'view'").select(F.col("user_id").alias("id")).distinct().withColumn("origin", F.lit("old"))
    new = e.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.lit("new").alias("origin"), "event_id")
    return U.insert_missing(old, new, ["id"], [F.col("event_id")])


@query("i6_bulk_status", f"WITH {FINDINGS} SELECT finding_id, status AS status_before, 'RESOLVED' AS status_after, 'u' || project_id AS reviewer FROM f WHERE price > 200000")
def i6(spark, d):
    f = findings(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    changes = f.where("price > 200000").select("finding_id", F.lit("RESOLVED").alias("status"), F.concat(F.lit("u"), "project_id").alias("reviewer"))
    _, audit = U.change_status(f, changes, "finding_id", _stamp(NOW))
    return audit.select("finding_id", "status_before", "status_after", "reviewer")


@query("i7_soft_delete", f"WITH {FINDINGS} SELECT finding_id, project_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS deleted FROM f")
def i7(spark, d):
    f = findings(spark, d).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("project_id"))
    return U.soft_delete(f, gone, "project_id", _stamp(NOW)).select("finding_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("i8_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY")
def i8(spark, d):
    return U.retain(table(spark, d, "events"), _stamp("2024-01-25 00:00:00"), created="ts").select("event_id")


@query("i9_review_decisions", f"""WITH {FINDINGS}, {REVIEWS}, j AS (SELECT finding_id, min(verdict) AS verdict, count(*) AS n, count(DISTINCT verdict) AS v FROM r GROUP BY finding_id)
  SELECT j.finding_id AS job_id, CASE WHEN n % 4 = 0 THEN 'FAILED' ELSE verdict END AS verdict, status AS status_before,
    CASE WHEN n % 4 <> 0 AND status = 'OPEN' AND verdict = 'FALSE_POSITIVE' THEN verdict END AS status_after, j.finding_id % 3 <> 1 AS is_new
  FROM j JOIN f USING (finding_id) WHERE n % 4 <> 1 AND j.finding_id % 3 <> 0""")
def i9(spark, d):
    j = reviews(spark, d).groupBy("finding_id").agg(F.min("verdict").alias("verdict"), F.count("*").alias("n"))
    status = F.when(F.col("n") % 4 == 0, "FAILED").when(F.col("n") % 4 == 1, "RUNNING").otherwise("COMPLETED")
    results = j.select(F.col("finding_id").alias("job_id"), F.col("finding_id").alias("target_id"), status.alias("job_status"), "verdict", F.lit(None).cast("string").alias("reason"), F.lit(0.5).alias("confidence"), F.col("verdict").alias("suggested"))
    f = findings(spark, d)
    known = f.where("finding_id % 3 in (0, 1)").select(F.col("finding_id").alias("job_id"), F.when(F.col("finding_id") % 3 == 0, F.col("created_at")).alias("applied_at"), F.when(F.col("finding_id") % 3 == 1, F.col("status")).alias("status_before"))
    return U.review_decisions(results, known, f).select("job_id", "verdict", "status_before", "status_after", "is_new")


@query("i10_review_routing", f"WITH {FINDINGS} SELECT finding_id, CASE WHEN price > 100000 THEN 'precise' ELSE 'simple' END AS mode, severity IN ('CRITICAL', 'HIGH') AS ticket FROM f WHERE status = 'OPEN'")
def i10(spark, d):
    return U.review_route(findings(spark, d).withColumn("has_dataflow", F.col("price") > 100000)).select("finding_id", "mode", "ticket")


@query("i11_ticket_dedupe", f"""WITH {FINDINGS}, g AS (SELECT project_id, sha256(project_id || '|jira|' || string_agg(CAST(finding_id AS VARCHAR), ',' ORDER BY CAST(finding_id AS VARCHAR))) AS key FROM f WHERE status = 'OPEN' GROUP BY project_id)
  SELECT project_id, key, project_id % 2 = 0 AS existing FROM g""")
def i11(spark, d):
    g = findings(spark, d).where("status = 'OPEN'").groupBy("project_id").agg(F.collect_list(F.col("finding_id").cast("string")).alias("ids"))
    keyed = g.select("project_id", X.dedupe_key(F.col("project_id"), F.lit("JIRA"), F.col("ids")).alias("key"))
    tickets = keyed.where("project_id % 2 = 0")
    new = keyed.join(tickets, ["project_id", "key"], "left_anti").withColumn("existing", F.lit(False))
    return keyed.join(tickets, ["project_id", "key"], "left_semi").withColumn("existing", F.lit(True)).unionByName(new)


@query("i12_ruleset_selection", """WITH l AS (SELECT p_brand, max(p_size) AS top FROM part GROUP BY p_brand) SELECT 'PROFILE' AS mode, p_partkey AS rule_id FROM part JOIN l USING (p_brand) WHERE p_size = top AND p_brand = (SELECT min(p_brand) FROM part)
  UNION ALL SELECT 'AUTO', p_partkey FROM part WHERE p_size > 25""")
def i12(spark, d):
    p = table(spark, d, "part")
    first = p.agg(F.min("p_brand")).first()[0]
    sets = p.groupBy(F.col("p_brand").alias("profile"), F.col("p_size").alias("created_at")).agg(F.collect_list("p_partkey").alias("rule_ids")).withColumn("ruleset_id", F.concat_ws("-", "profile", "created_at")).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    rules = p.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") > 25).alias("enabled"))
    one = U.ruleset_selection("PROFILE", rules, sets, rules, first or "").withColumn("mode", F.lit("PROFILE"))
    return one.unionByName(U.ruleset_selection("AUTO", rules, sets, rules, "default").withColumn("mode", F.lit("AUTO")))


@query("i13_identity_merge", "SELECT DISTINCT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS user_id, o_orderpriority AS role FROM orders")
def i13(spark, d):
    grants = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"))
    remap = table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    return U.merge_identities(grants, remap)


@query("i13_draft_merge", "SELECT user_id, draft FROM (SELECT CASE WHEN c_custkey % 10 IN (3, 4) THEN c_custkey - c_custkey % 10 + 2 ELSE c_custkey END AS user_id, c_name AS draft, row_number() OVER (PARTITION BY CASE WHEN c_custkey % 10 IN (3, 4) THEN c_custkey - c_custkey % 10 + 2 ELSE c_custkey END ORDER BY c_custkey % 10 IN (3, 4), c_custkey) AS n FROM customer WHERE c_custkey % 20 <> 2) WHERE n = 1")
def i13b(spark, d):
    c = table(spark, d, "customer")
    remap = c.where("c_custkey % 10 in (3, 4)").select(F.col("c_custkey").alias("old_id"), F.expr("c_custkey - c_custkey % 10 + 2").alias("new_id"))
    return U.merge_drafts(c.where("c_custkey % 20 <> 2").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("draft")), remap)


@query("i14_set_replacement", "SELECT DISTINCT o_custkey AS owner, o_orderpriority AS item FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def i14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("item"), "o_orderstatus")
    return U.replace_sets(o.where("o_orderstatus = 'F'").select("owner", "item").distinct(), o.where("o_orderstatus = 'P'"), ["owner"])


@query("i15_result_status", "SELECT event_id, CASE WHEN event_type <> 'error' AND (user_id % 2 = 0 OR value > 50) THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN event_type <> 'error' AND (user_id % 2 = 0 OR value > 50) THEN 'INFO' ELSE 'ERROR' END AS log_level FROM events")
def i15(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("success"), F.when(F.col("user_id") % 2 == 0, "SOURCE_PREPARE").otherwise("SCAN_EXEC").alias("stage_type"), (F.col("value") > 50).alias("has_file"))
    return U.result_status(e).select("event_id", "status", "log_level")

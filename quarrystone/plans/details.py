"""The remaining operators, each over a table of the driver or rows Spark derives from one."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import graph as G
from quarrystone.operators import relational as R
from quarrystone.operators import upsert as U
from quarrystone.plans.graphs import ABOVE, DEEP, TREE, tree
from quarrystone.plans.registry import query, table
from quarrystone.plans.streams import finished, stream
from quarrystone.plans.views import FINDINGS, TASKS, findings, tasks
from quarrystone.storage import dealt, shared_dir
from quarrystone.streaming import jobs, outbox, reviews


@query("b1_active_rows", f"WITH {FINDINGS} SELECT finding_id, project_id % 7 AS tenant_id FROM f WHERE status <> 'RESOLVED' AND project_id % 7 = 3")
def b1(spark, d):
    f = findings(spark, d).select("finding_id", (F.col("project_id") % 7).alias("tenant_id"), F.when(F.col("status") == "RESOLVED", F.col("created_at")).alias("deleted_at"))
    return R.equal_to(R.active(f), {"tenant_id": 3}).select("finding_id", "tenant_id")


@query("b15_cvss_details", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey END AS title FROM lineitem")
def b15(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.blank_to_null(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" s"), "l_suppkey", F.lit(" "))).otherwise("  ")).alias("title"))


@query("c12_manifest_matches", """SELECT l_orderkey, l_linenumber, 'g' || l_suppkey || ':a' || l_partkey AS package FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)
  WHERE l_partkey % 2 = 0""")
def c12(spark, d):
    return _manifests(table(spark, d, "lineitem"))


def _manifests(li):
    li = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    xml = F.array(F.concat(F.lit(" <groupId>g"), "l_suppkey", F.lit("</groupId>")), F.concat(F.lit(" <artifactId>a"), "l_partkey", F.lit("</artifactId>")))
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(xml).alias("pos", "line"))
    packages = li.where("l_partkey % 2 = 0").select(F.concat(F.lit("g"), "l_suppkey", F.lit(":a"), "l_partkey").alias("package"))
    return R.manifest_matches(lines, packages, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "pos", "line", "package").select("l_orderkey", "l_linenumber", "package")


@query("c12_gradle_matches", """WITH l AS (SELECT l_orderkey, l_linenumber, 'implementation "G' || l_suppkey || ':A' || l_partkey || ':1.0"' AS line FROM lineitem),
  k AS (SELECT DISTINCT 'g' || l_suppkey || ':a' || l_partkey AS package FROM lineitem), t AS (SELECT package, length(package) AS n FROM k), s AS (SELECT DISTINCT n FROM t),
  x AS (SELECT l_orderkey, l_linenumber, line, lower(line)[17 : 16 + n] AS package FROM l, s)
  SELECT l_orderkey, l_linenumber, package, 0.75::DOUBLE AS confidence FROM x JOIN t USING (package)""")
def c12_gradle(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    lines = li.select("l_orderkey", "l_linenumber", F.concat(F.lit('implementation "G'), "l_suppkey", F.lit(":A"), "l_partkey", F.lit(':1.0"')).alias("line"))
    packages = li.select(F.concat(F.lit("g"), "l_suppkey", F.lit(":a"), "l_partkey").alias("package"))
    return R.gradle_matches(lines, packages, "l_linenumber", "line", "package").select("l_orderkey", "l_linenumber", "package", "confidence")


@query("c14_call_targets", """SELECT DISTINCT l_orderkey AS caller, l_linenumber AS "offset", l_partkey AS callee FROM lineitem
  UNION SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0""")
def c14(spark, d):
    li = table(spark, d, "lineitem")
    return _targets(li, li)


def _targets(called, li):
    calls = called.select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("offset"), F.col("l_partkey").alias("callee"))
    sites = li.where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("offset"), F.col("l_suppkey").alias("callee"))
    return R.call_targets(calls, sites)


@query("c15_bean_candidates", f"""WITH RECURSIVE {TREE}, {ABOVE}, b AS (SELECT node AS bean, CASE WHEN p_size <> 1 THEN node END AS type FROM n),
  u AS (SELECT bean FROM b WHERE type IS NULL ORDER BY bean LIMIT 20), t AS (SELECT node AS target FROM n),
  m AS (SELECT target, bean, 0 AS fit FROM t JOIN b ON target = type UNION ALL SELECT target, bean, 1 FROM t JOIN up ON target = ancestor JOIN b ON up.node = type UNION ALL SELECT target, bean, 2 FROM t, u)
  SELECT target, bean, fit FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY fit, bean) AS k FROM (SELECT target, bean, min(fit) AS fit FROM m GROUP BY 1, 2)) WHERE k <= 20""")
def c15(spark, d):
    return _beans(spark, d, "true")


def _beans(spark, d, which):
    nodes, edges = tree(spark, d)
    above = G.closure(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    beans = nodes.select(F.col("node").alias("bean"), F.when(F.col("p_size") != 1, F.col("node")).alias("type"))
    return R.bean_candidates(nodes.where(which).select(F.col("node").alias("target")), beans, above)


@query("c19_heap_matches", """WITH w AS (SELECT * FROM part WHERE p_partkey % 2 = 0), r AS (SELECT * FROM part WHERE p_partkey % 2 = 1),
  m AS (SELECT r.p_partkey AS read, w.p_partkey AS write, CASE WHEN r.p_brand = w.p_brand THEN 10 ELSE 0 END + 1 AS score FROM r JOIN w ON r.p_type = w.p_type AND r.p_size % 10 = w.p_size % 10)
  SELECT read, write, score FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, write) AS k FROM m) WHERE k <= 25""")
def c19(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("method"), F.col("p_brand").alias("cls"), F.col("p_partkey").alias("base"), F.col("p_type").alias("field"), "p_size")
    sets = p.select(F.col("base").alias("node"), F.array(F.col("p_size") % 10).alias("roots"), F.lit(False).alias("truncated"))
    return G.heap_matches(p.where("id % 2 = 1"), p.where("id % 2 = 0"), sets)


@query("e2_latest_ruleset", "SELECT p_brand AS profile, p_partkey AS ruleset_id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE p_retailprice > 950) WHERE n = 1")
def e2(spark, d):
    p = table(spark, d, "part").where("p_retailprice > 950")
    return R.latest(p, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")]).select(F.col("p_brand").alias("profile"), F.col("p_partkey").alias("ruleset_id"))


@query("f3_recent_tasks", f"WITH {TASKS} SELECT task_id, status FROM t ORDER BY created_at DESC, task_id LIMIT 100")
def f3(spark, d):
    return R.page(tasks(spark, d), [F.desc("created_at"), F.col("task_id")], 100, most=100).select("task_id", "status")


@query("f7_pending_reviews", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity < 10 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 200")
def f7(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'N' and l_quantity < 10")
    return R.page(li, [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")], 500, most=200).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f9_best_traces", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node AS start, max(ancestor) AS root FROM up WHERE ancestor % 2 = 1 GROUP BY node")
def f9(spark, d):
    return _best(spark, d, "true")


def _best(spark, d, which):
    nodes, edges = tree(spark, d)
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    starts = nodes.where(which).select(F.col("node").alias("start"))
    ends = nodes.where("node % 2 = 1").select("node", F.lit(1).alias("priority"))
    # a start is no end of its own: it sets out from its parent
    first = starts.join(dealt(back.withColumnRenamed("source", "start")), "start")
    t = G.traces(back, first.select(F.col("target").alias("start")).distinct(), ends, depth=DEEP, best=1).where("priority = 1")
    return first.join(dealt(t.select(F.col("start").alias("target"), F.element_at("path", -1).alias("root"))), "target").select("start", "root")


@query("g3_distinct_in_order", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY 1, 2) GROUP BY user_id")
def g3(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: x["event_type"]), ",").alias("kinds"))


@query("h10_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR")
def h10(spark, d):
    n, unit = X.parse_window("36h")
    return table(spark, d, "events").where(F.expr(f"ts >= timestamp_ntz'2024-01-30 00:00:00' - INTERVAL {n} {unit}")).select("event_id")


@query("h15_usage_tokens", "SELECT p_partkey, unnest(list_distinct(list_filter([lower(p_brand), 'org.' || p_partkey, CASE WHEN length('name-' || p_size) >= 6 THEN 'name-' || p_size END], lambda x: length(x) >= 4))) AS token FROM part")
def h15(spark, d):
    purl = F.concat(F.lit("pkg:maven/org."), "p_partkey", F.lit("/name-"), "p_size", F.lit("@1"))
    return table(spark, d, "part").select("p_partkey", F.explode(X.usage_tokens(purl, F.col("p_brand"))).alias("token"))


@query("h18_introduced_by", "SELECT event_id, CASE event_type WHEN 'view' THEN 'c' || event_id WHEN 'click' THEN 'img' WHEN 'error' THEN 'sbom:u' || user_id ELSE 'ref' END AS introduced_by FROM events")
def h18(spark, d):
    k = F.col("event_type")
    none = F.lit(None).cast("string")
    out = X.introduced_by(F.when(k == "view", F.concat(F.lit("c"), "event_id")).otherwise(" "), F.when(k == "click", "img"), none, F.when(k == "error", F.concat(F.lit("u"), "user_id")), none, F.lit("ref"))
    return table(spark, d, "events").select("event_id", out.alias("introduced_by"))


@query("h19_has_dataflow", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 3 > 0 AS has_dataflow FROM events")
def h19(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    nodes, edges = F.when(k % 3 == 1, F.array(k)), F.when(k % 3 == 2, F.array(k)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "events").select("event_id", X.has_dataflow(nodes, edges).alias("has_dataflow"))


@query("h21_evidence_snippet", """SELECT doc_id, CASE WHEN len(x) >= 2 THEN array_to_string(list_transform(x[2:4], lambda l: substr(l, 1, 400)), chr(10)) END AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)""")
def h21(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("x"))
    return docs.select("doc_id", F.array_join(X.snippet_lines(F.col("x"), F.lit(2), F.lit(4)), "\n").alias("snippet"))


@query("h21_dataflow_snippet", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type || '.py' END AS path, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN 1 ELSE user_id + 1 END AS start_line, CASE event_id % 3 WHEN 0 THEN 'own line' WHEN 1 THEN 'v' || event_id END AS content FROM events")
def h21_flow(spark, d):
    """Evidence of three kinds: its node has a snippet, a value, or lies elsewhere."""
    k, path, line = F.col("event_id") % 3, F.concat("event_type", F.lit(".py")), (F.col("user_id") + 1).cast("int")
    own = F.when(k == 0, F.struct(path.alias("path"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine"), F.array(F.struct(F.lit(1).alias("lineNumber"), F.lit("own line").alias("content"))).alias("lines")))
    node = F.struct(path.alias("file"), (line + F.when(k == 2, 1).otherwise(0)).alias("line"), F.concat(F.lit("v"), "event_id").alias("value"), own.alias("codeSnippet"))
    doc = F.to_json(F.struct(F.struct(F.array(node).alias("nodes")).alias("dataFlow")))
    e = table(spark, d, "events").withColumn("s", X.dataflow_snippet(doc, path, line))
    return e.select("event_id", "s.path", F.col("s.start_line").cast("long").alias("start_line"), F.get(F.col("s.lines"), F.lit(0))["content"].alias("content"))


@query("h24_review_fields", "SELECT event_id, 'v' || event_type AS verdict, 'r' || user_id AS reason, CASE WHEN event_id % 2 = 0 THEN 'CONFIRMED' ELSE 'FALSE_POSITIVE' END AS status FROM events")
def h24(spark, d):
    even = F.col("event_id") % 2 == 0
    doc = F.to_json(F.struct(F.concat(F.lit("v"), "event_type").alias("verdict"), F.concat(F.lit("r"), "user_id").alias("reason"), F.when(even, "CONFIRMED").alias("suggestedStatus"),
                             F.struct(F.array(F.struct(F.lit("FALSE_POSITIVE").alias("status"))).alias("findings")).alias("recommendation")))
    return table(spark, d, "events").withColumn("r", X.review_fields(doc)).select("event_id", "r.verdict", "r.reason", "r.status")


@query("h33_ticket_texts", "SELECT o_custkey, string_agg('- ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS description FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def h33(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    none = F.lit(" ")
    return o.select("o_custkey", X.ticket_description(none, none, F.transform("ids", lambda i: i.cast("string"))).alias("description"))


@query("j10_chain_traces", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node AS start, min(ancestor) AS root FROM up GROUP BY node")
def j10(spark, d):
    return _inside(spark, d, "true")


def _inside(spark, d, which):
    """Only the steps of the caller chains of the starts may be taken."""
    nodes, edges = tree(spark, d)
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    starts = nodes.where(which).select(F.col("node").alias("start"))
    inside = G.reachable(back, starts.select("start", F.col("start").alias("node"))).select(F.col("node").alias("source")).distinct()
    t = G.traces(back.join(inside, "source", "left_semi"), starts, nodes.where("false").select("node", F.lit(1).alias("priority")), depth=DEEP)
    return t.where("depth > 0").select("start", F.element_at("path", -1).alias("root"))


@query("k1_event_loop", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def k1(spark, d):
    return finished(stream(spark, d).where("event_type = 'purchase'").select("event_id"))


@query("k7_review_ledger", f"WITH {FINDINGS} SELECT event_id AS job_id, CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'review' END AS kind, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 'FAILED' ELSE 'TRUE_POSITIVE' END AS verdict, CASE WHEN event_id % 7 <> 0 AND event_type <> 'error' AND status = 'OPEN' THEN 'CONFIRMED' END AS status_after FROM events LEFT JOIN f ON finding_id = event_id WHERE event_type IN ('error', 'click') AND (event_id % 7 = 0 OR finding_id IS NOT NULL)")
def k7_ledger(spark, d):
    """Review results as JSON, every seventh of them broken, applied in a micro-batch with its ledger."""
    target = F.col("event_id").cast("long")
    doc = F.to_json(F.struct(target.alias("target_id"), X.mapped(F.col("event_type"), {"error": "FAILED", "click": "COMPLETED"}, "RUNNING").alias("status"), F.lit("TRUE_POSITIVE").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("confirmed").alias("suggested")))
    e = stream(spark, d).where("event_type in ('error', 'click')").select(target.alias("job_id"), F.when(target % 7 == 0, F.substring(doc, 1, 20)).otherwise(doc).alias("payload"))
    path, cursor = shared_dir(spark, "review-ledger"), shared_dir(spark, "review-cursor")
    jobs.run_once(e, cursor, reviews.review_sink(spark, path, findings(spark, d), F.to_timestamp(F.lit("2025-01-01 00:00:00"))))
    return outbox.written(spark, path, reviews.LEDGER).where("kind <> 'finding'").select("job_id", "kind", "verdict", "status_after")


@query("k7_review_stream", f"WITH {FINDINGS} SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'TRUE_POSITIVE' END AS verdict, CASE WHEN event_type <> 'error' AND status = 'OPEN' THEN 'CONFIRMED' END AS status_after FROM events JOIN f ON finding_id = event_id WHERE event_type IN ('error', 'click')")
def k7(spark, d):
    f = findings(spark, d)
    none = f.where("false").select(F.col("finding_id").alias("job_id"), F.col("created_at").alias("applied_at"), F.col("status").alias("status_before"))
    e = stream(spark, d).select(F.col("event_id").alias("job_id"), F.col("event_id").alias("target_id"), X.mapped(F.col("event_type"), {"error": "FAILED", "click": "COMPLETED"}, "RUNNING").alias("job_status"),
                                F.lit("TRUE_POSITIVE").alias("verdict"), F.lit("").alias("reason"), F.lit(0.5).alias("confidence"), F.lit("confirmed").alias("suggested"))
    return finished(U.review_decisions(e, none, f)).select("job_id", "verdict", "status_after")

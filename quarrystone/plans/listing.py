"""Filters, pages, joins, windows and set operations over the findings model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import relational as R
from quarrystone.plans.registry import query, table
from quarrystone.plans.views import FINDINGS, RANK, REVIEWS, TASKS, day, findings, reviews, tasks


@query("b3_optional_filters", f"WITH {FINDINGS} SELECT finding_id, severity, status FROM f WHERE severity = 'HIGH' AND status = 'OPEN'")
def b3(spark, d):
    return R.equal_to(findings(spark, d), {"severity": "HIGH", "status": "OPEN", "project_id": None}).select("finding_id", "severity", "status")


@query("b4_text_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ar_%' OR lower(p_brand) LIKE '%ar_%' OR lower(p_type) LIKE '%ar_%'")
def b4(spark, d):
    p = table(spark, d, "part")
    return p.where(X.text_search([p.p_name, p.p_brand, p.p_type], " AR_ ")).select("p_partkey", "p_name")


@query("b5_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def b5(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("project_id"))
    return findings(spark, d).join(wanted, "project_id", "left_semi").select(F.col("finding_id").alias("o_orderkey"))


@query("b6_type_exclusion", f"WITH {TASKS} SELECT task_id, type FROM t WHERE type NOT IN ('SCA_CHECK', 'SUPPLY_CHAIN')")
def b6(spark, d):
    return tasks(spark, d).where(~F.col("type").isin("SCA_CHECK", "SUPPLY_CHAIN")).select("task_id", "type")


@query("b7_time_window", f"WITH {TASKS} SELECT task_id, status FROM t WHERE coalesce(updated_at, created_at) >= TIMESTAMP '2024-01-20 00:00:00'")
def b7(spark, d):
    return R.since(tasks(spark, d), "2024-01-20 00:00:00", "updated_at", "created_at").select("task_id", "status")


@query("b8_stuck_tasks", f"""WITH {TASKS} SELECT task_id, status FROM t WHERE status IN ('PENDING', 'RUNNING')
  AND coalesce(updated_at, created_at) < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 60 SECOND""")
def b8(spark, d):
    now = F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))
    return R.stuck(tasks(spark, d), now, 5).select("task_id", "status")


@query("b9_stale_executors", f"""WITH {TASKS}, e AS (SELECT project_id AS executor_id, max(updated_at) AS beat, CASE project_id % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'BUSY' WHEN 2 THEN 'DRAINING' ELSE 'OFFLINE' END AS status FROM t GROUP BY project_id)
  SELECT executor_id, status FROM e WHERE status <> 'OFFLINE' AND (beat IS NULL OR beat < TIMESTAMP '2024-01-29 00:00:00')""")
def b9(spark, d):
    e = tasks(spark, d).groupBy(F.col("project_id").alias("executor_id")).agg(F.max("updated_at").alias("beat"))
    e = e.withColumn("status", X.mapped(F.col("executor_id") % 4, {0: "READY", 1: "BUSY", 2: "DRAINING"}, "OFFLINE"))
    return R.stale(e, "2024-01-29 00:00:00", "status", "beat").select("executor_id", "status")


@query("b10_auto_applied", f"""WITH {FINDINGS}, {REVIEWS} SELECT r.finding_id, review_id FROM r JOIN f USING (finding_id)
  WHERE status IS NOT NULL AND nullif(verdict, 'UNCERTAIN') IS NOT NULL AND status <> verdict""")
def b10(spark, d):
    both = reviews(spark, d).select("finding_id", "review_id", F.nullif("verdict", F.lit("UNCERTAIN")).alias("after")).join(findings(spark, d), "finding_id")
    return both.where(F.col("status").isNotNull() & F.col("after").isNotNull() & (F.col("status") != F.col("after"))).select("finding_id", "review_id")


@query("b11_tags", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), (SELECT min(string_split(p_type, ' ')[1]) FROM part))")
def b11(spark, d):
    p = table(spark, d, "part").withColumn("tags", F.split("p_type", " "))
    first = p.agg(F.min(F.col("tags")[0])).first()[0]
    return R.tagged(p, [first] if first is not None else []).select("p_partkey")


@query("b12_log_levels", "SELECT event_id, event_type FROM events WHERE CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END <> 'INFO'")
def b12(spark, d):
    e = table(spark, d, "events")
    level = X.mapped(e.event_type, {"error": "error", "view": "INFO", "click": "debug", "signup": "WARN"}, F.lit(None).cast("string"))
    return e.where(X.log_visible(level, "WARN")).select("event_id", "event_type")


@query("b13_path_exclusion", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '[0-4]$')")
def b13(spark, d):
    return R.without_paths(table(spark, d, "pages"), "[0-4]$", "url").select("page_id", "url")


@query("b14_finding_summary", f"""WITH {FINDINGS}, {REVIEWS},
  l AS (SELECT finding_id, verdict, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, review_id, verdict) AS n FROM r)
  SELECT f.finding_id, severity, status, strftime(created_at, '%Y-%m-%d') AS day, l.verdict AS review FROM f LEFT JOIN l ON f.finding_id = l.finding_id AND n = 1""")
def b14(spark, d):
    last = R.latest(reviews(spark, d), ["finding_id"], [F.desc("created_at"), F.col("review_id"), F.col("verdict")]).select("finding_id", F.col("verdict").alias("review"))
    return findings(spark, d).join(last, "finding_id", "left").select("finding_id", "severity", "status", day("created_at").alias("day"), "review")


@query("b16_existing_projects", "SELECT o_orderkey, c_custkey IS NOT NULL AS accepted FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def b16(spark, d):
    f, live = findings(spark, d), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("project_id"))
    kept, refused = f.join(live, "project_id", "left_semi"), f.join(live, "project_id", "left_anti")
    out = kept.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
    return out.select(F.col("finding_id").alias("o_orderkey"), "accepted")


@query("c1_findings_of_tasks", f"WITH {FINDINGS} SELECT finding_id, severity, c_name FROM f JOIN customer ON project_id = c_custkey WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'MACHINERY')")
def c1(spark, d):
    c = table(spark, d, "customer").where(~F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"))
    return findings(spark, d).join(c, F.col("project_id") == F.col("c_custkey")).select("finding_id", "severity", "c_name")


@query("c2_finding_detail", f"""WITH {FINDINGS}, {REVIEWS},
  l AS (SELECT finding_id, verdict, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, review_id, verdict) AS n FROM r)
  SELECT f.finding_id, c_name AS project_name, n_name AS repo, l.verdict FROM f LEFT JOIN customer ON project_id = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON f.finding_id = l.finding_id AND l.n = 1""")
def c2(spark, d):
    last = R.latest(reviews(spark, d), ["finding_id"], [F.desc("created_at"), F.col("review_id"), F.col("verdict")]).select("finding_id", "verdict")
    out = findings(spark, d).join(table(spark, d, "customer"), F.col("project_id") == F.col("c_custkey"), "left")
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(last, "finding_id", "left")
    return out.select("finding_id", F.col("c_name").alias("project_name"), F.col("n_name").alias("repo"), "verdict")


@query("c3_effective_permissions", """SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS tenant_id, c_custkey AS user_id, 'supply:' || CAST(s_suppkey AS VARCHAR) AS permission
  FROM customer JOIN supplier ON c_nationkey = s_nationkey""")
def c3(spark, d):
    users = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.lit("buyer").alias("role_id"))
    roles = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("tenant_id"), F.lit("buyer").alias("role_id"), F.concat(F.lit("supply:"), "s_suppkey").alias("permission"))
    blank = roles.withColumn("permission", F.lit("  "))
    return R.effective_permissions(users, roles.union(blank))


@query("c4_ruleset_overrides", """SELECT l_orderkey AS group_id, l_linenumber AS member_id, l_partkey AS rule_id,
  coalesce(CASE WHEN l_returnflag = 'R' THEN 'HIGH' END, p_brand) AS severity, coalesce(CASE WHEN l_linestatus = 'F' THEN FALSE END, p_size > 10) AS enabled
  FROM lineitem JOIN part ON l_partkey = p_partkey""")
def c4(spark, d):
    return _overrides(spark, d, table(spark, d, "lineitem"))


def _overrides(spark, d, lines):
    m = lines.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("member_id"), F.col("l_partkey").alias("rule_id"),
        F.when(F.col("l_returnflag") == "R", "HIGH").alias("own_severity"), F.when(F.col("l_linestatus") == "F", F.lit(False)).alias("own_enabled"))
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("base_severity"), (F.col("p_size") > 10).alias("base_enabled"))
    out, _ = R.with_override(m, rules, "rule_id", {"severity": ("own_severity", "base_severity"), "enabled": ("own_enabled", "base_enabled")})
    return out.select("group_id", "member_id", "rule_id", "severity", "enabled")


@query("c5_found_and_missing", """SELECT c_custkey AS project_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer""")
def c5(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    found, missing = R.found_and_missing(asked, findings(spark, d), ["project_id"])
    return found.select("project_id").distinct().withColumn("found", F.lit(True)).union(missing.withColumn("found", F.lit(False)))


def _issues(spark, d):
    p = table(spark, d, "part")
    brand = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-"))
    purl = F.concat(F.lit("pkg:maven/org."), brand, F.lit("/"), F.lower(F.translate("p_name", " ", "-")), F.lit("@1."), "p_size", F.lit("?x=y"))
    return p.select(F.col("p_partkey").alias("issue_id"), purl.alias("purl"), brand.alias("brand"), F.lower(F.translate("p_name", " ", "-")).alias("name"), "p_size", "p_retailprice")


@query("h5_purl_match_keys", """SELECT p_partkey AS issue_id, unnest(list_distinct([
    'pkg:maven/org.' || b || '/' || n || '@1.' || p_size || '?x=y', n, 'pkg:maven/org.' || b || '/' || n || '@1.' || p_size,
    'org.' || b || ':' || n, 'org.' || b])) AS key
  FROM (SELECT p_partkey, p_size, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS b, lower(replace(p_name, ' ', '-')) AS n FROM part)""")
def h5(spark, d):
    i = _issues(spark, d)
    return i.select("issue_id", F.explode(X.purl_match_keys(F.col("purl"), F.col("name"), F.lit(None).cast("string"))).alias("key"))


@query("c6_usage_evidence", """WITH i AS (SELECT p_partkey AS issue_id, 'org.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS key FROM part),
  e AS (SELECT s_suppkey AS pos, (SELECT 'org.' || lower(regexp_replace(min(p_brand), '[^A-Za-z0-9]', '-', 'g')) FROM part WHERE p_partkey % 10 = s_suppkey % 10) AS key FROM supplier)
  SELECT issue_id, pos FROM (SELECT issue_id, pos, row_number() OVER (PARTITION BY issue_id ORDER BY pos) AS n FROM i JOIN e USING (key)) WHERE n <= 80""")
def c6(spark, d):
    i = _issues(spark, d).select("issue_id", F.lit(1).alias("task_id"), X.purl_match_keys(F.col("purl"), F.col("name"), F.col("name")).alias("keys"))
    first = table(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("m")).agg(F.concat(F.lit(" ORG."), F.regexp_replace(F.min("p_brand"), "[^A-Za-z0-9]", "-")).alias("entry"))
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.lit(1).alias("task_id"), (F.col("s_suppkey") % 10).alias("m")).join(first, "m")
    return R.matched_evidence(i, e, "issue_id", "task_id", "keys", "entry", "pos").select("issue_id", "pos")


def _risk(spark, d):
    i = _issues(spark, d)
    sev = X.mapped(F.col("issue_id") % 5, {0: "CRITICAL", 1: "HIGH", 2: "MEDIUM", 3: "LOW"}, "INFO")
    st = X.mapped(F.col("issue_id") % 4, {0: "OPEN", 1: "RESOLVED", 2: "WONT_FIX"}, "FALSE_POSITIVE")
    rows = i.select(F.array("brand").alias("keys"), F.col("p_size").cast("string").alias("version"), sev.alias("severity"), st.alias("status"))
    return R.component_risk(rows)


_RISK = """i AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) AS b, CAST(p_size AS VARCHAR) AS v,
    5 - CAST(p_partkey % 5 AS INT) AS rank FROM part WHERE p_partkey % 4 IN (0, 2)),
  k AS (SELECT b AS key, rank FROM i UNION ALL SELECT b || '@@' || v, rank FROM i),
  risk AS (SELECT key, CASE max(rank) WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity FROM k GROUP BY key)"""


@query("d19_component_risk", f"WITH {_RISK} SELECT key, severity FROM risk")
def d19(spark, d):
    return _risk(spark, d).select("key", "severity")


@query("c7_node_risk", f"""WITH {_RISK} SELECT p_partkey AS node, coalesce(a.severity, z.severity) AS risk FROM part
  LEFT JOIN risk a ON a.key = lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g')) || '@@' || CAST(p_size + 1 AS VARCHAR)
  LEFT JOIN risk z ON z.key = lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g'))""")
def c7(spark, d):
    nodes = _issues(spark, d).select(F.col("issue_id").alias("node"), F.array("brand").alias("keys"), (F.col("p_size") + 1).cast("string").alias("version"))
    return R.risk_of(nodes, _risk(spark, d), "node", "keys", "version").select("node", "risk")


@query("c11_lines_with_tokens", """WITH tk AS (SELECT token FROM (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS token FROM part) WHERE token <> '' ORDER BY length(token) DESC, token LIMIT 400),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, n, token FROM l JOIN tk ON contains(lower(line), token)""")
def c11(spark, d):
    tokens = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return R.lines_with_tokens(lines, tokens).select("doc_id", (F.col("p") + 1).alias("n"), "token")


@query("c13_longest_prefix", """WITH g AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), n AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS name FROM pages)
  SELECT page_id, max(host) AS grp FROM n JOIN g ON n.name = host OR starts_with(n.name, host || '/') GROUP BY page_id""")
def c13(spark, d):
    p = table(spark, d, "pages")
    names = p.select("page_id", F.regexp_replace("url", "^https?://", "").alias("name"))
    groups = p.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("grp"))
    return R.longest_prefix(names, groups, "name", "grp", "/").select("page_id", "grp")


@query("c18_nearest_preceding", """SELECT doc_key, ctx, event_id FROM (
    SELECT a.event_id AS ctx, a.user_id AS doc_key, b.event_id, row_number() OVER (PARTITION BY a.user_id, a.event_id ORDER BY b.ts DESC, b.event_id) AS n
    FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts WHERE a.event_type = 'error' AND b.event_type = 'click') WHERE n <= 3""")
def c18(spark, d):
    e = table(spark, d, "events")
    at = e.where("event_type = 'error'").select(F.col("user_id").alias("doc_key"), F.col("event_id").alias("ctx"), F.col("ts").alias("context"))
    edges = e.where("event_type = 'click'").select(F.col("user_id").alias("doc_key"), "event_id", F.col("ts").alias("offset"))
    return R.preceding(edges, at, ["doc_key"], "offset", "context", ["ctx"], "event_id").select("doc_key", "ctx", "event_id")


@query("e1_latest_review", f"WITH {REVIEWS} SELECT finding_id, review_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, review_id, verdict) AS n FROM r) WHERE n = 1")
def e1(spark, d):
    return R.latest(reviews(spark, d), ["finding_id"], [F.desc("created_at"), F.col("review_id"), F.col("verdict")]).select("finding_id", "review_id", "verdict")


@query("e3_latest_scan", f"WITH {TASKS} SELECT project_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST, task_id) AS n FROM t WHERE status = 'SUCCEEDED') WHERE n = 1")
def e3(spark, d):
    t = tasks(spark, d).where("status = 'SUCCEEDED'")
    return R.latest(t, ["project_id"], [F.col("updated_at").desc_nulls_last(), F.col("task_id")]).select("project_id", "task_id")


@query("e4_caps", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 20) WHERE m <= 2000""")
def e4(spark, d):
    return R.capped(table(spark, d, "events"), ["event_type"], ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id")


@query("e5_log_chunks", """WITH c AS (SELECT doc_id, text, CAST(ceil(length(text) / 1024.0) AS INT) AS n, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 END AS nxt FROM documents WHERE length(text) > 0)
  SELECT doc_id AS task_id, coalesce(nxt, 0) + i AS sequence, sha256(substr(text, CAST(i * 1024 + 1 AS BIGINT), 1024)) AS content, nxt IS NULL AND i = n - 1 AS is_last
  FROM (SELECT *, unnest(range(n)) AS i FROM c)""")
def e5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("task_id"), "text")
    known = docs.where("task_id % 3 = 0").select("task_id", (F.col("task_id") % 7).alias("sequence"))
    out = R.log_chunks(docs, known, "task_id", "text")
    return out.select("task_id", "sequence", F.sha2("content", 256).alias("content"), "is_last")


@query("e6_consecutive_edges", "SELECT conv_id, source, target FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS source, turn AS target FROM conversations) WHERE source IS NOT NULL")
def e6(spark, d):
    return R.consecutive(table(spark, d, "conversations"), "turn", ["conv_id"], [F.col("turn")])


@query("e7_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations""")
def e7(spark, d):
    c = table(spark, d, "conversations").withColumn("own", F.when(F.col("role") == "user", F.col("turn")))
    return R.carried(c, "own", ["conv_id"], [F.col("turn")], "asked").select("conv_id", "turn", "asked")


@query("e8_default_client", "SELECT c_nationkey AS tenant, c_custkey AS client FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal > 0) WHERE n = 1")
def e8(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").withColumn("is_default", F.col("c_mktsegment") == "BUILDING")
    return R.latest(c, ["c_nationkey"], [F.desc("is_default"), F.desc("c_acctbal"), F.col("c_custkey")]).select(F.col("c_nationkey").alias("tenant"), F.col("c_custkey").alias("client"))


@query("e9_recent_commits", "SELECT l_suppkey AS repo, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 50")
def e9(spark, d):
    li = table(spark, d, "lineitem")
    return R.first_n(li, ["l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], 50).select(F.col("l_suppkey").alias("repo"), "l_orderkey", "l_linenumber")


@query("e9_default_branch_commits", """WITH r AS (SELECT s_suppkey AS repo, CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'none' END AS configured, CASE WHEN s_suppkey % 4 = 2 THEN 'R' END AS detected FROM supplier),
  b AS (SELECT DISTINCT l_suppkey AS repo, l_returnflag AS name FROM lineitem), d AS (SELECT repo, coalesce(configured, detected, (SELECT min(name) FROM b WHERE b.repo = r.repo)) AS branch FROM r)
  SELECT repo, l_orderkey, l_linenumber FROM (SELECT d.repo, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY d.repo ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem JOIN d ON l_suppkey = d.repo AND l_returnflag = d.branch) WHERE n <= 50""")
def e9_branches(spark, d):
    """Suppliers are repositories, return flags their branches; some have a configured or a detected default, of one branch none is there."""
    k = F.col("s_suppkey") % 4
    repos = table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo"), F.when(k == 0, "A").when(k == 1, "none").alias("configured"), F.when(k == 2, "refs/heads/R").alias("detected"))
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_returnflag").alias("branch"), "l_orderkey", "l_linenumber", "l_shipdate")
    branches = li.select("repo", F.concat(F.when(F.col("branch") == "N", "refs/remotes/origin/").otherwise("refs/heads/"), "branch").alias("name"), F.lit("").alias("commit")).distinct()
    return R.recent_commits(repos, branches, li, [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("repo", "l_orderkey", "l_linenumber")


@query("e10_merged_ranges", """WITH a AS (SELECT user_id, k - 3 AS s, k + 3 AS e FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
  o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM a),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
  SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island""")
def e10(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    a = table(spark, d, "events").select("user_id", (k - 3).alias("s"), (k + 3).alias("e"))
    return R.merged_ranges(a, ["user_id"], "s", "e")


@query("f1_page", f"WITH {FINDINGS} SELECT finding_id, severity, count(*) OVER () AS total FROM f ORDER BY created_at DESC, finding_id LIMIT 500 OFFSET 100")
def f1(spark, d):
    f = findings(spark, d)
    return R.with_total(f, R.page(f, [F.desc("created_at"), F.col("finding_id")], 10_000, 100)).select("finding_id", "severity", "total")


@query("f4_oldest_stuck", f"WITH {TASKS} SELECT task_id FROM t WHERE status IN ('PENDING', 'RUNNING') ORDER BY coalesce(updated_at, created_at), task_id LIMIT 100")
def f4(spark, d):
    t = tasks(spark, d).where(F.col("status").isin("PENDING", "RUNNING"))
    return R.page(t, [F.coalesce("updated_at", "created_at"), F.col("task_id")], 100).select("task_id")


@query("f6_keyset_page", "SELECT event_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def f6(spark, d):
    return R.page(table(spark, d, "events").where("event_id > 500"), [F.col("event_id")], 200).select("event_id")


@query("f8_heaviest_and_rest", """WITH p AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY w DESC, CAST(k AS VARCHAR)) AS n FROM p)
  SELECT CASE WHEN n <= 199 THEN CAST(k AS VARCHAR) ELSE '_OTHER' END AS shard, CAST(sum(w) AS BIGINT) AS w FROM r GROUP BY 1""")
def f8(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("shard"), F.col("l_quantity").cast("long").alias("w"))
    return R.top_and_rest(li, "shard", "w")


@query("g1_union_distinct", "SELECT l_partkey AS ref FROM lineitem UNION SELECT l_suppkey FROM lineitem UNION SELECT p_partkey FROM part")
def g1(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("ref")).union(li.select("l_suppkey")).union(table(spark, d, "part").select("p_partkey")).distinct()


@query("g2_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def g2(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("g4_typed_union", f"WITH {FINDINGS} SELECT 'FINDING' AS item_type, finding_id AS id FROM f WHERE status = 'OPEN' UNION ALL SELECT 'SCA_ISSUE', p_partkey FROM part")
def g4(spark, d):
    return R.typed_union(FINDING=findings(spark, d).where("status = 'OPEN'").select(F.col("finding_id").alias("id")), SCA_ISSUE=table(spark, d, "part").select(F.col("p_partkey").alias("id"))).select("item_type", "id")


@query("g5_tuple_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT o_orderkey, CAST(1 AS INT) FROM orders WHERE o_orderstatus = 'O')")
def g5(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return table(spark, d, "lineitem").join(gone, ["l_orderkey", "l_linenumber"], "left_anti").select("l_orderkey", "l_linenumber")


@query("c17_draft_items", f"""WITH {FINDINGS}, i AS (SELECT project_id, 'FINDING' AS item_type, finding_id AS id, severity FROM f WHERE status = 'OPEN')
  SELECT project_id, count(*) AS items, max({RANK}) AS worst FROM i GROUP BY project_id""")
def c17(spark, d):
    items = R.typed_union(FINDING=findings(spark, d).where("status = 'OPEN'").select("project_id", F.col("finding_id").alias("id"), "severity"))
    return items.groupBy("project_id").agg(F.count("*").alias("items"), F.max(X.severity_rank(F.col("severity"))).alias("worst"))

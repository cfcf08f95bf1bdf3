"""Scalar functions and text search over the driver's text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import relational as R
from quarrystone.plans.registry import query, table


@query("h1_sarif_severity", "SELECT event_id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'view' THEN 'CRITICAL' WHEN 'click' THEN 'LOW' ELSE 'INFO' END AS severity FROM events")
def h1(spark, d):
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "click", " Note ").otherwise(F.col("event_type"))
    return e.select("event_id", X.sarif_severity(level, F.when(F.col("event_type") == "view", "critical").otherwise(" ")).alias("severity"))


@query("h2_scanner_levels", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'warning' ELSE 'note' END AS level, CASE o_orderpriority WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS trivy FROM orders")
def h2(spark, d):
    word = F.substring_index("o_orderpriority", "-", -1)
    return table(spark, d, "orders").select("o_orderkey", X.semgrep_level(F.when(word == "URGENT", "critical").otherwise(word)).alias("level"), X.trivy_severity(F.lower(word)).alias("trivy"))


@query("h3_issue_keys", "SELECT l_orderkey, l_linenumber, l_partkey, sha256('CVE-' || l_partkey || '|' || CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey ELSE '' END || '|1.' || l_linenumber || '|') AS issue_key FROM lineitem")
def h3(spark, d):
    key = X.sca_issue_key(F.concat(F.lit("CVE-"), "l_partkey"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), "l_suppkey")), F.concat(F.lit("1."), "l_linenumber"), F.lit(None).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("issue_key"))


@query("h4_severity_rank", "SELECT o_orderpriority AS priority, CASE o_orderpriority WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 + 1 ELSE 0 END AS rank, count(*) AS n FROM orders GROUP BY 1, 2")
def h4(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), X.severity_rank(F.substring_index("o_orderpriority", "-", -1)).alias("rank")).agg(F.count("*").alias("n"))


@query("h7_normalize_path", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' || page_id ELSE 'b' || chr(92) || page_id END AS path FROM pages")
def h7(spark, d):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" \\ws\\a\\"), "page_id")).otherwise(F.concat(F.lit("b\\"), "page_id", F.lit(" ")))
    return table(spark, d, "pages").select("page_id", X.normalize_path(raw, "/ws/").alias("path"))


@query("a5_rewrite_uri", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/ws/a/' || page_id WHEN 1 THEN url WHEN 2 THEN '/ws/b/' || page_id ELSE '/etc/' || page_id END AS uri FROM pages")
def a5(spark, d):
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("file:///src/a/"), "page_id")).when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit("b/"), "page_id")).otherwise(F.concat(F.lit("/etc/"), "page_id"))
    return table(spark, d, "pages").select("page_id", X.rewrite_uri(raw, "/ws/").alias("uri"))


@query("h8_package_keys", "SELECT p_partkey, unnest(list_distinct([lower(p_brand) || ':' || p_partkey, CAST(p_partkey AS VARCHAR), lower(p_brand) || '/' || p_partkey])) AS key FROM part")
def h8(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(X.package_keys(F.concat_ws(":", "p_brand", "p_partkey"))).alias("key"))


@query("h8_purl_parts", "SELECT p_partkey, 'npm' AS kind, 'a/b' AS namespace, 'x' || p_partkey AS name, '1.' || p_size AS version FROM part")
def h8b(spark, d):
    purl = F.concat(F.lit("pkg:npm/a/b/x"), "p_partkey", F.lit("@1."), "p_size", F.lit("?q=1#s"))
    return table(spark, d, "part").select("p_partkey", X.purl_type(purl).alias("kind"), X.purl_namespace(purl).alias("namespace"), X.purl_name(purl).alias("name"), X.purl_version(purl).alias("version"))


@query("h11_match_snippet", """WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS x, nullif(instr(lower(replace(text, chr(10), ' ')), 'the'), 0) AS hit FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN hit IS NULL THEN substr(x, 1, 160) ELSE CASE WHEN hit > 81 THEN '…' ELSE '' END || substr(x, greatest(hit - 80, 1), least(hit + 159, length(x)) - greatest(hit - 80, 1) + 1) || CASE WHEN hit + 159 < length(x) THEN '…' ELSE '' END END AS snippet FROM t""")
def h11(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.match_snippet(F.col("text"), ["the"]).alias("snippet"))


@query("f5_knowledge_search", """SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'thing', ''))) / 5 + (length(lower(text)) - length(replace(lower(text), 'lich', ''))) / 4 AS INT) AS score FROM documents WHERE text IS NOT NULL
  AND (length(lower(text)) - length(replace(lower(text), 'thing', ''))) / 5 + (length(lower(text)) - length(replace(lower(text), 'lich', ''))) / 4 > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def f5(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.term_score(F.col("text"), ["Thing", "lich"]).alias("score")).where("score > 0")
    return R.page(s, [F.desc("score"), F.col("doc_id")], 50)


@query("h13_dataflow_labels", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'SOURCE' WHEN event_type = 'view' THEN 'SINK' END AS role, 'v' || user_id AS value FROM events")
def h13(spark, d):
    label = F.concat(F.when(F.col("event_type") == "error", "Source").when(F.col("event_type") == "view", " sink ").otherwise("other"), F.lit(": 'v"), "user_id", F.lit("' @ a.py:3"))
    return table(spark, d, "events").select("event_id", X.dataflow_role(label).alias("role"), X.dataflow_value(label).alias("value"))


@query("h14_ecosystem", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE lower(p_brand) END AS ecosystem FROM part")
def h14(spark, d):
    return table(spark, d, "part").select("p_partkey", X.ecosystem(F.when(F.col("p_size") % 2 == 0, "pkg:NPM/x@1"), F.col("p_brand")).alias("ecosystem"))


@query("h16_line_kind", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'manifest' WHEN doc_id % 3 = 1 THEN 'import' ELSE CASE WHEN regexp_matches(trim(coalesce(text, ''), ' '), '^import[ \t]|require\\(|from [\"'']') THEN 'import' ELSE 'code' END END AS kind FROM documents")
def h16(spark, d):
    k = F.col("doc_id") % 3
    path = F.when(k == 0, "a/b/POM.xml").otherwise("a/b.py")
    return table(spark, d, "documents").select("doc_id", X.line_kind(path, F.when(k == 1, "  import x").otherwise(F.coalesce("text", F.lit("")))).alias("kind"))


@query("h20_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def h20(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("h25_normalized_reviews", "SELECT event_id, CASE event_type WHEN 'view' THEN 'TRUE_POSITIVE' ELSE 'UNCERTAIN' END AS verdict, CASE WHEN event_type = 'click' THEN 'CONFIRMED' END AS status, round(greatest(0.0, least(1.0, value - 1)), 6) AS confidence FROM events")
def h25(spark, d):
    e = table(spark, d, "events")
    said = X.mapped(F.col("event_type"), {"view": " true_positive ", "click": "confirmed"}, "other")
    return e.select("event_id", X.normalize_verdict(said).alias("verdict"), X.normalize_status(said).alias("status"), F.round(X.normalize_confidence(F.col("value") - 1), 6).alias("confidence"))


@query("h26_review_type", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'EXTERNAL' WHEN l_returnflag = 'R' THEN 'AI' ELSE 'HUMAN' END AS kind FROM lineitem")
def h26(spark, d):
    li = table(spark, d, "lineitem")
    kind = X.review_type(F.when(F.col("l_returnflag") == "A", "external").otherwise(" "), F.when(F.col("l_returnflag") == "R", "ai").otherwise("someone"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))


@query("h27_log_keywords", """WITH k(word, rank) AS (VALUES ('error', 4), ('the', 4), ('und', 3), ('que', 2)), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, max(rank) AS rank, count(*) AS matches FROM l JOIN k ON contains(lower(line), word) GROUP BY doc_id""")
def h27(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = R.log_signals(lines, ["doc_id"], "pos", "line", {"error": "HIGH", "the": "HIGH", "und": "MEDIUM", "que": "LOW"})
    return out.select("doc_id", X.severity_rank(F.col("severity")).alias("rank"), "matches")


@query("h28_stage_signal", "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'INFO' WHEN value > 0.8 THEN 'HIGH' WHEN user_id % 2 = 0 THEN 'LOW' END AS signal FROM events")
def h28(spark, d):
    return table(spark, d, "events").select("event_id", X.stage_signal(F.col("event_type") == "error", F.col("value"), F.col("user_id") % 2 == 0).alias("signal"))


@query("h29_artifact_path", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/x/' || o_custkey END AS path FROM orders")
def h29(spark, d):
    a = F.array(F.lit("log:/y"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sarif:/x/"), "o_custkey")).otherwise("none"), F.lit("sarif") )
    return table(spark, d, "orders").select("o_orderkey", X.artifact_path(a, "sarif:").alias("path"))


@query("h30_method_refs", "SELECT p_partkey, p_brand AS cls, 'm' || p_size AS name, p_size AS arity FROM part")
def h30(spark, d):
    ref = X.method_ref(F.col("p_brand"), F.concat(F.lit("m"), "p_size"), F.col("p_size"))
    return table(spark, d, "part").withColumn("r", X.parse_method_ref(ref)).select("p_partkey", "r.cls", "r.name", "r.arity")


@query("h32_ide_fingerprint", "SELECT l_orderkey, l_linenumber, l_partkey, sha256(l_returnflag || '|f' || l_suppkey || '|' || l_linenumber || '||m') AS fingerprint FROM lineitem")
def h32(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.ide_fingerprint(F.col("l_returnflag"), F.concat(F.lit("f"), "l_suppkey"), F.col("l_linenumber"), F.lit(None), F.lit("m")).alias("fingerprint"))


@query("h34_heap_tokens", "SELECT p_partkey, p_brand || '.a' AS base, 'f' || p_size AS field FROM part")
def h34(spark, d):
    t = X.parse_heap_token(X.heap_token(F.concat("p_brand", F.lit(".a")), F.concat(F.lit("f"), "p_size")))
    return table(spark, d, "part").withColumn("t", t).select("p_partkey", "t.base", "t.field")


@query("h22_line_context", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, n AS line_no, substr(line, 1, 400) AS content, n = 1 + doc_id % 5 AS highlight FROM l WHERE abs(n - (1 + doc_id % 5)) <= 2""")
def h22(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).select("doc_id", (F.col("i") + 1).alias("line_no"), "content")
    return R.line_context(docs.select("doc_id", (1 + F.col("doc_id") % 5).alias("at")), lines, ["doc_id"], 2)


@query("h23_preferred_line", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, n, regexp_matches(line, '^[ \t]*(//|#|\\*|/\\*|@)') OR trim(line) = '' AS note FROM l)
  SELECT d.doc_id, coalesce(CASE WHEN (SELECT bool_or(note) FROM c WHERE c.doc_id = d.doc_id AND n = 1) THEN (SELECT min(n) FROM c WHERE c.doc_id = d.doc_id AND n BETWEEN 2 AND 21 AND NOT note) END, 1) AS line_no FROM documents d WHERE text IS NOT NULL""")
def h23(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).select("doc_id", (F.col("i") + 1).alias("line_no"), "content")
    return R.preferred_line(docs.select("doc_id", F.lit(1).alias("at")), lines, ["doc_id"]).select("doc_id", "line_no")

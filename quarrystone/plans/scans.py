"""Report scans: Spark writes the driver's rows as report documents, and the readers take them apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import graph as G
from quarrystone.plans.registry import query, table
from quarrystone.sources import report_sink
from quarrystone.sources import reports as S
from quarrystone.storage import dealt, shared_dir, stored


def _lines(spark, d):
    """lineitem with small numbers as text parts of a finding."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), "l_partkey").alias("rule"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "R", "warning").alias("level"), F.col("l_linestatus").alias("ls"), F.col("l_quantity").cast("int").alias("q"))


def _documents(rows, key, item, build, ending):
    """One JSON document per key from its items, a handful each, written down as a scan would find them."""
    got = rows.groupBy(key).agg(F.collect_list(item).alias("items"))
    return stored(got.select(F.col(key).cast("string").alias("task_id"), F.concat(F.lit("/reports/"), F.col(key), F.lit(ending)).alias("path"), F.to_json(build(F.col("items"))).alias("value")), "reports")


def sarif(spark, d):
    flow = F.when(F.col("q") % 3 == 0, F.array(F.struct(F.array(F.struct(F.transform(F.sequence(F.lit(0), F.col("q") % 4), lambda k: F.struct(F.struct(
        F.struct(F.struct(F.concat(F.lit("src/f"), "s").alias("uri")).alias("artifactLocation"), F.struct((k + 1).alias("startLine")).alias("region")).alias("physicalLocation"),
        F.struct(F.concat(F.when(k == 0, "Source: '").otherwise("Sink: '"), "rule", F.lit("' @ line")).alias("text")).alias("message")).alias("location"))).alias("locations"))).alias("threadFlows"))))
    place = F.struct(F.struct(F.struct(F.concat(F.lit("src/f"), "s").alias("uri")).alias("artifactLocation"), F.struct(F.col("n").alias("startLine")).alias("region")).alias("physicalLocation"))
    item = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.concat(F.lit("m"), "q").alias("text")).alias("message"), F.when(F.col("q") % 5 > 0, F.array(place)).alias("locations"),
                    F.when(F.col("n") % 2 == 0, F.struct(F.concat_ws("-", "o", "n", "p").alias("primary"))).alias("fingerprints"), F.struct(F.when(F.col("q") == 1, "critical").alias("severity")).alias("properties"), flow.alias("codeFlows"))
    rules = lambda items: F.transform(items, lambda i: F.struct(i["ruleId"].alias("id"), F.struct(F.when(F.endswith(i["ruleId"], F.lit("0")), "note").alias("level")).alias("defaultConfiguration")))
    build = lambda items: F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit("x").alias("name"), rules(items).alias("rules")).alias("driver")).alias("tool"), items.alias("results"))).alias("runs"))
    return _documents(_lines(spark, d), "o", item, build, ".sarif")


_L = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, 'p' || l_partkey AS rule, l_partkey AS p, l_suppkey AS s, l_returnflag AS rf, CAST(l_quantity AS INT) AS q FROM lineitem)"


@query("a1_sarif_findings", f"""WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, rule AS rule_id,
  CASE WHEN q = 1 THEN 'CRITICAL' WHEN rf = 'A' THEN 'HIGH' WHEN rf = 'R' THEN 'MEDIUM' WHEN rule LIKE '%0' THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE WHEN q % 5 > 0 THEN 'src/f' || s ELSE 'unknown' END AS file, CASE WHEN q % 5 > 0 THEN n ELSE 0 END AS line,
  CASE WHEN n % 2 = 0 THEN o || '-' || n || '-' || p ELSE sha256(rule || '|' || CASE WHEN q % 5 > 0 THEN 'src/f' || s || '|' || n ELSE 'unknown|0' END) END AS fingerprint FROM l""")
def a1(spark, d):
    return S.findings(sarif(spark, d)).select("task_id", "rule_id", "severity", "file", "line", "fingerprint")


@query("a2_sarif_dataflow", f"WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, CAST(sum(q % 4 + 1) AS BIGINT) AS nodes, CAST(sum(q % 4) AS BIGINT) AS edges, count(*) AS sources FROM l WHERE q % 3 = 0 GROUP BY o")
def a2(spark, d):
    nodes, edges = S.sarif_dataflow(sarif(spark, d))
    n = nodes.groupBy("task_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("role") == "SOURCE").alias("sources"))
    return n.join(edges.groupBy("task_id").agg(F.count("*").alias("edges")), "task_id", "left").na.fill(0)


@query("d24_code_flows", f"WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, count(*) FILTER (WHERE q % 3 = 0) AS n FROM l GROUP BY o")
def d24(spark, d):
    return S.code_flows(sarif(spark, d)).select("task_id", "n")


@query("a3_semgrep_findings", f"""WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, rule AS rule_id, CASE WHEN rf = 'A' THEN 'HIGH' WHEN rf = 'R' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN n % 2 = 0 THEN 'fp' || p ELSE rule || ':src/f' || s || ':' || n END AS fingerprint FROM l""")
def a3(spark, d):
    item = F.struct(F.col("rule").alias("check_id"), F.concat(F.lit("src/f"), "s").alias("path"), F.struct(F.col("n").alias("line")).alias("start"),
                    F.struct(F.col("level").alias("severity"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("fp"), "p")).alias("fingerprint")).alias("extra"))
    docs = _documents(_lines(spark, d), "o", item, lambda items: F.struct(items.alias("results")), ".json")
    return S.findings(docs).select("task_id", "rule_id", "severity", "fingerprint")


def trivy(spark, d):
    item = F.struct(F.concat(F.lit("CVE-"), "p").alias("VulnerabilityID"), F.col("rule").alias("PkgName"), F.col("n").cast("string").alias("InstalledVersion"),
                    F.when(F.col("level") == "error", "critical").when(F.col("level") == "warning", "odd").otherwise("Low").alias("Severity"),
                    F.struct(F.concat(F.lit("pkg:npm/"), "rule", F.lit("@1")).alias("PURL")).alias("PkgIdentifier"),
                    F.when(F.col("n") % 2 == 0, F.concat(F.lit("https://x/"), "p")).alias("PrimaryURL"), F.when(F.col("level") == "error", F.concat(F.lit("t"), "q")).alias("Title"),
                    F.create_map(F.lit("nvd"), F.struct((F.col("q") / 10).alias("V3Score")), F.lit("ghsa"), F.struct(F.lit(2.5).alias("V3Score"))).alias("CVSS"))
    return _documents(_lines(spark, d), "o", item, lambda items: F.struct(F.array(F.struct(F.lit("t").alias("Target"), F.lit("npm").alias("Type"), items.alias("Vulnerabilities"))).alias("Results")), ".json")


@query("a6_trivy_issues", f"""WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, 'CVE-' || p AS vuln_id, CASE WHEN rf = 'A' THEN 'CRITICAL' WHEN rf = 'R' THEN 'INFO' ELSE 'LOW' END AS severity, 'npm' AS ecosystem,
  sha256('CVE-' || p || '|' || rule || '|' || n || '|pkg:npm/' || rule || '@1') AS issue_key, greatest(q / 10, 2.5) AS score, CASE WHEN q >= 25 THEN 'nvd' ELSE 'ghsa' END AS source FROM l""")
def a6(spark, d):
    return S.trivy_issues(trivy(spark, d)).select("task_id", "vuln_id", "severity", "ecosystem", "issue_key", F.col("cvss.score").alias("score"), F.col("cvss.source").alias("source"))


@query("a7_sbom_graph", """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS task_id, 'r' || l_partkey AS node, CASE WHEN l_partkey % 4 <> 0 THEN 'pkg:x/' ELSE 'r' END || l_partkey AS label, 1 AS n_out FROM lineitem""")
def a7(spark, d):
    """A bill of materials for each order."""
    p = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("r"), "l_partkey").alias("ref"), F.col("l_partkey").alias("k")).repartition("l_orderkey").distinct()  # dealt once, for the documents too
    item = F.struct("ref", "k")
    comp = lambda items: F.transform(F.filter(items, lambda i: i["k"] % 4 != 0), lambda i: F.struct(i["ref"].alias("bom-ref"), F.concat(F.lit("pkg:x/"), i["k"]).alias("purl")))
    deps = lambda items: F.transform(items, lambda i: F.struct(i["ref"].alias("ref"), F.array(i["ref"]).alias("dependsOn")))
    nodes, edges = S.sbom_graph(_documents(p, "l_orderkey", item, lambda items: F.struct(F.lit("cycloneDX").alias("bomFormat"), comp(items).alias("components"), deps(items).alias("dependencies")), ".json"))
    nodes = stored(nodes.select("task_id", "node", "label"), "sbom-nodes")
    return nodes.join(dealt(G.degrees(nodes, edges, ["task_id"])), ["task_id", "node"]).select("task_id", "node", "label", "n_out")


@query("a8_usage_index", "SELECT CAST(user_id AS VARCHAR) AS task_id, event_type AS key, CAST(json_extract_string(props, '$.k') AS INT) AS line, round(value, 3) AS confidence FROM events")
def a8(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("int").alias("line"), F.round("value", 3).alias("confidence"))
    docs = _documents(e, "user_id", F.struct("key", "line", "confidence"), lambda items: F.struct(F.lit("now").alias("generatedAt"), items.alias("entries")), ".json")
    return S.usage_entries(docs).select("task_id", "key", "line", "confidence")


@query("a10_sink_catalog", "SELECT DISTINCT p_brand AS sub_type, p_type AS cls, 'm' || p_size AS method FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_brand, p_type, '<init>' FROM part")
def a10(spark, d):
    return _catalog(spark, d)


def _catalog(spark, d):
    p = table(spark, d, "part")
    m = p.where("p_size % 2 = 0").groupBy("p_brand", "p_type").agg(F.collect_set(F.concat(F.lit("m"), "p_size")).alias("ms")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "ms"))).alias("methodSinks"))
    c = p.groupBy("p_brand").agg(F.collect_set("p_type").alias("constructorSinks")).join(m, "p_brand", "left")
    docs = c.select(F.lit("c").alias("task_id"), F.lit("/c.json").alias("path"), F.to_json(F.struct(F.lit(1).alias("formatVersion"), F.array(F.struct(F.col("p_brand").alias("subType"), "methodSinks", "constructorSinks")).alias("definitions"))).alias("value"))
    return S.sink_catalog(docs, p.select(F.col("p_brand").alias("sub_type")))


@query("c10_sink_calls", """WITH k AS (SELECT DISTINCT p_brand AS sub_type, p_type AS cls, 'm' || p_size AS method FROM part WHERE p_size % 2 = 0)
  SELECT s_suppkey AS call_id, sub_type FROM (SELECT s_suppkey, p_type AS cls, 'm' || p_size AS method FROM supplier JOIN part ON p_partkey = s_suppkey) JOIN k USING (cls, method)""")
def c10(spark, d):
    calls = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("call_id"), F.col("p_type").alias("cls"), F.concat(F.lit("m"), "p_size").alias("method"))
    return S.sinks_called(calls, _catalog(spark, d)).select("call_id", "sub_type")


@query("a4_report_routing", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'sarif' WHEN page_id % 4 = 1 THEN 'semgrep' END AS kind FROM pages")
def a4(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id") % 4
    path = F.concat("url", F.when(k == 0, ".sarif.json").when(k == 3, ".txt").otherwise(".json"))
    value = F.when(k == 1, F.to_json(F.struct(F.array(F.struct(F.col("html").alias("check_id"))).alias("results")))).when(k == 2, F.to_json(F.struct(F.length("html").alias("results")))).otherwise(F.col("html"))
    return p.select("page_id", S.report_format(path, value).alias("kind"))


@query("a17_report_dataset", "SELECT project, count(*) AS n FROM (SELECT o_custkey % 20 AS project, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 200 GROUP BY project")
def a17(spark, d):
    from quarrystone.plans.views import findings

    rows, _ = S.report_dataset(findings(spark, d).withColumn("project", F.col("project_id") % 20), ["project"], [F.desc("created_at"), F.col("finding_id")])
    return rows.groupBy("project").agg(F.count("*").alias("n"))


@query("a6_trivy_evidence", f"""WITH {_L} SELECT CAST(o AS VARCHAR) AS task_id, 'CVE-' || p AS vuln_id, 't' AS target, rule AS package, CASE WHEN n % 2 = 0 THEN 'https://x/' || p END AS url,
  CASE WHEN rf = 'A' THEN 't' || q END AS title, n % 2 = 0 AS has_url, rf = 'A' AS has_title FROM l""")
def a6_evidence(spark, d):
    """Location and evidence hold no nulls: a key is there or it is not."""
    t = S.trivy_issues(trivy(spark, d))
    place, said = (F.from_json(c, "map<string, string>") for c in ("location", "evidence"))  # each is parsed once
    return t.select("task_id", "vuln_id", place["target"].alias("target"), said["pkgName"].alias("package"), place["primaryUrl"].alias("url"), said["title"].alias("title"),
                    F.map_contains_key(place, "primaryUrl").alias("has_url"), F.map_contains_key(said, "title").alias("has_title"))


@query("a9_source_lines", """WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN '.github/Vendor/' ELSE 'src/' END || 'App' || doc_id || '.RB' WHEN doc_id % 4 = 1 THEN 'm' || doc_id || '/Cargo.toml' WHEN doc_id % 4 = 2 THEN 'a/node_modules/x' || doc_id || '.js' ELSE 'readme' || doc_id || '.md' END AS path
    FROM documents WHERE text IS NOT NULL AND strlen(text) <= 2097152)
  SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM f WHERE doc_id % 4 < 2""")
def a9(spark, d):
    """Documents as files of a source tree."""
    docs, k = table(spark, d, "documents").where("text is not null"), F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.when(F.col("doc_id") % 3 == 0, ".github/Vendor/").otherwise("src/"), F.lit("App"), "doc_id", F.lit(".RB"))).when(k == 1, F.concat(F.lit("m"), "doc_id", F.lit("/Cargo.toml"))).when(k == 2, F.concat(F.lit("a/node_modules/x"), "doc_id", F.lit(".js"))).otherwise(F.concat(F.lit("readme"), "doc_id", F.lit(".md")))
    return S.lines_of_sources(docs.select(path.alias("path"), F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content")))


@query("a14_outbox", "SELECT o_orderkey AS event_id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def a14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("PROCESSED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return S.pending_after(o, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).select("event_id", "created_at")


@query("a16_json_sink", "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_brand")
def a16(spark, d):
    """Written as JSON in folders by brand and read again."""
    path = shared_dir(spark, "json-sink")
    S.write_json(table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", "p_size"), path, "brand")
    return spark.read.schema("p_partkey long, p_size long, brand string").json(path).groupBy("brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("a16_report_documents", """SELECT 't' || (p_partkey // 50) AS task_id, CAST(p_partkey AS INT) AS line, p_brand AS rule_id, CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity,
  CASE WHEN p_size % 2 = 0 THEN '/work/t' || (p_partkey // 50) || '/a.py' ELSE '/work/t' || (p_partkey // 50) || '/b/' || p_size || '.py' END AS file, p_name AS message FROM part""")
def a16_documents(spark, d):
    """Findings written as one SARIF document per task, URIs rewritten on the way, and read again."""
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("t"), F.expr("p_partkey div 50")).alias("task_id"), F.lit("r").alias("report"), F.lit(0).alias("run"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("rule_id"), F.when(size > 25, "HIGH").otherwise("LOW").alias("severity"),
        F.col("p_name").alias("message"), F.when(size % 2 == 0, "file:///src/a.py").otherwise(F.concat(F.lit("b/"), size, F.lit(".py"))).alias("file"), F.col("p_partkey").cast("int").alias("line"), F.col("p_partkey").cast("string").alias("fingerprint"))
    path = shared_dir(spark, "report-documents")
    report_sink.write_documents(report_sink.sarif_documents(rows, "scan", "/work"), path)
    return S.sarif_findings(S.read_reports(spark, path)).select("task_id", "line", "rule_id", "severity", "file", "message")

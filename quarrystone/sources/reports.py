"""Scanner reports as DataFrames: one row per report (task_id, path, value), then `from_json` with fixed schemas.

`read_reports` gives that shape for a folder of files; the parsers take it from anywhere. Reports that are not
valid JSON, or of another format, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import expr as X

_PLACE = "STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT, startColumn: INT, endLine: INT, endColumn: INT, snippet: STRUCT<text: STRING>>>"
_FLOWS = f"codeFlows: ARRAY<STRUCT<threadFlows: ARRAY<STRUCT<locations: ARRAY<STRUCT<location: STRUCT<physicalLocation: {_PLACE}, message: STRUCT<text: STRING>>>>>>>>"
_RESULT = f"""ruleId: STRING, level: STRING, message: STRUCT<text: STRING>, locations: ARRAY<STRUCT<physicalLocation: {_PLACE}>>,
    fingerprints: MAP<STRING, STRING>, properties: STRUCT<severity: STRING>"""
SARIF = f"runs ARRAY<STRUCT<results: ARRAY<STRUCT<{_RESULT}>>>>"
SARIF_FLOWS = f"runs ARRAY<STRUCT<results: ARRAY<STRUCT<ruleId: STRING, {_FLOWS}>>>>"
_TOOL = "tool: STRUCT<driver: STRUCT<rules: ARRAY<STRUCT<id: STRING, defaultConfiguration: STRUCT<level: STRING>>>>>"
SARIF_RULES = f"runs ARRAY<STRUCT<{_TOOL}>>"
SARIF_BOTH = f"runs ARRAY<STRUCT<results: ARRAY<STRUCT<{_RESULT}>>, {_TOOL}>>"
SEMGREP = """results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT, col: INT>, `end`: STRUCT<line: INT, col: INT>,
  extra: STRUCT<message: STRING, severity: STRING, fingerprint: STRING, fix: STRING, lines: STRING>>>"""
TRIVY = """Results ARRAY<STRUCT<Target: STRING, Class: STRING, Type: STRING, Vulnerabilities: ARRAY<STRUCT<VulnerabilityID: STRING, PkgName: STRING,
  InstalledVersion: STRING, FixedVersion: STRING, Severity: STRING, PrimaryURL: STRING, PkgIdentifier: MAP<STRING, STRING>, PURL: STRING, Title: STRING,
  Description: STRING, PublishedDate: STRING, LastModifiedDate: STRING, References: ARRAY<STRING>, CVSS: MAP<STRING, STRUCT<V3Score: DOUBLE, V3Vector: STRING>>>>>>"""
CYCLONEDX = """bomFormat STRING, components ARRAY<STRUCT<`bom-ref`: STRING, bomRef: STRING, name: STRING, version: STRING, purl: STRING>>,
  dependencies ARRAY<STRUCT<ref: STRING, dependsOn: ARRAY<STRING>>>"""
USAGE = """generatedAt STRING, scannedFiles INT, entries ARRAY<STRUCT<ecosystem: STRING, key: STRING, file: STRING, line: INT, kind: STRING, snippet: STRING,
  language: STRING, symbol: STRING, receiver: STRING, callee: STRING, startLine: INT, startCol: INT, endLine: INT, endCol: INT, confidence: DOUBLE>>"""
SINKS = """formatVersion INT, definitions ARRAY<STRUCT<subType: STRING, methodSinks: MAP<STRING, ARRAY<STRING>>, constructorSinks: ARRAY<STRING>, isCall: BOOLEAN>>"""


def read_reports(spark: SparkSession, path: str, task_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """(task_id, path, value) of each file below the path; the task is taken from the file's path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select(F.regexp_extract("path", task_pattern, 1).alias("task_id"), "path", "value")


def is_sarif(path):
    return F.lower(path).rlike(r"\.sarif(\.json)?$")


def report_format(path, value):
    """sarif or semgrep, or null for files that are neither."""
    low = F.lower(path)
    results = F.get_json_object(value, "$.results")
    return F.when(is_sarif(path), "sarif").when(low.rlike(r"\.json$") & F.startswith(results, F.lit("[")), "semgrep")


#: Characters up to which a report counts as short: its results look their rules up in the report itself.
SHORT = 1 << 14


def _rows(reports: DataFrame, schema: str) -> DataFrame:
    # Spark would give each field that is taken a parser of its own; with an option it does not
    return reports.select("task_id", "path", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))


def _each(df: DataFrame, items: str, pos: str, item: str, *cols: str | Column) -> DataFrame:
    """`posexplode` of an array: (cols..., pos, item). Of an outer one Spark infers no filter on the array, which would parse each report once more."""
    return df.select(*cols, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def _runs(reports: DataFrame, schema: str) -> DataFrame:
    """(task_id, report, run, x): a row for each run."""
    return _each(_rows(reports, schema), "j.runs", "run", "x", "task_id", F.col("path").alias("report"))


def _results(reports: DataFrame, schema: str) -> DataFrame:
    """(task_id, report, run, pos, r): a row for each result."""
    return _each(_runs(reports, schema), "x.results", "pos", "r", "task_id", "report", "run")


def sarif_rules(reports: DataFrame) -> DataFrame:
    """(report, run, rule, rule_level): each rule's default level; of two rules with one id the last counts."""
    each = _each(_runs(reports, SARIF_RULES), "x.tool.driver.rules", "pos", "u", "report", "run")
    return each.where("u.id is not null").groupBy("report", "run", F.col("u.id").alias("rule")).agg(F.max_by("u.defaultConfiguration.level", "pos").alias("rule_level"))


def sarif_results(reports: DataFrame) -> DataFrame:
    """(report, run, rule, task_id, pos, r, rule_level, level): results with the level they have, or else their rule gives them.

    Short reports are read once and shuffled nowhere; in long ones, where each result would go through many rules, results meet `sarif_rules`.
    """
    short = F.coalesce(F.length("value") <= SHORT, F.lit(True))
    columns = ["report", "run", "rule", "task_id", "pos", "r", "rule_level"]
    here = _each(_runs(reports.where(short), SARIF_BOTH), "x.results", "pos", "r", "task_id", "report", "run", F.col("x.tool.driver.rules").alias("rules"))
    named = F.filter("rules", lambda u: u["id"] == F.col("r.ruleId"))  # of two rules with one id the last counts
    here = here.withColumn("rule", F.col("r.ruleId")).withColumn("rule_level", F.try_element_at(named, F.lit(-1))["defaultConfiguration"]["level"])
    long = reports.where(~short)
    met = _results(long, SARIF).withColumn("rule", F.col("r.ruleId")).join(sarif_rules(long), ["report", "run", "rule"], "left")
    return here.select(*columns).unionByName(met.select(*columns)).withColumn("level", F.coalesce(X.blank_to_null(F.col("r.level")), F.col("rule_level")))


def sarif_findings(reports: DataFrame) -> DataFrame:
    """Findings of SARIF reports. The first location counts: path `unknown` without one, empty where it has no uri.

    A missing fingerprint is made from rule, path and line, so that a rerun gives the same.
    """
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    path = F.when(F.get("r.locations", F.lit(0)).isNull(), "unknown").otherwise(F.coalesce(place["artifactLocation"]["uri"], F.lit("")))
    rule, line = F.coalesce(X.blank_to_null(F.col("r.ruleId")), F.lit("unknown")), F.coalesce(place["region"]["startLine"], F.lit(0))
    prints = F.map_values("r.fingerprints")
    print_ = F.coalesce(F.try_element_at("r.fingerprints", F.lit("primary")), F.get(prints, F.lit(0)), F.sha2(F.concat_ws("|", rule, path, line.cast("string")), 256))
    return sarif_results(reports).select(
        "task_id", "report", "run", "pos", rule.alias("rule_id"), X.sarif_severity(F.col("level"), F.col("r.properties.severity")).alias("severity"), F.lit("OPEN").alias("status"),
        F.coalesce(X.blank_to_null(F.col("r.message.text")), F.lit("finding")).alias("message"), path.alias("file"), line.alias("line"), print_.alias("fingerprint"), F.lit("semgrep").alias("source_engine"),
    )


def sarif_dataflow(reports: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (task_id, report, run, pos, id, label, role, value, file, line) and edges (..., source, target) of code flows.

    The first `most` locations of a thread flow count; node numbers run on through a result.
    """
    flows = F.flatten(F.transform(F.coalesce(F.col("r.codeFlows"), F.array()), lambda c: F.transform(F.coalesce(c["threadFlows"], F.array()), lambda t: F.slice(F.coalesce(t["locations"], F.array()), 1, most))))
    key = ["task_id", "report", "run", "pos"]
    each = _results(reports, SARIF_FLOWS).select(*key, flows.alias("flows"))
    starts = F.transform(F.sequence(F.lit(0), F.size("flows") - 1), lambda k: F.reduce(F.slice("flows", 1, k), F.lit(0), lambda n, f: n + F.size(f)))
    each = each.where(F.size("flows") > 0).select(*key, F.explode(F.arrays_zip(F.col("flows").alias("f"), starts.alias("s"))).alias("z"))
    loc = each.select(*key, F.col("z.s").alias("s"), F.posexplode("z.f").alias("i", "l"))
    label = F.col("l.location.message.text")
    nodes = loc.select(
        *key, "i", F.concat(F.lit("n"), F.col("s") + F.col("i")).alias("id"), F.trim(F.substring_index(label, " @", 1)).alias("label"), X.dataflow_role(label).alias("role"),
        X.dataflow_value(label).alias("value"), F.col("l.location.physicalLocation.artifactLocation.uri").alias("file"), F.col("l.location.physicalLocation.region.startLine").alias("line"),
    )
    number = F.col("s") + F.col("i")  # a location's place tells the one before it
    edges = loc.where("i > 0").select(*key, F.concat(F.lit("n"), number - 1).alias("source"), F.concat(F.lit("n"), number).alias("target"))
    return nodes.drop("i"), edges


def code_flows(reports: DataFrame) -> DataFrame:
    """(task_id, report, n): code flows of each report."""
    return _results(reports, SARIF_FLOWS).groupBy("task_id", "report").agg(F.sum(F.coalesce(F.size("r.codeFlows"), F.lit(0))).alias("n"))


def semgrep_findings(reports: DataFrame) -> DataFrame:
    """The same columns from Semgrep's own JSON."""
    r = _each(_rows(reports, SEMGREP), "j.results", "pos", "r", "task_id", F.col("path").alias("report"))
    rule, line = F.coalesce(X.blank_to_null(F.col("r.check_id")), F.lit("semgrep.unknown")), F.coalesce("r.start.line", F.lit(0))
    path = F.coalesce("r.path", F.lit("unknown"))
    return r.select(
        "task_id", "report", F.lit(0).alias("run"), "pos", rule.alias("rule_id"), X.sarif_severity(X.semgrep_level(F.col("r.extra.severity"))).alias("severity"), F.lit("OPEN").alias("status"),
        F.coalesce(X.blank_to_null(F.col("r.extra.message")), F.lit("finding")).alias("message"), path.alias("file"), line.alias("line"),
        F.coalesce(X.blank_to_null(F.col("r.extra.fingerprint")), F.concat_ws(":", rule, path, line.cast("string"))).alias("fingerprint"), F.lit("semgrep").alias("source_engine"),
    )


def findings(reports: DataFrame) -> DataFrame:
    """All findings of a mixed set of reports, each by its format."""
    # SARIF is told by the path alone: asking for the format would look into all other reports
    return sarif_findings(reports.where(is_sarif(F.col("path")))).unionByName(semgrep_findings(reports.where(report_format(F.col("path"), F.col("value")) == "semgrep")))


def trivy_issues(reports: DataFrame) -> DataFrame:
    """Vulnerabilities of Trivy reports; rows without an id are dropped, unknown severities are INFO."""
    t = _each(_each(_rows(reports, TRIVY), "j.Results", "_i", "t", "task_id"), "t.Vulnerabilities", "_k", "v", "task_id", "t.Target", "t.Class", "t.Type")
    purl = X.first_text(F.try_element_at("v.PkgIdentifier", F.lit("PURL")), F.try_element_at("v.PkgIdentifier", F.lit("Purl")), F.col("v.PURL"))
    cvss = F.transform(F.map_entries("v.CVSS"), lambda e: F.struct(e["key"].alias("source"), F.coalesce(e["value"]["V3Score"], F.lit(0.0)).alias("score")))
    text = lambda c: X.blank_to_null(F.col(c))
    place = F.struct(F.col("Target").alias("target"), F.col("Class").alias("class"), F.col("Type").alias("type"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("installedVersion"),
                     F.col("v.FixedVersion").alias("fixedVersion"), F.col("v.PrimaryURL").alias("primaryUrl"), purl.alias("purl"))
    refs = F.array_distinct(F.filter(F.transform(F.col("v.References"), F.trim), lambda x: x != ""))
    evidence = F.struct(F.col("v.Title").alias("title"), F.col("v.Description").alias("description"), F.col("v.Severity").alias("severity"), F.col("v.PublishedDate").alias("publishedDate"),
                        F.col("v.LastModifiedDate").alias("lastModifiedDate"), F.when(F.size(refs) > 0, refs).alias("references"), F.col("v.CVSS").alias("cvss"), F.col("v.PkgName").alias("pkgName"),
                        F.col("v.InstalledVersion").alias("installedVersion"), F.col("v.FixedVersion").alias("fixedVersion"), F.col("v.PrimaryURL").alias("primaryUrl"), F.col("Target").alias("target"), purl.alias("purl"))
    return t.where(text("v.VulnerabilityID").isNotNull()).select(
        "task_id", text("v.VulnerabilityID").alias("vuln_id"), F.col("v.PkgName").alias("package"), F.col("v.InstalledVersion").alias("version"), F.col("v.FixedVersion").alias("fixed_version"),
        purl.alias("purl"), X.trivy_severity(F.col("v.Severity")).alias("severity"), F.lit("OPEN").alias("status"), X.ecosystem(purl, F.col("Type")).alias("ecosystem"),
        X.sca_issue_key(text("v.VulnerabilityID"), F.col("v.PkgName"), F.col("v.InstalledVersion"), purl).alias("issue_key"), text("v.Title").alias("title"), text("v.Description").alias("description"),
        refs.alias("references"), X.best_cvss(cvss).alias("cvss"), F.col("Target").alias("target"),
        F.to_json(place).alias("location"), F.to_json(evidence).alias("evidence"),  # without what is null
    )


def sbom_graph(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (task_id, node, label, name, version, purl) and edges (task_id, source, target) of CycloneDX files."""
    b, good = _rows(reports, CYCLONEDX), F.lower("j.bomFormat") == "cyclonedx"
    about = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("purl"))
    none = F.array().cast("array<struct<node: string, m: struct<name: string, version: string, purl: string>>>")
    at = lambda node: F.struct(node.alias("node"), F.when(F.lit(False), about).alias("m"))
    told = F.transform("j.components", lambda c: F.struct(X.first_text(c["bom-ref"], c["bomRef"]).alias("node"), F.struct(c["name"], c["version"], c["purl"]).alias("m")))
    refs = F.filter("j.dependencies", lambda d: d["ref"].isNotNull())
    named = F.flatten(F.transform(refs, lambda d: F.transform(F.concat(F.array(d["ref"]), F.coalesce(d["dependsOn"], F.array().cast("array<string>"))), at)))
    every = F.concat(*[F.coalesce(part, none) for part in (told, named)])  # all nodes that a file names, in one reading
    each = _each(b.withColumn("_every", F.when(good, every)), "_every", "_i", "e", "task_id").where("e.node is not null")
    one = each.groupBy("task_id", F.col("e.node").alias("node")).agg(F.max("e.m").alias("m"))
    label = F.coalesce(X.blank_to_null(F.col("m.purl")), F.when(X.blank_to_null(F.col("m.name")).isNotNull(), F.concat_ws("@", "m.name", "m.version")), F.col("node"))
    nodes = one.select("task_id", "node", label.alias("label"), "m.name", "m.version", "m.purl")
    edges = _each(b.withColumn("_deps", F.when(good, F.col("j.dependencies"))), "_deps", "_i", "d", "task_id").select("task_id", F.col("d.ref").alias("source"), F.explode("d.dependsOn").alias("target"))
    return nodes, edges.where("source is not null and target is not null").distinct()


def usage_entries(reports: DataFrame) -> DataFrame:
    """(task_id, pos, entry columns...) of usage indexes."""
    return _rows(reports, USAGE).select("task_id", F.posexplode("j.entries").alias("pos", "e")).select("task_id", "pos", "e.*")


def sink_catalog(reports: DataFrame, known: DataFrame) -> DataFrame:
    """(sub_type, cls, method): method sinks, and constructor sinks with method <init>; version 1 and known types (sub_type) only."""
    d = _rows(reports, SINKS).where("j.formatVersion = 1").select(F.explode("j.definitions").alias("d")).join(known.select(F.col("sub_type").alias("_known")).distinct(), F.col("d.subType") == F.col("_known"), "left_semi")
    methods = d.select("d.subType", F.explode("d.methodSinks").alias("cls", "ms")).select(F.col("subType").alias("sub_type"), "cls", F.explode("ms").alias("method"))
    return methods.union(d.select("d.subType", F.explode("d.constructorSinks").alias("cls"), F.lit("<init>"))).distinct()


def sinks_called(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls: (call_id, cls, method): a row for each sink type a call may be."""
    return calls.join(catalog, ["cls", "method"]).select("call_id", "cls", "method", "sub_type")


#: Folders that a source scan leaves out, by their exact names (fixed values).
SKIPPED = (".git", ".svn", ".hg", ".idea", ".vscode", ".gradle", "node_modules", "vendor", "target", "build", "dist", "out", ".next")
#: Files that a source scan reads, by name or ending, in lower case (fixed values).
NAMES = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "go.mod", "go.sum", "requirements.txt", "poetry.lock", "cargo.toml", "cargo.lock", "gemfile",
)
ENDINGS = (".java", ".kt", ".kts", ".go", ".js", ".jsx", ".ts", ".tsx", ".py", ".rb", ".php", ".cs", ".rs", ".xml", ".yml", ".yaml")


def source_lines(spark: SparkSession, root: str, most_bytes: int = 2 << 20) -> DataFrame:
    """(path, line_no, line) of the source files below a root: folders of tools and vendors and large files left out.

    Spark's file listing passes over names that begin with a dot or an underscore. Folders of such names are listed here and
    read as roots of their own; files of such names can't be read this way (`lines_of_sources` takes them from elsewhere).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *_passed_over(spark, root)])
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    rel = F.regexp_replace("path", "^file:/+", "/")
    rel = F.substring(rel, len(base.removeprefix("file:").replace("//", "")) + 1, 1 << 30)
    return lines_of_sources(files.withColumn("path", F.regexp_replace(rel, "^/+", "")), most_bytes)


def _passed_over(spark: SparkSession, root: str) -> list[str]:
    """Folders below a root whose names begin with a dot or an underscore, without those of SKIPPED. Only folders are gone through, on the driver, as Spark's listing does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [path]
    while todo:
        for status in fs.listStatus(todo.pop()):
            name = status.getPath().getName()
            if status.isDirectory() and name not in SKIPPED:
                todo.append(status.getPath())
                if name[0] in "._":
                    found.append(status.getPath().toString())
    return found


def lines_of_sources(files: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """files: (path below the root, length, content). (path, line_no, line) of those that a source scan reads; case counts in folders' names only."""
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    skipped = F.col("path").rlike("(^|/)(" + "|".join(f.replace(".", r"\.") for f in SKIPPED) + ")/")
    known = name.isin(*NAMES) | name.rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$")
    picked = files.where((F.col("length") <= most_bytes) & ~skipped & known)
    lines = picked.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("i", "line"))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), "line")


def pending_after(outbox: DataFrame, since, status: str = "status", created: str = "created_at", key: str = "event_id", most: int = 100) -> DataFrame:
    """The outbox source: PENDING rows created at or after `since`, oldest first, at most `most`."""
    return outbox.where((F.col(status) == "PENDING") & (F.col(created) >= F.lit(since))).orderBy(created, key).limit(most)


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    """The graph and report sink: a JSON document per row, in folders by `partition_by`."""
    df.write.partitionBy(*partition_by).json(path)


def report_dataset(findings_: DataFrame, keys: list[str], order: list, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """The newest `most` findings of each report, and how many of each severity those are."""
    from quarrystone.operators.relational import first_n

    rows = first_n(findings_, keys, order, most)
    return rows, rows.groupBy(*keys, "severity").agg(F.count("*").alias("n"))

"""Operators on small rows: graphs against plain Python, report readers, mutations, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import graph as G
from quarrystone.operators import kpi as K
from quarrystone.operators import relational as R
from quarrystone.operators import upsert as U
from quarrystone.operators import value_flow as V
from quarrystone.operators.components import connected_components
from quarrystone.plans import details, graphs, registry  # noqa: F401  they fill the registry
from quarrystone.sources import reports as S
from quarrystone.streaming import agents, jobs


def random_graph(seed, n=9, m=12):
    rng = random.Random(seed)
    return list(range(n)), sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def below(edges, node):
    seen, todo = {node}, [node]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def frames(spark, graphs):
    nodes = [(g, n, "SINK" if n == 3 and g % 2 else "x", ["CRITICAL", "HIGH", "LOW", "odd"][(n + g) % 4]) for g, (ns, _) in enumerate(graphs) for n in ns]
    edges = [(g, a, b) for g, (_, es) in enumerate(graphs) for a, b in es]
    return spark.createDataFrame(nodes, "g int, node int, role string, severity string"), spark.createDataFrame(edges, "g int, source int, target int")


GRAPHS = [random_graph(s) for s in range(6)] + [([0, 1, 2], [(0, 1), (1, 2), (2, 0)]), ([5, 7], [])]


def test_worst_and_closure(spark):
    nodes, edges = frames(spark, GRAPHS)
    rank = {"CRITICAL": 5, "HIGH": 4, "LOW": 2, "odd": 0}
    sev = {(r.g, r.node): rank[r.severity] for r in nodes.collect()}
    got = {(r.g, r.node): r["rank"] for r in G.subtree_worst(nodes, edges, ["g"]).collect()}
    assert got == {(g, n): max(sev[g, x] for x in below(es, n)) for g, (ns, es) in enumerate(GRAPHS) for n in ns}
    up = {(r.g, r.node, r.ancestor) for r in G.closure(edges, ["g"]).collect()}
    assert up == {(g, n, x) for g, (ns, es) in enumerate(GRAPHS) for n in ns for x in below(es, n) - {n}}


def plain_chains(ns, es, sinks, most=20):
    out = {n: sorted(b for a, b in es if a == n) for n in ns}
    starts = [n for n in ns if not any(b == n for _, b in es)] or ns
    found = []

    def walk(path):
        if path[-1] in sinks or not out[path[-1]]:
            found.append(path)
            return
        for nxt in out[path[-1]]:
            if nxt not in path:
                walk([*path, nxt])

    for s in starts:
        walk([s])
    return sorted(found)[:most] or [sorted(ns)]


def test_chains(spark):
    nodes, edges = frames(spark, GRAPHS)
    got = {}
    for r in G.chains(nodes, edges, ["g"], most=10_000).collect():
        got.setdefault(r.g, []).append(list(r.chain))
    for g, (ns, es) in enumerate(GRAPHS):
        assert sorted(got[g]) == plain_chains(ns, es, {3} if g % 2 else set(), 10_000)


@pytest.mark.parametrize("nodes,edges,sinks,want", [
    (range(5), [(0, 1), (2, 3), (3, 4)], {1, 4}, [[0, 1], [2, 3, 4]]),
    (range(4), [(0, 1), (1, 3), (0, 2), (2, 3)], set(), [[0, 1, 3], [0, 2, 3]]),
])
def test_known_chains(spark, nodes, edges, sinks, want):
    n = spark.createDataFrame([(1, x, "SINK" if x in sinks else "") for x in nodes], "g int, node int, role string")
    e = spark.createDataFrame([(1, *x) for x in [*edges, (0, 99)]], "g int, source int, target int")
    assert sorted(list(r.chain) for r in G.chains(n, e, ["g"]).collect()) == want


DEAD_ENDS = (list(range(101)), [(r, 21 + 2 * r) for r in range(20)] + [e for r in range(20) for e in ((21 + 2 * r, 22 + 2 * r), (22 + 2 * r, 21 + 2 * r))] + [(20, 99), (20, 100)])


@pytest.mark.parametrize("most", [1, 2, 20])
def test_capped_chains_are_the_first(spark, most):
    """Paths under way that die in cycles take no room from real chains."""
    graphs = [*GRAPHS, *(random_graph(s, 7, 14) for s in range(20, 26)), DEAD_ENDS]
    nodes, edges = frames(spark, graphs)
    nodes = nodes.where("node not between 61 and 98")  # no node of an edge: DEAD_ENDS has no other roots
    got = {}
    for r in G.chains(nodes, edges, ["g"], most=most).collect():
        got.setdefault(r.g, []).append(list(r.chain))
    for g, (ns, es) in enumerate(graphs):
        ns = [n for n in ns if not 61 <= n <= 98]
        assert sorted(got[g]) == plain_chains(ns, es, {3} if g % 2 else set(), most)


def plain_callers(es, target, most, depth):
    found = []

    def walk(path):
        callers = sorted({a for a, b in es if b == path[-1]})
        if len(path) > depth or not callers:
            found.append(path[::-1])
        else:
            for c in callers:
                if c not in path:
                    walk([*path, c])

    walk([target])
    return sorted(found[:most])


@pytest.mark.parametrize("most,depth", [(2, 10), (20, 10), (20, 3)])
def test_capped_caller_chains_are_the_first(spark, most, depth):
    ring = [(a, b) for a in range(1, 25) for b in (0, a + 100)] + [(a + 100, a) for a in range(1, 25)] + [(30, 0), (31, 30)]
    graphs = [*(random_graph(s, 7, 14)[1] for s in range(20, 24)), ring]
    calls = spark.createDataFrame([(g, a, b) for g, es in enumerate(graphs) for a, b in es], "g int, source int, target int")
    targets = spark.createDataFrame([(g, t) for g in range(len(graphs)) for t in (0, 3)], "g int, node int")
    got = {}
    for r in G.caller_chains(calls, targets, ["g"], most=most, depth=depth).collect():
        got.setdefault((r.g, r.target), []).append(list(r.chain))
    for g, es in enumerate(graphs):
        for t in (0, 3):
            assert sorted(got.get((g, t), [])) == plain_callers(es, t, most, depth)


def test_all_entries_of_unreached_targets(spark):
    entries = spark.range(1, 25_001).select(F.col("id").alias("node"))
    calls = spark.createDataFrame([(1, 30_000)], "source long, target long")
    targets = spark.createDataFrame([(30_000,), (30_001,), (7,)], "node long")
    out = G.entry_points_reaching(calls, targets, entries)
    assert sorted(map(tuple, out.fillna(-1, ["entry"]).collect())) == [(7, 7, False), (30_000, 1, False), (30_001, -1, True)]
    assert {r.target: r["count"] for r in G.every_entry(out, entries).groupBy("target").count().collect()} == {7: 1, 30_000: 1, 30_001: 25_000}
    keyed = lambda df, *k: df.crossJoin(spark.createDataFrame([(x,) for x in k], "g int")).select("g", *df.columns)
    out = G.entry_points_reaching(keyed(calls, 1, 2), keyed(targets, 1, 2), keyed(entries, 1), ["g"])
    assert sorted(map(tuple, out.fillna(-1, ["entry"]).collect())) == [(1, 7, 7, False), (1, 30_000, 1, False), (1, 30_001, -1, True)]


def test_daily_trend_of_each_group(spark):
    e = spark.sql("select * from values (1, 'a', timestamp'2024-01-02 05:00:00'), (1, 'a', timestamp'2024-01-02 23:59:59'), (1, 'b', timestamp'2024-01-03 00:00:00'), (2, 'c', timestamp'2024-01-03 00:00:00') t(user, kind, ts)")
    out = K.daily_trend(e.where("kind = 'a'"), e.where("kind = 'b'"), "ts", "ts", "2024-01-01", "2024-01-03", ["user"], e)
    assert sorted((r.user, r.day.day, r.new, r.closed) for r in out.collect()) == [(1, 1, 0, 0), (1, 2, 2, 0), (1, 3, 0, 1), (2, 1, 0, 0), (2, 2, 0, 0), (2, 3, 0, 0)]


def test_traces_of_a_deep_tree(spark, tmp_path):
    """The only hit lies 12 steps above the lowest node, and every node is a start."""
    line = [1_000_007]
    while line[-1] >= 3:
        line.append(line[-1] // 3)
    rows = [(n, 4 if n == line[-1] else 2, "b") for n in line]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("j8_backward_traces") == [(n, line[-1]) for n in sorted(line[:-1])]
    assert run("j9_forward_traces") == [(n, 1) for n in sorted(line[1:])]
    assert run("j10_chain_traces") == [(n, line[-1]) for n in sorted(line[:-1])]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 3), (4, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_traces_points_to_heap(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (5, 6)], "source int, target int")
    starts = spark.createDataFrame([(1,), (5,)], "start int")
    ends = spark.createDataFrame([(4, 1), (3, 2)], "node int, priority int")
    got = {(r.start, tuple(r.path), r.priority) for r in G.traces(edges, starts, ends).collect()}
    assert got == {(1, (1, 2, 4), 1), (1, (1, 2, 3), 2), (5, (5, 6), 1 << 20)}
    sets, _ = G.points_to(edges, spark.createDataFrame([(1, 10), (5, 20), (3, 30)], "node int, root int"), most=1)
    got = {r.node: (list(r.roots), r.truncated) for r in sets.collect()}
    assert got == {1: ([10], True), 2: ([10], True), 3: ([10], True), 4: ([10], True), 5: ([20], False), 6: ([20], False)}
    cols = "id int, method string, cls string, base int, field string"
    reads = spark.createDataFrame([(1, "m", "A", 5, "f")], cols)
    writes = spark.createDataFrame([(2, "n", "A", 6, "f"), (3, "n", "B", 77, "f"), (4, "m", "A", 5, "f"), (5, "n", "A", 6, "g")], cols)
    got = {(r.read, r.write, r.score) for r in G.heap_matches(reads, writes, sets).collect()}
    assert got == {(1, 2, 11), (1, 3, 0)}


def test_first_edge_paths(spark):
    n, e = frames(spark, [([0, 1, 2, 3], [(0, 1), (0, 2), (3, 2)]), ([0, 1, 2], [(0, 1), (1, 0), (2, 1)]), ([0, 1], [(0, 1), (1, 0)])])
    got = sorted((r.g, list(r.path)) for r in G.first_edge_paths(n, e, ["g"]).collect())
    assert got == [(0, [0, 1]), (0, [3, 2]), (1, [2, 1, 0]), (2, [0, 1])]


def reports(spark, *docs):
    return spark.createDataFrame([("t1", f"/r/{i}{end}", d if isinstance(d, str) else json.dumps(d)) for i, (end, d) in enumerate(docs)], "task_id string, path string, value string")


def test_sarif_cases(spark):
    loc = lambda uri, line: [{"physicalLocation": {"artifactLocation": {"uri": uri} if uri is not None else {}, "region": {"startLine": line}}}]
    steps = [{"location": {"message": {"text": f"{w}: 'x{i}' @ l"}, "physicalLocation": {"artifactLocation": {"uri": "a"}, "region": {"startLine": i}}}} for i, w in enumerate(["Source", "Propagator", "Sink"])]
    run = {"tool": {"driver": {"rules": [{"id": "r1", "defaultConfiguration": {"level": "note"}}, {"id": "r1", "defaultConfiguration": {"level": "error"}}]}}, "results": [
        {"ruleId": "test.rule", "level": "warning", "message": {"text": "m"}, "locations": loc("src/App.kt", 10), "fingerprints": {"primary": "fp-1"}},
        {"ruleId": "r1", "locations": loc(None, 3)}, {"message": {"text": " "}, "level": "error", "properties": {"severity": "Critical"}},
        {"ruleId": "f", "codeFlows": [{"threadFlows": [{"locations": steps}, {"locations": steps[:1]}]}]}]}
    rep = reports(spark, (".sarif", {"version": "2.1.0", "runs": [run]}), (".sarif", {"runs": []}), (".sarif", "no json"), (".json", {"results": [{"check_id": "rule.json", "path": "src/App.kt", "start": {"line": 2, "col": 3}, "extra": {"severity": "WARNING", "fingerprint": "fp-json"}}]}), (".json", {"results": 3}), (".txt", "x"))
    got = sorted((r.rule_id, r.severity, r.file, r.line, r.message) for r in S.findings(rep).collect())
    assert got == [("f", "INFO", "unknown", 0, "finding"), ("r1", "HIGH", "", 3, "finding"), ("rule.json", "MEDIUM", "src/App.kt", 2, "finding"), ("test.rule", "MEDIUM", "src/App.kt", 10, "m"), ("unknown", "CRITICAL", "unknown", 0, "finding")]
    nodes, edges = S.sarif_dataflow(rep)
    assert sorted((r.id, r.role, r.value, r.label) for r in nodes.collect()) == [("n0", "SOURCE", "x0", "Source: 'x0'"), ("n1", "PROPAGATOR", "x1", "Propagator: 'x1'"), ("n2", "SINK", "x2", "Sink: 'x2'"), ("n3", "SOURCE", "x0", "Source: 'x0'")]
    assert sorted((r.source, r.target) for r in edges.collect()) == [("n0", "n1"), ("n1", "n2")]


def test_trivy_and_sbom(spark):
    v = {"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "odd", "PkgIdentifier": {"PURL": " pkg:npm/p@1 "}, "CVSS": {"a": {"V3Score": 5.0}, "b": {"V3Score": 5.0}, "c": {}}}
    got = S.trivy_issues(reports(spark, ("", {"Results": [{"Target": "x", "Vulnerabilities": [v, {**v, "VulnerabilityID": " "}]}, {"Target": "y", "Vulnerabilities": [v]}]}), ("", {"Results": "none"}))).collect()
    assert len(got) == 2 and len({r.issue_key for r in got}) == 1
    assert (got[0].severity, got[0].purl, got[0].cvss.source, got[0].ecosystem) == ("INFO", "pkg:npm/p@1", "a", "npm")
    bom = {"bomFormat": "CycloneDX", "components": [{"bom-ref": "a", "name": "A", "version": "1"}, {"bom-ref": "b", "purl": "pkg:x/b"}], "dependencies": [{"ref": "a", "dependsOn": ["b", "c"]}, {"ref": "b", "dependsOn": ["a"]}]}
    nodes, edges = S.sbom_graph(reports(spark, ("", bom), ("", {**bom, "bomFormat": "other"})))
    assert {r.node: r.label for r in nodes.collect()} == {"a": "A@1", "b": "pkg:x/b", "c": "c"}
    assert {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "a")}


def test_files(spark, tmp_path):
    (tmp_path / "t9" / "node_modules").mkdir(parents=True)
    (tmp_path / "t9" / "a.py").write_text("import x\ny = 1")
    (tmp_path / "t9" / "node_modules" / "b.py").write_text("no")
    (tmp_path / "t9" / "c.bin").write_text("no")
    for path, text in ((".github/workflows/ci.yml", "on: push"), ("Vendor/x.go", "package x"), ("vendor/y.go", "no"), (".gradle/z.xml", "no"), ("xvendor/.next/w.js", "no")):
        (tmp_path / "t9" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t9" / path).write_text(text)
    got = sorted((r.path, r.line_no, r.line) for r in S.source_lines(spark, str(tmp_path)).collect())
    assert got == [("t9/.github/workflows/ci.yml", 1, "on: push"), ("t9/Vendor/x.go", 1, "package x"), ("t9/a.py", 1, "import x"), ("t9/a.py", 2, "y = 1")]
    (tmp_path / "r" / "t1").mkdir(parents=True)
    (tmp_path / "r" / "t1" / "x.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "q"}]}]}, indent=1))
    assert [(r.task_id, r.rule_id) for r in S.findings(S.read_reports(spark, str(tmp_path / "r"))).collect()] == [("t1", "q")]


def test_ingest_twice_is_once(spark):
    cols = "finding_id int, project_id int, fingerprint string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
    found = spark.sql("select 1 finding_id, 1 project_id, 'a' fingerprint, 'OPEN' status, timestamp_ntz'2024-01-01' created_at, cast(null as timestamp_ntz) updated_at, cast(null as timestamp_ntz) deleted_at union all select 2, 1, 'a', 'OPEN', timestamp_ntz'2024-01-02', null, null")
    empty, now = spark.createDataFrame([], cols), F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    once = U.ingest_findings(empty, found, now)
    again = U.ingest_findings(once, found, now).collect()
    assert [(r.finding_id, r.updated_at is not None) for r in again] == [(1, True)]


def test_expressions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    L = F.lit
    assert one(X.sarif_severity(L(None).cast("string"), L(None).cast("string")))[0] == "INFO"
    assert one(X.purl_match_keys(L("pkg:npm/@scope/x@1"), L(None).cast("string"), L("X ")))[0] == ["pkg:npm/@scope/x@1", "x"]
    assert one(X.node_keys(L("a:b"), L("pkg:maven/g/n@1")))[0] == ["a:b", "b", "a/b", "n", "g:n", "g/n"]
    assert one(X.rewrite_uri(L("https://x/y"), "/ws"), X.rewrite_uri(L("/src/a"), "/ws"), X.rewrite_uri(L("a"), "/ws")) == ("https://x/y", "/ws/a", "/ws/a")
    assert one(X.match_snippet(L("x" * 200 + "\nkey" + "y" * 300), ["none", "KEY"]))[0].startswith("…" + "x" * 79 + " key")
    assert X.parse_window("12h") == (12, "HOUR") and X.parse_window("xd") == (7, "DAY") and X.parse_window("") == (7, "DAY")
    assert one(X.log_visible(L(None).cast("string"), "WARN"), X.log_visible(L("debug"), "WARN"), X.log_visible(L("warn"), "ERROR")) == (False, True, False)
    assert one(X.normalize_confidence(L("3")), X.normalize_confidence(L("x")))[0] == 1.0
    assert one(X.usage_tokens(L("pkg:maven/org.a/libname@1"), L("abc")))[0] == ["org.a", "libname"]


def test_ranges_and_prefixes(spark):
    r = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 7, 9), (1, 2, 2)], "k int, s int, e int")
    assert sorted(map(tuple, R.merged_ranges(r, ["k"], "s", "e").collect())) == [(1, 1, 5), (1, 7, 9)]
    n, g = spark.createDataFrame([("org.a.B",), ("org.ab",), ("x",)], "n string"), spark.createDataFrame([("org",), ("org.a",)], "grp string")
    assert sorted(map(tuple, R.longest_prefix(n, g, "n", "grp", ".").collect())) == [("org.a.B", "org.a"), ("org.ab", "org")]


def test_stage_machine_over_batches(spark, tmp_path):
    """Two micro-batches: out of order within one, events of the wrong stage and after the end are ignored."""
    cols = "task_id string, task_type string, stage_id string, stage_type string, event string, status string, at timestamp"
    plan = list(jobs.SCA_PLAN)
    ev = lambda t, i, stage, status="SUCCEEDED", event="StageCompleted": (t, "SCA_CHECK", f"s{i}", stage, event, status, i)
    one = [ev("a", 2, plan[1]), ev("a", 1, plan[0]), ev("b", 1, plan[0]), ev("b", 2, plan[2]), ev("c", 1, plan[0], "FAILED"), ev("d", 1, plan[0], "RUNNING", "StageUpdated")]
    two = [ev("a", 3, plan[2], "SKIPPED", "StageUpdated"), ev("a", 4, plan[3]), ev("c", 2, plan[1])]
    day = 86_400
    later = [[ev("z", 3 * day, plan[0])], [ev("z", 3 * day + 1, plan[1])], [ev("a", 3 * day + 2, plan[0]), ev("b", 3 * day + 2, plan[1])]]
    for k, rows in enumerate((one, two, *later)):
        df = spark.createDataFrame([(*r[:-1], 1_700_000_000 + r[-1]) for r in rows], cols.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = []
        jobs.run_once(jobs.task_states(spark.readStream.schema(cols).parquet(str(tmp_path / "in"))), str(tmp_path / "cp"), lambda b, i: out.extend(map(tuple, b.collect())), "update")
        got = {t: (p, s) for t, p, s in out}
        if k == 0:
            assert got == {"a": (2, "RUNNING"), "b": (1, "RUNNING"), "c": (0, "FAILED"), "d": (0, "RUNNING")}
        if k == 1:
            assert got == {"a": (4, "SUCCEEDED"), "c": (0, "FAILED")}
    assert got == {"a": (1, "RUNNING"), "b": (2, "RUNNING")}  # a had ended and was dropped, b goes on


def test_agents(spark):
    df = spark.createDataFrame([(1, "error", 99.0), (2, "view", 99.0)], "event_id int, event_type string, value double")
    names = ["quarrystone.plans.streams:StageSignal", "stage-signal"]
    assert len(agents.run_agents(df, names, "event_id").collect()) == 2
    with pytest.raises(KeyError):
        agents.load("unknown")
    out = agents.enriched(df.withColumn("path", F.lit("a.py")), [(lambda p: p.endswith(".py"), lambda s: s + "!")], "path", "event_type")
    assert [r.event_type for r in out.orderBy("event_id").collect()] == ["error!", "view!"]


def test_agents_from_sql(spark):
    agents.register_sql(spark)
    spark.createDataFrame([(1, "error", 99.0), (2, "view", 99.0), (3, "error", 1.0), (4, "error", 60.0)], "event_id int, event_type string, value double").createOrReplaceTempView("sql_events")
    name = "quarrystone.plans.streams:StageSignal"
    out = spark.sql(f"SELECT * FROM review_agents(TABLE(sql_events) PARTITION BY (event_type) ORDER BY (event_id), 'event_id', '{name}, {name}')")
    assert out.schema["event_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, out.collect())) == [(i, name, "HIGH", f"event {i}") for i in (1, 1, 4, 4)]
    for args in (f"'none', '{name}'", "'event_id', 'nobody'"):
        with pytest.raises(Exception, match="no column none|no agent is named nobody"):
            spark.sql(f"SELECT * FROM review_agents(TABLE(sql_events), {args})").collect()
    plan = agents.run_agents(spark.table("sql_events"), [name], "event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "event_type" in plan


def test_enrichers_see_only_what_they_support(spark):
    def python_only(code):
        if code.str.contains("java").any():
            raise ValueError("not Python")
        return code.str.upper()

    rows = [("a.py", "x"), ("b.java", "java"), (None, "none"), ("c.py", None), ("d.kt", "y")]
    df = spark.createDataFrame(rows, "path string, code string")
    steps = [(lambda p: p.endswith(".py"), python_only), (lambda p: p.endswith((".py", ".kt")), lambda c: c + "!"), (lambda p: False, lambda c: 1 / 0)]
    got = {r.path: r.code for r in agents.enriched(df, steps, "path", "code").collect()}
    assert got == {"a.py": "X!", "b.java": "java", None: "none", "c.py": None, "d.kt": "y!"}


def test_preceding_against_plain_version(spark):
    rng = random.Random(8)
    edges = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3, 5, 8, 8])) for i in range(40)]
    contexts = [(rng.choice("abc"), 100 + i, rng.choice([None, 0, 2, 4, 8, 9])) for i in range(25)]
    out = R.preceding(spark.createDataFrame(edges, "k string, e int, offset int"), spark.createDataFrame(contexts, "k string, ctx int, place int"), ["k"], "offset", "place", ["ctx"], "e")
    want = []
    for k, c, at in contexts:
        hit = [(e, o) for kk, e, o in edges if kk == k and (o is None or at is None or o <= at)]
        hit.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        want += [(k, c, e) for e, _ in hit[:3]]
    assert sorted((r.k, r.ctx, r.e) for r in out.collect()) == sorted(want)


def test_heap_matches_against_plain_version(spark):
    rng = random.Random(9)
    side = lambda n: [(i, f"m{rng.randrange(4)}", f"c{rng.randrange(3)}", rng.randrange(12), f"f{rng.randrange(2)}") for i in range(n)]
    reads, writes = side(40), side(60)
    sets = {b: ([rng.randrange(5) for _ in range(rng.randint(1, 3))], rng.random() < 0.2) for b in range(9)}  # 9 to 11 are unknown
    sets = {b: (sorted(set(r)), cut) for b, (r, cut) in sets.items()}
    cols = "id int, method string, cls string, base int, field string"
    out = G.heap_matches(spark.createDataFrame(reads, cols), spark.createDataFrame(writes, cols), spark.createDataFrame([(b, r, c) for b, (r, c) in sets.items()], "node int, roots array<int>, truncated boolean"), most=5)
    want = []
    for i, m, c, b, f in reads:
        found = []
        for j, m2, c2, b2, f2 in writes:
            if f != f2 or m == m2:
                continue
            x, y = sets.get(b), sets.get(b2)
            common = len(set(x[0]) & set(y[0])) if x and y else 0
            if not x or not y or x[1] or y[1] or common:
                found.append((-(10 * (c == c2) + common), j))
        want += [(i, j, -s) for s, j in sorted(found)[:5]]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_first_edge_paths_with_many_cycles(spark):
    rng = random.Random(10)
    nodes = list(range(60))
    edges = sorted({(a, rng.choice(nodes)) for a in nodes for _ in range(rng.randint(0, 2))})
    first = {}
    for a, b in edges:
        first.setdefault(a, b)
    into, touched, want = {b for _, b in edges}, set(), {}

    def follow(n):
        path = [n]
        while path[-1] in first and first[path[-1]] not in path and len(path) < 50:
            path.append(first[path[-1]])
        touched.update(path)
        want[n] = path

    for n in nodes:
        if n not in into:
            follow(n)
    for n in nodes:
        if n not in touched:
            follow(n)
    out = G.first_edge_paths(spark.createDataFrame([("g", n) for n in nodes], "g string, node int"), spark.createDataFrame([("g", a, b) for a, b in edges], "g string, source int, target int"), ["g"])
    assert {r.start: list(r.path) for r in out.collect()} == want


def test_tokens_are_no_patterns(spark):
    lines = ["see a.b here", "see aXb here", "C:\\Eval (x", "[brackets]", "nothing"]
    tokens = ["a.b", "\\E", "(x", "[BRACKETS]", " ", None]
    out = R.lines_with_tokens(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    low = [t.strip().lower() for t in tokens if t and t.strip()]
    assert sorted(map(tuple, out.collect())) == sorted((x, t) for x in lines for t in low if t in x.lower())


def test_ship_from_another_folder(tmp_path):
    """Workers that don't have the package on their path get it from the driver."""
    import os
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "job.py").write_text(f"""
import sys; sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
from quarrystone.shipping import ship
from quarrystone.streaming import agents
from quarrystone.plans import streams
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
events = spark.createDataFrame([(1, "error", 99.0), (2, "view", 99.0)], "event_id long, event_type string, value double")
print("GOT", [r.event_id for r in agents.run_agents(events, ["quarrystone.plans.streams:StageSignal"], "event_id").collect()])
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "GOT [1]" in said.stdout, said.stderr[-2000:]


def random_flow(seed):
    rng = random.Random(seed)
    methods = [f"m{i}" for i in range(7)]
    token = lambda: rng.choice(["a", "b", "c", "PARAM:0", "PARAM:1", "RET", "f", "CALLRET@4", "UNKNOWN:x"])
    at = lambda: rng.choice([None, 1, 3, 5, 9])
    within = lambda n: [(rng.choice(methods), token(), token(), at()) for _ in range(n)]
    calls = [(rng.choice(methods), rng.choice([*methods[1:], "C#<init>"]), at(), token(), [token(), token()], token()) for _ in range(12)]
    return methods, within(30), within(6), within(6), calls, [("m3", "a", "svc")]


def plain_roots(edges, start, methods, depth=10):
    """Breadth-first by rounds with the latest offset of a node: end -> (priority, depth)."""
    entry, called = methods
    inf = 1 << 31

    def offset(tok, at):
        n = tok[8:] if tok.startswith("CALLRET@") else tok.rpartition("@")[2] if tok.startswith("ALLOC:") and "@" in tok else ""
        return at if at is None or not n.isdigit() else max(at, int(n))

    def rank(m, t, d):
        for k, yes in (("bean", t.startswith("BEAN:")), ("entry", m in entry), ("alloc", t.startswith("ALLOC:")), ("unknown", t.startswith("UNKNOWN")), ("no_caller", m not in called), ("depth", d >= depth)):
            if yes:
                return V.PRIORITY[k]
        return None

    m, t, at = start
    if rank(m, t, 0) is not None:
        return {(m, t): (rank(m, t, 0), 0)}
    front, seen, out = {(m, t): offset(t, at)}, {}, {}
    key = lambda o: inf if o is None else o
    seen[m, t] = key(offset(t, at))
    for d in range(1, depth + 1):
        nxt = {}
        for (m, t), at in front.items():
            ways = [e for e in edges if e[:2] == (m, t) and (e[5] in V.ELSEWHERE or e[4] is None or at is None or e[4] <= at)]
            for kind in {e[5] for e in ways}:
                some = sorted((e for e in ways if e[5] == kind), key=lambda e: (-(e[4] if e[4] is not None else -1), e[3]))
                for _, _, m2, t2, o, _ in some[:3] if kind in V.LATEST else some:
                    o2 = offset(t2, at if o is None else o)
                    if (m2, t2) not in nxt or key(o2) > key(nxt[m2, t2]):
                        nxt[m2, t2] = o2
        nxt = {n: o for n, o in nxt.items() if n not in seen or seen[n] < key(o)}
        for n, o in nxt.items():
            seen[n] = key(o)
            r = rank(*n, d)
            if r is not None:
                out[n] = min(out.get(n, (99, 99)), (r, d))
        front = {n: o for n, o in nxt.items()}
    return out


@pytest.mark.parametrize("seed", [2])
def test_value_flow_against_plain_version(spark, seed):
    names, copies, loads, stores, calls, injected = random_flow(seed)
    of = lambda rows, cols: spark.createDataFrame(rows, cols)
    call_rows = of(calls, "method string, callee string, offset int, receiver string, args array<string>, result string")
    edges = V.flow_edges(of(copies, "method string, left string, right string, offset int"), of(loads, "method string, target string, source_field string, offset int"), of(stores, "method string, target_field string, value string, offset int"), call_rows, of(injected, "method string, token string, bean string"))
    called = {c for _, c, *_ in calls if c != "C#<init>"} - {"m0"}
    methods = of([(m, m == "m1", m in called, 2) for m in names], "method string, entry boolean, called boolean, n_params int")
    starts = [(i, m, t, o) for i, (m, t, o) in enumerate((m, t, o) for m in names[2:] for t in ("a", "b", "RET") for o in (None, 4))]
    got = {}
    frame = of(starts, "start int, method string, token string, offset int")
    for r in V.traces_to_roots(edges, frame, methods, best=1000).collect():
        assert len(r.kinds) == len(r.path) - 1 == r.depth
        got.setdefault(r.start, {})[tuple(r.path[-1])] = (r.priority, r.depth)
    plain = [tuple(e) for e in edges.collect()]
    want = {i: plain_roots(plain, s, ({"m1"}, called)) for i, *s in starts}
    assert got == {i: w for i, w in want.items() if w}
    first = {r.start: r for r in V.traces_to_roots(edges, frame, methods, best=1).collect()}
    assert all((r.priority, r.depth) == min(want[i].values()) for i, r in first.items())
    step = {(e[0], e[1], e[2], e[3]) for e in plain}
    trips = V.round_trips(edges, frame, methods, call_rows.where("callee <> 'C#<init>'")).collect()
    for r in trips:
        assert tuple(r.path[0]) == tuple(starts[r.start][1:3])
        assert all((*a, *b) in step for a, b in zip(r.path, r.path[1:]))
    assert {i for i, w in want.items() if w} <= {r.start for r in trips}


def test_pairs_of_a_hot_field_stay_linear(spark):
    """A thousand writers alike: those that meet the reads are as many as a read's cap asks for, the result is that of all pairs."""
    writers = [(i, f"m{i % 3 if i % 7 else 9}", "C", 1, "f") for i in range(1000)]
    cols = "id int, method string, cls string, base int, field string"
    kept = G.foremost(spark.createDataFrame(writers, cols), ["field", "cls", "base"], "method", "id", 25)
    assert kept.count() <= 50
    sets = spark.createDataFrame([(1, [7], False)], "node int, roots array<int>, truncated boolean")
    out = G.heap_matches(spark.createDataFrame([(5000, "m9", "C", 1, "f"), (5001, "m1", "D", 1, "f")], cols), spark.createDataFrame(writers, cols), sets).collect()
    for read, method in ((5000, "m9"), (5001, "m1")):
        assert sorted(r.write for r in out if r.read == read) == [i for i, m, *_ in writers if m != method][:25]


def test_heap_roots_of_other_types(spark):
    cols = "id int, method string, cls string, base int, field string"
    reads, writes = spark.createDataFrame([(1, "a", "A", 10, "T#f"), (2, "a", "A", 12, "T#f")], cols), spark.createDataFrame([(3, "b", "B", 11, "T#f"), (4, "c", "B", 13, "T#f")], cols)
    sets = spark.createDataFrame([(10, ["ALLOC:S@1", "ALLOC:U"], False), (11, ["ALLOC:U"], False), (12, ["BEAN:S"], False), (13, ["ALLOC:S@1", "BEAN:S"], False)], "node int, roots array<string>, truncated boolean")
    above = spark.createDataFrame([("S", "T"), ("U", "V")], "node string, ancestor string")
    got = sorted(map(tuple, G.heap_matches(reads, writes, sets, above=above).collect()))
    assert got == [(1, 3, 0), (1, 4, 1), (2, 3, 0), (2, 4, 1)]  # U is no T: the base of 3 has no root left and is unknown
    assert (1, 3, 1) in set(map(tuple, G.heap_matches(reads, writes, sets).collect()))


def test_gradle_matches_without_a_cap(spark):
    rng = random.Random(3)
    packages = [f"org.group{i % 40}:artifact-{i}" for i in range(400)] + ["a:b", "G:x", " "]
    lines = [(i, f"  implementation '{rng.choice(packages).upper()}:1.{i}' // {rng.choice(packages)}") for i in range(200)] + [(900, None), (901, "")]
    out = R.gradle_matches(spark.createDataFrame(lines, "n int, line string"), spark.createDataFrame([(p,) for p in packages], "package string"), "n", "line", "package")
    want = sorted((n, p) for n, line in lines for p in packages if line and p.strip() and p.strip().lower() in line.lower())
    assert sorted((r.n, r.package) for r in out.collect()) == want


def test_evidence_is_cut_by_key_before_it_meets_issues(spark):
    issues = [(i, 1, ["k", "k", f"k{i}"]) for i in range(20)] + [(50, 2, ["k"])]
    entries = [(p, 1, " K ") for p in range(300)] + [(p, 1, f"k{p % 20}") for p in range(300, 400)] + [(5, 1, "k3"), (7, 2, "k")]
    out = R.matched_evidence(spark.createDataFrame(issues, "i int, g int, keys array<string>"), spark.createDataFrame(entries, "pos int, g int, entry string"), "i", "g", "keys", "entry", "pos", 4)
    want = sorted((i, p) for i, g, keys in issues for p in sorted({p for p, h, e in entries if h == g and e.strip().lower() in keys})[:4])
    assert sorted((r.i, r.pos) for r in out.collect()) == want


def test_traces_count_states_in_all(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, 10 * i) for i in range(1, 6)] + [(20, 21), (90, 91)], "source int, target int")
    starts, ends = spark.createDataFrame([(0,), (90,)], "start int"), spark.createDataFrame([(30, 1), (21, 2)], "node int, priority int")
    every = {(r.start, r.path[-1]): r.truncated for r in G.traces(edges, starts, ends, best=None, states=100).collect()}
    assert every == {(0, 30): False, (0, 21): False, (0, 10): False, (0, 40): False, (0, 50): False, (90, 91): False}
    some = {(r.start, r.path[-1]): r.truncated for r in G.traces(edges, starts, ends, best=None, states=8).collect()}  # 0, 1 to 5, 10, 20
    assert some == {(0, 10): True, (90, 91): False}

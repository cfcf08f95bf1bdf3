"""Reports are parsed once for each use, and short ones are shuffled nowhere."""

import json

import pytest

from quarrystone.operators import graph as G
from quarrystone.sources import reports as S
from tests.test_whole_jobs import shuffled

REPORT = "task_id string, path string, value string"


def parses(*frames):
    return sum(df._jdf.queryExecution().optimizedPlan().toString().count("from_json") for df in frames)


def test_short_reports_look_their_rules_up_without_a_shuffle(spark):
    """results and rules were read apart and both shuffled. Long reports still meet their rules in a join."""
    rules = [{"id": "a", "defaultConfiguration": {"level": "error"}}, {"id": "a", "defaultConfiguration": {"level": "note"}}, {"id": "b", "defaultConfiguration": {"level": "error"}}, {"id": "b"}, {"defaultConfiguration": {"level": "error"}}]
    results = [{"ruleId": "a"}, {"ruleId": "a", "level": "error"}, {"ruleId": "b", "level": " "}, {"ruleId": "c"}, {}]
    report = lambda more: json.dumps({"runs": [{"results": None}, None, {"results": results, "tool": {"driver": {"rules": rules}}}, {"results": results[:1]}], "more": more})
    docs = [(str(i), f"/{i}.sarif", report("x" * (S.SHORT if i == 0 else 0))) for i in range(200)] + [("bad", "/bad.sarif", "{"), ("none", "/none.sarif", None)]
    frame = spark.createDataFrame(docs, REPORT)
    one = [(2, 0, "note", "note"), (2, 1, "error", "note"), (2, 2, None, None), (2, 3, None, None), (2, 4, None, None), (3, 0, None, None)]
    before = shuffled(spark)
    got = [(r.task_id, r.run, r.pos, r.level, r.rule_level) for r in S.sarif_results(frame).collect()]
    assert sorted(got, key=str) == sorted([(str(i), *row) for i in range(200) for row in one], key=str)
    assert shuffled(spark) - before < 30


def test_bills_of_materials_are_parsed_once_for_nodes_and_once_for_edges(spark):
    """nodes were put together from four readings, each with filters that parsed the file again."""
    bom = lambda kind: json.dumps({"bomFormat": kind, "components": [{"bom-ref": "a", "name": "A", "version": "1"}, {"bomRef": "b", "purl": "pkg:x/b"}, {"name": "lost"}, {"bom-ref": "a", "name": "B", "version": "0"}],
                                   "dependencies": [{"ref": "a", "dependsOn": ["b", "c", None, "b"]}, {"ref": "d"}, {"dependsOn": ["z"]}]})
    docs = [("1", "/1.json", bom("cycloneDX")), ("2", "/2.json", bom("spdx")), ("3", "/3.json", "{"), ("4", "/4.json", None), ("5", "/5.json", json.dumps({"bomFormat": "CycloneDX", "dependencies": [{"ref": "x"}]}))]
    nodes, edges = S.sbom_graph(spark.createDataFrame(docs, REPORT))
    assert sorted((r.task_id, r.node, r.label, r.name) for r in nodes.collect()) == [("1", "a", "B@0", "B"), ("1", "b", "pkg:x/b", None), ("1", "c", "c", None), ("1", "d", "d", None), ("5", "x", "x", None)]
    assert sorted(map(tuple, edges.collect())) == [("1", "a", "b"), ("1", "a", "c")]
    assert parses(nodes) == parses(edges) == 1


def test_degrees_count_ends_outside_the_nodes_for_no_node(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "a"), (2, None)], "g int, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "x"), (1, "x", "a"), (None, "a", "a"), (2, None, None), (1, "b", None)], "g int, source string, target string")
    got = sorted(map(tuple, G.degrees(nodes, edges, ["g"]).collect()), key=str)
    assert got == sorted([(1, "a", 1, 2), (1, "b", 1, 1), (None, "a", 0, 0), (2, None, 0, 0)], key=str)


@pytest.mark.parametrize("kind", ["semgrep", "trivy"])
def test_results_are_parsed_once(spark, kind):
    """filters that Spark infers for what it explodes parsed each report again."""
    semgrep, trivy = {"results": [{"check_id": "r"}, None]}, {"Results": [None, {"Vulnerabilities": [{"VulnerabilityID": "v"}, {}]}, {"Vulnerabilities": None}]}
    frame = spark.createDataFrame([("1", "/1.json", json.dumps(semgrep if kind == "semgrep" else trivy)), ("2", "/2.json", "[")], REPORT)
    df = S.semgrep_findings(frame) if kind == "semgrep" else S.trivy_issues(frame)
    assert len(df.collect()) == (2 if kind == "semgrep" else 1)
    assert parses(df) == 1


def test_edges_of_code_flows_need_no_shuffle(spark):
    """each location was shuffled to meet the one before it."""
    place = lambda t: {"location": {"message": {"text": t}}}
    flows = [{"threadFlows": [{"locations": [place("a"), place("b"), place("c")]}, {"locations": [place("d")]}, {"locations": None}]}, {"threadFlows": [{"locations": [place("e"), place("f")]}]}, {}]
    report = json.dumps({"runs": [{"results": [{"codeFlows": flows}, {}, {"codeFlows": flows[:1]}]}]})
    before = shuffled(spark)
    nodes, edges = S.sarif_dataflow(spark.createDataFrame([("1", "/1.sarif", report)], REPORT))
    assert sorted((r.pos, r.id, r.label) for r in nodes.collect()) == [(0, f"n{i}", x) for i, x in enumerate("abcdef")] + [(2, f"n{i}", x) for i, x in enumerate("abcd")]
    assert sorted((r.pos, r.source, r.target) for r in edges.collect()) == [(0, "n0", "n1"), (0, "n1", "n2"), (0, "n4", "n5"), (2, "n0", "n1"), (2, "n1", "n2")]
    assert shuffled(spark) == before


def test_only_json_files_that_are_not_sarif_are_looked_into(spark):
    """each reading of SARIF reports asked all others for their results."""
    docs = [("1", "/1.json", json.dumps({"results": [{"check_id": "r"}]})), ("2", "/2.SARIF.json", json.dumps({"results": [{"check_id": "r"}], "runs": [{"results": [{"ruleId": "s"}]}]})), ("3", "/3.txt", "{}"), ("4", "/4.json", json.dumps({"results": "["})), (None, None, None)]
    df = S.findings(spark.createDataFrame(docs, REPORT))
    assert sorted((r.task_id, r.rule_id) for r in df.collect()) == [("1", "r"), ("2", "s")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1


def test_evidence_is_parsed_once_a_row(spark):
    """six readings of two small documents in each row."""
    from quarrystone.plans.registry import QUERIES

    plan = QUERIES["a6_trivy_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "json_object_keys" not in plan

"""Report documents under known names, and attempts that fail."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import report_sink as K
from quarrystone.sources import reports as S


def settled(path):
    """The files once tasks that were still writing when their job failed have cleared up."""
    for _ in range(40):
        if not files(path):
            break
        time.sleep(0.25)
    return files(path)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_documents_are_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    cols = "task_id string, report string, run int, pos int, rule_id string, severity string, message string, file string, line int, fingerprint string"
    rows = [(f"t{k % 3}", "r", 0, k, f"rule{k % 4}", ["HIGH", "LOW", "CRITICAL"][k % 3], f'says "{k}"', ["src/a.py", "/src/b.py", "file:///src/c.py"][k % 3], k, f"fp{k}") for k in range(20)]
    K.write_documents(K.sarif_documents(spark.createDataFrame(rows, cols).repartition(4), "stage-1", "/work"), path)
    assert files(path) == [f"t{k}/stage-1.sarif.json" for k in range(3)]
    back = S.sarif_findings(S.read_reports(spark, path)).select("task_id", "pos", "rule_id", "severity", "message", "file", "line", "fingerprint").collect()
    want = [(t, rule, severity, message, "/work/" + t + "/" + f.rsplit("src/")[-1] if f != "src/a.py" else f"/work/{t}/src/a.py", line, fp) for t, _, _, _, rule, severity, message, f, line, fp in rows]
    assert sorted((r.task_id, *r[2:]) for r in back) == sorted(want)
    assert [r.pos for r in sorted(back, key=lambda r: (r.task_id, r.line))] == [i for k in range(3) for i in range(len(range(k, 20, 3)))]


def test_graphs_are_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    nodes = spark.createDataFrame([("t1", "a", "A@1"), ("t1", "b", "B"), ("t2", "a", "other")], "task_id string, node string, label string")
    edges = spark.createDataFrame([("t1", "a", "b"), ("t1", "a", "b")], "task_id string, source string, target string")
    K.write_documents(K.graph_documents(nodes, edges, "deps"), path, "cdx.json")
    assert files(path) == ["t1/deps.cdx.json", "t2/deps.cdx.json"]
    got_nodes, got_edges = S.sbom_graph(S.read_reports(spark, path))
    assert {(r.task_id, r.node, r.label) for r in got_nodes.collect()} == {tuple(r) for r in nodes.collect()}
    assert {(r.task_id, r.source, r.target) for r in got_edges.collect()} == {("t1", "a", "b")}


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(f"t{i}", "s", "{}") for i in range(6)], "task string, stage string, document string").repartition(3)
    bad = docs.withColumn("document", F.when(F.col("task") == "t5", F.raise_error(F.lit("no document"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="no document"):
        K.write_documents(bad, path)
    assert settled(path) == []
    for rows in ([("../x", "s", "{}")], [("t", "s", "{}"), ("t", "s", "[]")]):
        with pytest.raises(Exception, match="not a name|more than one"):
            K.write_documents(spark.createDataFrame(rows, "task string, stage string, document string"), path)
    assert settled(path) == []
    K.write_documents(docs, path)
    K.write_documents(docs.where("task = 't1'").withColumn("document", F.lit("[]")), path)
    assert files(path) == [f"t{i}/s.sarif.json" for i in range(6)] and (tmp_path / "out" / "t1" / "s.sarif.json").read_text() == "[]"

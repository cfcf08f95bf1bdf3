"""Default branches, parents and children of types, snippets of dataflow nodes."""

import json

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import graph as G
from quarrystone.operators import relational as R


def test_default_branch_and_its_commits(spark):
    repos = spark.createDataFrame([(1, " ", "refs/heads/dev"), (2, "main", "dev"), (3, None, None), (4, None, None), (5, "gone", "dev")], "repo int, configured string, detected string")
    branches = spark.createDataFrame([(r, n, n[-2:]) for r, n in ((1, "refs/heads/dev"), (1, "refs/remotes/origin/dev"), (1, "refs/heads/a"), (2, "refs/remotes/origin/main"), (3, "refs/heads/z"), (3, "refs/remotes/origin/b"), (5, "refs/heads/dev"))], "repo int, name string, commit string")
    assert {r.repo: r.branch for r in R.default_branches(repos, branches).collect()} == {1: "dev", 2: "main", 3: "b", 4: None, 5: "gone"}
    commits = spark.createDataFrame([(r, b, n) for r in range(1, 6) for b in ("dev", "main", "b", "z") for n in range(4)], "repo int, branch string, at int")
    got = sorted((r.repo, r.branch, r.at) for r in R.recent_commits(repos, branches, commits, [F.desc("at")], most=2).collect())
    assert got == [(1, "dev", 2), (1, "dev", 3), (2, "main", 2), (2, "main", 3), (3, "b", 2), (3, "b", 3)]


def test_related_types(spark):
    edges = spark.createDataFrame([("A", "B", "EXTE"), ("A", "I", "IMPL"), ("A", "I", "IMPL"), (" ", "I", "IMPL")], "source string, target string, kind string")
    assert sorted(map(tuple, G.related_types(edges, "IMPL").collect())) == [("A", "I", "parent", "IMPL"), ("I", "A", "child", "IMPL")]
    assert G.related_types(edges).count() == 4


def test_dataflow_snippets(spark):
    node = lambda **more: {"file": "a.py", "line": 3, "value": "x" * 500} | more
    own = {"path": " a.py ", "startLine": 2, "endLine": 4, "lines": [{"lineNumber": 2, "content": "y", "highlight": True}, {"content": "no number"}, {"lineNumber": 3, "content": "z"}]}
    cases = [
        ({"dataflow": {"nodes": [node(file="b.py"), node(codeSnippet=own), node(value="later")]}}, ("a.py", 2, 4, [(2, "y", True), (3, "z", False)])),
        ({"dataFlow": {"nodes": [node(codeSnippet=own | {"endLine": 1})]}}, ("a.py", 3, 3, [(3, "x" * 400, True)])),
        ({"dataFlow": {"nodes": [node(value=" ")]}}, None), ({"dataFlow": {"nodes": [node(line=4)]}}, None), ({"dataFlow": []}, None), ({}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(doc)) for i, (doc, _) in enumerate(cases)] + [(98, "broken"), (99, None)], "i int, doc string")
    got = {r.i: r.s and (r.s.path, r.s.start_line, r.s.end_line, [tuple(x) for x in r.s.lines]) for r in df.select("i", X.dataflow_snippet(F.col("doc"), F.lit("a.py"), F.lit(3)).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)} | {98: None, 99: None}

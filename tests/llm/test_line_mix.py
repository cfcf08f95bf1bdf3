import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarrystone.llm import line_dedup, source_mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, line string"
LONG = "This line is long enough to count as a passage, number "


def rows(texts, source="a"):
    return [(i, t, "en", source, len(t or ""), 1, "x") for i, t in texts]


def plain_dedup(docs, min_docs=5):
    space = " \t\n\x0b\x0c\r"
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(space).translate(upper)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    best = lambda s: max((x for x in s if x is not None), default=None)
    drop = {k: best(s) for k, s in holders.items() if len(s) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in drop and drop[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(5)
    pool = [LONG + str(i) for i in range(12)] + ["  " + LONG.upper() + "3\t", "short", "", "é" * 45, "É" * 45]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(7, docs[7][1]), (100, None), (101, ""), (102, "\n\n"), (103, "\n".join([LONG + "0"] * 3000)), (None, LONG + "1"), (None, LONG + "1\n" + LONG + "2")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows(docs), SCHEMA), batches=3, fanout=2)
    got = out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(docs)


def test_runs_merge_without_a_new_sort(spark):
    """A batch is sorted once and meets every run by a merge join, whatever the sizes; runs are neither shuffled nor sorted."""
    runs = line_dedup.LineRuns(4, min_docs=1, fanout=5)
    for k in range(3):
        runs.add(spark.range(100 * k, 100 * k + 150).select(F.col("id").alias("doc"), F.col("id").alias("h1"), F.xxhash64("id").alias("h2")))
    lines = spark.range(500).select(F.col("id").alias("doc"), F.col("id").alias("h1"), F.xxhash64("id").alias("h2"))
    own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    for run in runs.runs():
        own = own.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
    plan = own._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange ") == 1 and len(re.findall(r"\bSort \[", plan)) == 1, plan
    assert own.count() == 150


def test_line_dedup_stage_keeps_columns(spark):
    docs = [(i, LONG + "9\nown text " + str(i)) for i in range(6)] + [(9, None)]
    out = line_dedup.stage(spark, spark.createDataFrame(rows(docs), SCHEMA), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "own text 0" and got[0].n_chars == 10
    assert got[5].text == docs[5][1] and got[9].text is None


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def targets(sizes, cap=3):
    """Water filling by rounds, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    while free:
        w = sum(weight[s] for s in free)
        share = {s: (total - sum(out.values())) * weight[s] / w for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


def test_mixing(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "b", "b", "c", "é", None]), 0, 0, "") for i in range(900)]
    docs += [(1000, None, "en", "zero", 0, 0, ""), (5, docs[5][1], "en", docs[5][3], 0, 0, "")]
    docs += [(None, f"null id {i} " * 5, "en", "b", 0, 0, "") for i in range(200)] + [(7, "one row again and again", "en", "rep", 0, 0, "")] * 300 + [(2000, "long " * 20_000, "en", "long", 0, 0, "")]
    df = spark.createDataFrame(docs, SCHEMA)
    out = source_mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in docs:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = defaultdict(int)
    assert len(out) == len(docs)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for s, t in want.items():
        largest = max(len((x or "").split()) for _, x, _, z, *_ in docs if z == s)
        assert abs(taken[s] - t) <= 4 * math.sqrt(max(1, sizes[s] / 20)) * min(largest, 40) + largest * (s == "long"), (s, taken[s], t)
    assert [taken["rep"], len({r.copies for r in out if r.source == "rep"})] != [0, 1]  # equal rows draw apart
    again = source_mixing.mix(df.repartition(7)).select("row.doc_id", "size", "copies").collect()
    assert sorted(map(str, ((r.doc_id, r["size"], r.copies) for r in out))) == sorted(str(tuple(r)) for r in again)
    narrow = source_mixing.sized(df)
    numbers = source_mixing.numbered(narrow, source_mixing.repeated(narrow)).groupBy("id", "mark").agg(F.array_sort(F.collect_list("number")).alias("n")).collect()
    assert all(list(r.n) == list(range(len(r.n))) for r in numbers) and max(len(r.n) for r in numbers) == 300
    rows_ = source_mixing.stage(spark, df, "")
    assert rows_.columns == df.columns and rows_.count() == sum(r.copies for r in out)
    assert source_mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing_reruns_agree_row_by_row(spark):
    """Rows equal in id and text, of several sources and with other columns that differ: each gets the same in every partitioning."""
    docs = [(7, "the same words in all of them", lang, source, k % 2, k, "z") for source in ("a", "b", "c", None) for lang in ("en", "de") for k in range(12)]
    docs += [(i, f"own words {i}", "en", s, 0, 0, "") for i in range(60) for s in "abc"]
    df = spark.createDataFrame(docs, SCHEMA)
    seen = set()
    for parts in (1, 3, 7):
        rows = source_mixing.mix(df.repartition(parts)).select("row.*", "copies").collect()
        seen.add(tuple(sorted(str(tuple(r)) for r in rows)))
        assert len(rows) == len(docs)
    assert len(seen) == 1
    assert len({r.copies for r in rows if r.doc_id == 7}) > 1


def test_targets_of_many_sources(spark):
    """More sources than one task ranks."""
    rng = random.Random(6)
    sizes = {f"host{rng.randint(0, 10**6)}": rng.choice([0, 1, 5, 50, rng.randint(1, 10_000)]) for _ in range(300)} | {None: 77}
    got = source_mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), part=20).collect()
    want = targets(sizes)
    assert {r.source: r.source_size for r in got} == sizes and all(abs(r.target - want[r.source]) < 1e-6 for r in got)

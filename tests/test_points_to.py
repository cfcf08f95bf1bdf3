"""The points-to index against a plain worklist solver."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import points_to as P

CALLS = "p int, method string, callee string, offset int, receiver string, args array<string>, result string"


def split_field(token):
    """(base, field) of a field token, or None."""
    for own in ("THIS:", "STATIC:"):
        if token.startswith(own):
            return (own[:-1], token[len(own) :]) if token[len(own) :] else None
    if not token.startswith("HEAP("):
        return None
    depth = 0
    for i, c in enumerate(token):
        depth += (c == "(") - (c == ")")
        if c == ")" and depth == 0:
            return (token[5:i], token[i + 2 :]) if token[i + 1 : i + 2] == ":" and token[i + 2 :] and token[5:i] else None
    return None


def seen_by_caller(token, receiver, args, result):
    fine = lambda t: t if t and t != "UNKNOWN" else None
    if token.startswith("STATIC:"):
        return token
    if token == "THIS":
        return fine(receiver)
    if token == "RET":
        return fine(result)
    if token.startswith("PARAM:"):
        i = int(token[6:])
        return fine(args[i]) if i < len(args) else None
    parts = split_field(token)
    base = seen_by_caller(parts[0], receiver, args, result) if parts else None
    return base and (f"{base}:{parts[1]}" if base in ("THIS", "STATIC") else f"HEAP({base}):{parts[1]}")


def plain_index(copies, loads, stores, calls, targets, extra, most):
    """A queue of nodes; sets are (sorted roots, truncated)."""
    state, users, tokens, sites = {}, {}, {}, {}

    def merge(node, roots, cut):
        had = state.setdefault(node, (set(), False))
        both = had[0] | roots
        over = len(both) > most
        kept = set(sorted(both | {""})[:most]) if over else both
        new = (kept, had[1] or cut or over)
        if new != had:
            state[node] = new
            queue.append(node)

    def flow(to, m, t):
        if t == "UNKNOWN" or t.startswith("UNKNOWN:"):
            merge(to, {""}, False)
        elif t.startswith(P.ROOTS):
            merge(to, {t}, False)
        else:
            users.setdefault((m, t), set()).add(to)

    queue = []
    for m, left, right in [*copies, *loads, *stores]:
        flow((m, left), m, right)
        tokens.setdefault(m, set()).update((left, right))
    for m, callee, offset, receiver, args, result in calls:
        tokens.setdefault(m, set()).update(t for t in (receiver, result, *args) if t)
        outs = [t for t in (f"CALLRET@{offset}" if offset is not None else None, result) if t]
        reach = {callee, *(c for a, o, c in targets if (a, o) == (m, offset))} - {None}
        for c in reach:
            sites.setdefault(c, []).append((m, receiver, args, result))
            if receiver:
                flow((c, "THIS"), m, receiver)
            for i, a in enumerate(args):
                if a:
                    flow((c, f"PARAM:{i}"), m, a)
            for t in outs:
                if c.endswith("#<init>"):
                    merge((m, t), {"ALLOC:" + c.split("#")[0]}, False)
                else:
                    flow((m, t), c, "RET")
        for t in outs if not reach else []:
            merge((m, t), {""}, False)
    for m, t, root, cut in extra:
        merge((m, t), {"" if root == "UNKNOWN" else root}, cut)
    for c, called in sites.items():
        for t in tokens.get(c, ()):
            for m, receiver, args, result in called if split_field(t) else ():
                there = seen_by_caller(t, receiver, args, result)
                if there:
                    flow((c, t), m, there)
    while queue:
        node = queue.pop()
        for to in users.get(node, ()):
            merge(to, *state[node])
    return {n: (sorted(r or "UNKNOWN" for r in s), cut) for n, (s, cut) in state.items() if s}


def program(seed, wide):
    """Methods that call each other in circles, with fields of fields, results, statics and unknown parts."""
    rng = random.Random(seed)
    names = [f"C{i % 3}#m{i}" for i in range(7)]
    base = lambda: rng.choice(["a", "b", "THIS", "PARAM:0", "PARAM:1", "RET", "CALLRET@2"])

    def token():
        t = base()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t = f"THIS:{rng.choice('xy')}" if t == "THIS" else f"HEAP({t}):{rng.choice('xy')}"
        return rng.choice([t, t, t, t, "STATIC:K.s", "UNKNOWN", "UNKNOWN:z"])

    some = lambda n: [(rng.choice(names), token(), token()) for _ in range(n)]
    calls = [(rng.choice(names), rng.choice([*names, None, "K#<init>"]), rng.choice([None, 1, 2, 3]), rng.choice([None, token()]), [token() for _ in range(rng.randint(0, 2))], rng.choice([None, token()])) for _ in range(18)]
    calls += [(rng.choice(names), f"A{i}#<init>", 10 + i, None, [], rng.choice("ab")) for i in range(wide)]
    targets = [(m, o, rng.choice(names)) for m, _, o, *_ in calls if o is not None and rng.random() < 0.3]
    extra = [(rng.choice(names), token(), "BEAN:svc", False), (rng.choice(names), "b", "INJECT:T", True)]
    return some(14), some(9), some(9), calls, targets, extra


@pytest.mark.parametrize("seed", [1, 4])
def test_index_against_a_worklist(spark, seed):
    """Two programs side by side, kept apart by their key; a small cap, so that sets are truncated inside the fixpoint."""
    both = {p: program(10 * seed + p, 12) for p in (0, 1)}
    table = lambda i, cols: spark.createDataFrame([(p, *r) for p, x in both.items() for r in x[i]], f"p int, method string, {cols}")
    copies, loads, stores = table(0, "left string, right string"), table(1, "target string, source_field string"), table(2, "target_field string, value string")
    calls = spark.createDataFrame([(p, *r) for p, x in both.items() for r in x[3]], CALLS)
    targets, extra = table(4, "offset int, callee string"), table(5, "token string, root string, truncated boolean")
    got = P.points_to_index(copies, loads, stores, calls, targets, extra, ["p"], most=4).collect()
    got = {(r.p, (r.method, r.token)): (sorted(r.roots), r.truncated) for r in got}
    want = {(p, n): (sorted(s), cut) for p, x in both.items() for n, (s, cut) in plain_index(*x, 4).items()}
    assert got == want
    assert any(cut for _, cut in want.values()) and any(not cut and len(s) > 1 for s, cut in want.values())


def test_rewriting(spark):
    cases = ["THIS", "THIS:f", "PARAM:1", "PARAM:7", "RET", "HEAP(PARAM:0):f", "HEAP(HEAP(THIS:f):g):h", "HEAP(RET):f", "STATIC:K.s", "HEAP(STATIC:K.s):t", "local", "HEAP(local):f", "HEAP(PARAM:0:f", "HEAP(" * 21 + "THIS" + "):x" * 21]
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    out = df.select("t", P.rewritten(F.col("t"), F.lit(" THIS "), F.array(F.lit("q"), F.lit("UNKNOWN")), F.lit("r")).alias("there"), P.is_field(F.col("t")).alias("field")).collect()
    assert {r.t: r.there for r in out if r.there} == {
        "THIS": "THIS", "THIS:f": "THIS:f", "RET": "r", "HEAP(PARAM:0):f": "HEAP(q):f", "HEAP(HEAP(THIS:f):g):h": "HEAP(HEAP(THIS:f):g):h",
        "HEAP(RET):f": "HEAP(r):f", "STATIC:K.s": "STATIC:K.s", "HEAP(STATIC:K.s):t": "HEAP(STATIC:K.s):t",
    }
    assert [r.t for r in out if r.field != bool(split_field(r.t))] == []


def test_injections_and_small_cases(spark):
    tokens = spark.createDataFrame([("m", "THIS:C#f"), ("m", "PARAM:0"), ("n", "THIS:C#f"), ("n", "THIS:D#g")], "method string, token string")
    fields = spark.createDataFrame([("THIS:C#f", "Svc"), ("THIS:D#g", "Many")], "token string, target string")
    params = spark.createDataFrame([("m", "PARAM:0", "None")], "method string, token string, target string")
    beans = spark.createDataFrame([("Svc", "A"), ("Svc", "B"), ("Many", "X"), ("Many", "Y"), ("Many", "Z")], "target string, bean string")
    seeds = P.injection_seeds(tokens, fields, params, beans, most=2)
    got = sorted(map(tuple, seeds.collect()))
    assert got == [("m", "PARAM:0", "INJECT:None", True), ("m", "THIS:C#f", "BEAN:A", False), ("m", "THIS:C#f", "BEAN:B", False), ("n", "THIS:C#f", "BEAN:A", False), ("n", "THIS:C#f", "BEAN:B", False),
                   ("n", "THIS:D#g", "BEAN:X", False), ("n", "THIS:D#g", "BEAN:Y", False), ("n", "THIS:D#g", "INJECT:Many", True)]
    none = spark.createDataFrame([], "method string, token string, to_method string, to_token string")
    out = {(r.method, r.token): (list(r.roots), r.truncated) for r in P.solve(none, seeds).collect()}
    assert out["n", "THIS:D#g"] == (["BEAN:X", "BEAN:Y", "INJECT:Many"], True) and out["m", "THIS:C#f"] == (["BEAN:A", "BEAN:B"], False)
    assert P.solve(none, seeds.where("false")).count() == 0


def test_a_round_shuffles_new_roots_alone(spark, monkeypatch):
    """Chains of calls: edges and sets lie in runs sorted by node, so each round has one shuffle, of what is new, and call sites are worked out once."""
    calls = spark.createDataFrame([(0, f"C#m{i}", f"C#m{i + 1}", 1, None, ["HEAP(PARAM:0):f"], None) for i in range(9)], CALLS).drop("p")
    rows = spark.createDataFrame([("C#m0", "HEAP(PARAM:0):f", "ALLOC:K")], "method string, a string, b string")
    shuffles, kept, runs, tables = [], [], P.sorted_run, P.stored

    def run(df, label, *args, **kwargs):
        if label == "points-delta":
            shuffles.append(df._jdf.queryExecution().sparkPlan().toString().count("Repartition") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return runs(df, label, *args, **kwargs)

    monkeypatch.setattr(P, "sorted_run", run)
    monkeypatch.setattr(P, "stored", lambda df, label, *p: kept.append(label) or tables(df, label, *p))
    none = rows.where("false")
    out = P.points_to_index(rows.toDF("method", "left", "right"), none.toDF("method", "target", "source_field"), none.toDF("method", "target_field", "value"), calls)
    got = {(r.method, r.token): list(r.roots) for r in out.collect()}
    assert got == {("C#m0", "HEAP(PARAM:0):f"): ["ALLOC:K"], ("C#m1", "PARAM:0"): ["ALLOC:K"]}
    assert len(shuffles) > 2 and set(shuffles) == {1}
    assert kept.count("points-sites") == 1

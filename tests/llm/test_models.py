import functools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import collision_ann as A
from quarrystone.llm import quality_cnn as C
from quarrystone.llm import toxicity as T

DOC = "doc_id long, text string, lang string, source string, score double, id long, y int"
LABEL = "doc_id long, quality int, toxic int"


def word(rng):
    return "".join(rng.choice(["ka", "to", "mi", "re", "su", "na", "lo"]) for _ in range(rng.randint(1, 4)))


def corpus(n=900):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(30, 120))]
        toxic, junk = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zurgle", "zurgling", "vexbar", "idiot"])
        if junk:
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "xx", "s", 0.5, 1, 2))
        labels.append((i, int(not junk), int(toxic)))
    odd = [(5000, None), (5001, ""), (5002, " \n "), (5003, "you are not an idiot " * 3000), (0, docs[0][1]), (None, docs[0][1])]
    return docs + [(i, t, None, None, None, None, None) for i, t in odd], labels + [(None, 1, 1), (5000, None, None), (77_777, 1, 1)]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)


def plain_clause(read):
    """What the grammar says in words: each insult, and each threat of a clause with a target, times the gains that hold where it stands."""
    total = 0.0
    for i, (kind, own) in enumerate(read):
        before = [k for k, _ in read[:i]]
        g = (0.4 if T.NEGATION in before[-3:] else 1) * (0.6 if T.REPORT in before else 1) * (1.25 if T.TARGET in before else 1)
        if kind == T.INSULT or kind == T.THREAT and T.TARGET in [k for k, _ in read]:
            total += g * own
    return total


def plain_evidence(lex, text):
    total = 0.0
    for clause in re.split(r"[.,;:!?\n|()\[\]{}\"“”«»]", text.lower()):
        total += plain_clause([lex.read(w) for w in T.WORD.findall(clause)])
    return total


def test_grammar():
    rng = random.Random(3)
    for _ in range(2000):
        read = [(rng.choice(T.KINDS), rng.choice([1.0, 2.0, 3.5])) for _ in range(rng.randint(0, 9))]
        assert math.isclose(T.clause_weight(read), plain_clause(read)), read
    lex = T.Lexicon({"idiot$": 4.0, "zurg": 3.0})
    w = lambda s: T.clause_weight([lex.read(x) for x in s.split()])
    assert w("quite harmless words") == 0 and w("the idiot") == 4.0 and w("some zurgling") == 3.0
    assert w("you are an idiot") > w("the idiot") > w("she wrote idiot") and w("not an idiot") < w("an idiot")
    assert w("not one two three four idiot") == w("idiot")  # out of the negation's reach
    assert w("kill the process") == 0 and w("i will kill you") > 0 and w("he killed") > 0 and w("i am killing you") > 0
    assert math.isclose(w("you said not idiot"), 4.0 * 1.25 * 0.6 * 0.4)
    assert lex.evidence("Idiot! idiot. " * 2) == 16.0 and lex.evidence("") == 0
    long = "x" * 60 + " idiot, " + "word " * 50_000 + "you idiot"
    assert math.isclose(lex.evidence(long), plain_evidence(lex, long))


def test_toxicity(spark):
    docs, labels = frames(spark)
    model = T.fit(docs, labels, ~T.held_out(F.col("doc_id")))
    got = docs.select("doc_id", T.held_out(F.col("doc_id")).alias("h"), T.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 900]
    assert all((r.s >= T.CUTOFF) == (r.doc_id % 6 == 0) for r in held)
    assert all(r.s < T.CUTOFF for r in got if r.doc_id in (5000, 5001, 5002))
    lexicon, a, b = model
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id:
            assert math.isclose(r.s, 1 / (1 + math.exp(-(a * math.log1p(plain_evidence(lexicon, texts[r.doc_id] or "")) + b))), rel_tol=1e-9)
    none = T.fit(docs, labels.limit(0), F.lit(True))
    assert all(r.s < T.CUTOFF for r in docs.select(T.score(F.col("text"), none).alias("s")).collect())
    assert docs.limit(0).select(T.score(F.col("text"), model)).count() == 0


def test_cnn_gradients():
    """Against finite differences, where no maximum changes hands."""
    net, rng = C.Net(3), np.random.default_rng(1)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    texts = [bytes(rng.integers(32, 120, k).astype(np.uint8)) for k in (700, 90, 300)]
    parts, y = [C.chunked(t) for t in texts], np.array([1.0, 0.0, 1.0])
    g = net.gradients(np.concatenate(parts), np.array([len(p) for p in parts]), y)

    def loss():
        p = np.array([net.probability(t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for n in ("filters", "w1", "b1", "w2", "b2"):
        a = getattr(net, n)
        for at in [np.unravel_index(k, a.shape) for k in rng.integers(0, a.size, 5)]:
            old, e = a[at], 1e-5
            a[at] = old + e
            up = loss()
            a[at] = old - e
            down = loss()
            a[at] = old
            assert abs((up - down) / (2 * e) - g[n][at]) < 2e-3


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 496, 497, 5000):
        t = bytes(range(1, 251)) * (n // 250 + 1)
        c = C.chunked(t[:n])
        back = np.concatenate([c[0], *[x[C.OVERLAP :] for x in c[1:]]])[:n]
        assert back.tobytes() == t[:n] and c.shape[1] == C.CHUNK


def plain_probability(net, text):
    """The network written out: every chunk, every position, every filter."""
    step = C.CHUNK - C.OVERLAP
    n = max(1, math.ceil((len(text) - C.OVERLAP) / step))
    pooled = []
    for k in range(n):
        chunk = text[k * step : k * step + C.CHUNK].ljust(C.CHUNK, b"\0")
        best = [0.0] * C.FILTERS
        for at in range(0, C.CHUNK - C.WIDTH + 1, C.STRIDE):
            seen = [float(x) for b in chunk[at : at + C.WIDTH] for x in net.embed[b]]
            for f in range(C.FILTERS):
                best[f] = max(best[f], sum(x * float(w) for x, w in zip(seen, net.filters[:, f])) + float(net.bias[f]))
        pooled.append(best)
    x = [sum(p[f] for p in pooled) / n for f in range(C.FILTERS)] + [max(p[f] for p in pooled) for f in range(C.FILTERS)]
    h = [max(0.0, sum(a * float(w) for a, w in zip(x, net.w1[:, j])) + float(net.b1[j])) for j in range(C.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(h, net.w2)) + float(net.b2[0]))))


def test_cnn_against_plain_version():
    net = C.Net(5)
    net.bias += 0.1
    for t in (b"", b"a", "é words and more words ".encode() * 30, bytes(range(256)) * 3):
        assert math.isclose(net.probability(t), plain_probability(net, t), abs_tol=1e-5)


def test_cnn(spark):
    docs, labels = frames(spark)
    net = C.fit(docs, labels, ~C.held_out(F.col("doc_id")))
    got = docs.select("doc_id", C.held_out(F.col("doc_id")).alias("h"), C.score(F.col("text"), net).alias("s")).collect()
    assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 900]
    assert sum((r.s >= C.CUTOFF) == (r.doc_id % 5 != 1) for r in held) >= 0.97 * len(held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {r.doc_id: r.s for r in got if r.doc_id}
    assert all(math.isclose(by[i], net.probability(texts[i].encode()), abs_tol=1e-6) for i in range(1, 900))
    assert len({r.s for r in got if r.doc_id in (0, None)}) == 1
    assert C.fit(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.s for r in docs.select(C.score(F.col("text"), None).alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(C.score(F.col("text"), net)).count() == 0


def exact(rows, every=20, k=20):
    """Brute force: (query, vector) -> the k best of all other distinct rows, sums taken from the first coordinate on."""
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dot = lambda a, b: functools.reduce(lambda s, p: s + p, [float(x) * float(y) for x, y in zip(a, b)])
    out = {}
    for q, v in ok:
        if q % every == 0:
            out[q, v] = [(i, -s) for s, i in sorted((-dot(v, x), i) for i, x in ok if (i, x) != (q, v) and len(x) == len(v))[:k]]
    return out


def vectors(n=700, dim=24):
    r = np.random.default_rng(2)
    centres = r.normal(size=(9, dim))
    rows = [(i, (centres[i % 9] * r.uniform(0.2, 2) + 0.4 * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    same = r.normal(size=dim).astype(np.float32).tolist()
    rows += [(n + i, same) for i in range(150)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [float("nan")] * dim), (2080, [None] * dim), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (None, same), (3, rows[3][1]), (3, rows[4][1])]
    return rows


def found(df):
    got = {}
    for r in A.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got, want, hits, total = found(df), {q: w for (q, _), w in exact(rows).items()}, 0, 0
    assert set(got) == set(want)
    for q, w in want.items():
        assert len(got[q]) == len(w) and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits, total = hits + len(set(got[q]) & set(w)), total + len(w)  # scores agree to the last bit
    assert hits >= 0.9 * total
    assert A.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e-310, 1e153])
def test_nearest_ties_and_lengths(spark, scale):
    """Tables small enough for the windows to take in everything: equal to brute force, ties and repeated ids included."""
    r = np.random.default_rng(4)
    base = [(scale * r.integers(-3, 4, 8)).tolist() for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(90)] + [(5, base[1]), (20, base[2]), (20, [1e-300] * 8), (7, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df), {}
    for (q, _), w in exact(rows).items():
        want.setdefault(q, []).extend(w)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}


def test_nearest_of_whole_numbers(spark):
    rows = [(i, [i % 7, 1, i % 3]) for i in range(60)]
    got = found(spark.createDataFrame(rows, "vec_id int, embedding array<int>"))
    for (q, _), w in exact(rows).items():  # of rows equally near in different directions any may be found
        assert [s for _, s in got[q]] == [s for _, s in w] and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))

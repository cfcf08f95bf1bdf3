import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import zstandard
from pyspark.sql import functions as F

from quarrystone.llm import language_id, quality_rules as Q

DOC = "doc_id long, text string, lang string, source string, stratum string, n_words int"
SYLLABLES = {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["schr", "ung", "ein", "cht", "ber"], "cc": ["eau", "oi", "tre", "que", "ais"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_counts(text):
    space = " \t\n\x0b\x0c\r"
    split = lambda t: [w for w in "".join(" " if c in space else c for c in t).split(" ") if w]
    words, lines = split(text or ""), (text or "").split("\n")
    dup = sum(bool(split(line)) and line in lines[:i] for i, line in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)]


def test_counts_match_plain_version():
    rng = random.Random(8)
    texts = [None, "", " \n\t\n", "a b c", "a b c a b c", "a a a a", "é é é é\n\né é é é\n", "x\x0by\x0cz\rw\xa0v", "# * <>|&%$ q"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "#", "é", " "]) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    for t in texts:
        assert Q.measure((t or "").encode())[:5] == plain_counts(t), t


def test_binomial_tail_and_certify():
    for n, p in ((1, 0.3), (20, 0.1), (300, 0.01)):
        for k in (0, 1, min(n, 5)):
            assert math.isclose(Q.tail(k, n, p), min(1, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))), rel_tol=1e-9)
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 400)
        k, p = rng.randint(0, n), rng.choice([0.01, 0.05, 0.3, 0.9])
        want = float(sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
        assert math.isclose(Q.tail(k, n, p), want, rel_tol=1e-8, abs_tol=1e-13), (n, k, p)
    assert 0.4 < Q.tail(10**7, 10**9, 0.01) < 0.6 and Q.tail(10**7 - 10**5, 10**9, 0.01) < 1e-100
    zero = [0] * (Q.BINS + 1)
    at = lambda **x: [x.get(f"b{i}", 0) for i in range(Q.BINS + 1)]
    assert Q.certify(at(b0=1000), at(b0=1000), at(b150=90, b0=10), 0.01, 0.0025) == 150
    assert Q.certify(at(b0=50), at(b0=50), at(b150=90), 0.01, 0.0025) is None  # too few labels to guarantee anything
    assert Q.certify(at(b0=900, b150=100), at(b0=900, b150=100), at(b150=90), 0.01, 0.0025) is None  # would lose good ones
    assert Q.certify(zero, zero, zero, 0.01, 0.0025) is None


def plain_kept(rows, labels):
    """The whole rule by lists and exact fractions: doc -> kept, for rows of one text each."""
    stats, by = {}, defaultdict(set)
    for i, t, lang, *_ in rows:
        m = dict(zip(Q.COUNTS, Q.measure((t or "").encode())))
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        at = {r: min(Q.BINS, Q.BINS * m[p] // m[w]) if m[w] else 0 for r, (p, w) in Q.RULES.items()}
        stats[i] = (lang or "", failed, at, Q.ends((t or "").encode().split()))
    for i, q, _ in labels:
        if i is not None and q is not None:
            by[i].add(q)
    held = [(i, min(q)) for i, q in sorted(by.items()) if len(q) == 1 and i in stats and not stats[i][1]]
    for side in (0, 1):
        first = {}
        for i, q in held:
            first.setdefault(stats[i][3][side], (i, q))
        held = sorted(first.values())
    tests = len({stats[i][0] for i, _ in held}) * len(Q.RULES)
    cut = {}
    for lang in {stats[i][0] for i, _ in held}:
        for r in Q.RULES:
            level = lambda q, halves: [stats[i][2][r] for i, y in held if stats[i][0] == lang and y == q and stats[i][3][0] % 2 in halves]  # noqa: B023, E731
            good, tested, bad = level(1, (0,)), level(1, (1,)), level(0, (0, 1))
            best, worth, p = None, 0, Fraction(Q.ALPHA / len(Q.RULES))
            for c in range(Q.BINS, 0, -1):
                k, n = sum(x >= c for x in tested), len(tested)
                if not n or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > Q.DELTA / tests:
                    break
                value = sum(x >= c for x in bad) / max(1, len(bad)) - 10 * sum(x >= c for x in good) / max(1, len(good))
                if value > worth + 1e-12:
                    best, worth = c, value
            cut[lang, r] = best
    return {i: not failed and not any(cut.get((lang, r)) is not None and at[r] >= cut[lang, r] for r in Q.RULES) for i, (lang, failed, at, _) in stats.items()}


def test_judge(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        lang = rng.choice(["aa", "aa", "aa", None])
        bad = i % 5 == 0
        text = prose(rng, "aa", 70)
        rows.append((i, text.replace(" ", "### ") if bad else text, lang, "s", "t", 0))
        labels.append((i, int(not bad), 0))
    rows += [(9000, None, "aa", "", "", 0), (9001, "", None, "", "", 0), (9002, "w " * 60, "zz", "", "", 0), (9003, prose(rng, "aa", 60), "zz", "", "", 0), (9004, prose(rng, "aa", 60_000), "aa", "", "", 0)]
    rows += [(10_000 + i, rows[5][1], "aa", "", "", 0) for i in range(300)]  # copies of one junk text, labelled good
    labels += [(10_000 + i, 1, 0) for i in range(300)] + [(10, 1, 0), (12, 1, 0)]  # 10 is labelled both ways, 12 twice
    labels += [(None, 1, 0), (77_777, 1, 0), (1, None, 0)]
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc: r for r in Q.judge(docs, lab).collect()}
    assert len(got) == len(rows)
    assert not got[9000].kept and got[9000].base_failed and got[9001].base_failed and got[9002].base_failed
    assert got[9003].kept  # a stratum without labels loses nothing
    lost = [i for i, q, _ in labels[:3000] if q and not got[i].kept]
    assert len(lost) <= 0.05 * 2400
    junk = {lang: [got[i].kept for i in range(0, 3000, 5) if rows[i][2] == lang] for lang in ("aa", None)}
    assert not any(junk["aa"]) and all(junk[None])  # the null stratum has too few labels for a cutoff
    assert {i: r.kept for i, r in got.items()} == plain_kept(rows, labels)
    assert Q.judge(docs.limit(0), lab).count() == 0 and Q.judge(docs, lab.limit(0)).where("kept").count() > 2900


def plain_language(content):
    """Compress with every dictionary at both levels, in the plainest way."""

    def sizes(data, level):
        out = {}
        for lang, c in content.items():
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            z = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            out[lang] = sum(len(z.compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
        return out

    def lang(text):
        words = []
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            if not words or words[-1] != w:
                words.append(w)
        if not any(c.isalpha() for c in text or ""):
            return "und", True
        for level in (6, 17):
            by = sizes(" ".join(words).encode(), level)
            best = min(by, key=lambda k: by[k])
            second = min(v for k, v in by.items() if k != best)
            if (second - by[best]) / second >= 0.01:
                return best, False
        return best, True

    return lang


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 60), lang, "s", "t", 0) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(5000, None, "aa"), (5001, "", "bb"), (5002, "123 !!\n# ²", "cc"), (5003, prose(rng, "cc", 60).upper().replace(" ", "!! "), "cc"), (5004, prose(rng, "bb", 20_000), "bb"), (5005, prose(rng, "aa", 60), None)]
    docs = spark.createDataFrame(rows + [(i, t, lang, "s", "t", 0) for i, t, lang in odd], DOC)
    content = language_id.learn(docs, ~language_id.held_out(F.col("doc_id")))
    assert set(content) == set(SYLLABLES) and all(1 < c.count(b"\n") <= language_id.PARTS * language_id.PER_PART for c in content.values())
    got = {r.doc: r for r in language_id.identify(docs, content).collect()}
    plain = plain_language(content)
    for i, t, *_ in rows[:100] + [(i, t) for i, t, _ in odd]:
        lang, rejected = plain(t)
        assert (got[i].lang_pred, got[i].rejected) == (lang, rejected), i
    right = sum(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    assert right >= 0.98 * len(rows)
    assert [got[i].lang_pred for i in range(5000, 5006)] == ["und", "und", "und", "cc", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5000].rejected and not got[5004].rejected
    nothing = language_id.learn(docs.limit(0), F.lit(True))
    assert nothing == {} and {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), content).count() == 0
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    every = language_id.learn(many, F.lit(True))
    assert len(every) == 600 and language_id.identify(many, every).count() == 600
    long = spark.createDataFrame([(i, "short words", "a") for i in range(3)] + [(9, "long " * 300_000, "a"), (10, "only long " * 200_000, "b")], "doc_id long, text string, lang string")
    both = language_id.learn(long, F.lit(True))
    assert set(both) == {"a", "b"} and both["b"].startswith(b"only long")

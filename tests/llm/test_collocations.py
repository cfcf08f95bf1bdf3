import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, block int"


def plain(docs, least, top=2000, share=80):
    """The whole list by brute force, from (text, lang)."""
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= share * f[lang, p[i : i + k]]:
                    gone.add((lang, p[i : i + k]))
    out = []
    for lang in n:
        rows = []
        for (at, p), a in cand.items():
            if at == lang and (lang, p) not in gone:
                score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(spark, docs, **options):
    df = spark.createDataFrame([(i, t, x, "p", 1, 2) for i, (t, x) in enumerate(docs)], SCHEMA).repartition(3)
    return sorted(map(tuple, C.collocations(df, **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Small blocks, groups and tiles, so that all ways of counting are taken."""
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "É", "x y", " ", *[f"w{i}" for i in range(30)]]
    docs = []
    for i in range(160):
        w = [words[min(int(rng.expovariate(0.2)), len(words) - 1)] for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice([" ", "\t", "  "]).join(x + rng.choice(["", "", "", ".", ",\n", "!", "\r", "\x0b"]) for x in w), rng.choice(["en", "en", "de", None, "und"])))
    docs += [("New York is a city\n", "en")] * 40 + [(None, "en"), ("", None), (" . , ", "fr"), ("rare words here", "zz")]
    options = {"least": 4, "block": 100, "group": 60, "tile": 4, "dense": 6}
    want = plain(docs, 4)
    assert len(want) > 100
    assert mined(spark, docs, **options) == want
    assert mined(spark, docs, **options, top=5, share=50) == plain(docs, 4, 5, 50)


def test_long_texts_and_empty_tables(spark):
    text = "one two three four five " * 60_000 + "." + "six seven " * 300
    assert mined(spark, [(text, "en"), (text, "en")], least=30) == plain([(text, "en")] * 2, 30)
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_slices_end_at_separators_or_between_words():
    text = b"aaa bbb ccc\nddd eee " + b"f" * 40 + b" g\n" + b"h" * 30
    parts = list(C.slices(text, 8))
    assert b"".join(parts) == text and all(p[-1:] in b" \n" for p in parts[:-1]) and len(parts) == 3


def test_tiles_count_all_pairs():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 200, 5000) ** 2 // 200, rng.integers(0, 100, 5000)
    tiles = C.PairTiles(left, right, tile=16, dense=100)
    want = Counter(zip(left.tolist(), right.tolist()))
    assert {(c // C.WIDTH, c % C.WIDTH): n for c, n in zip(tiles.codes.tolist(), tiles.counts.tolist())} == want
    assert (tiles.codes[tiles.index] == left * C.WIDTH + right).all()

import random

import xxhash

from quarrystone.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, fp long, doc string"


def plain_print(text):
    space = " \t\n\x0b\x0c\r"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in space else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, ids, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    first = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            first[find(i)] = min(first.get(find(i), ids[i]), ids[i])
    return [first.get(find(i)) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(80)) for _ in range(40)]
    texts = []
    for b in base:
        texts += [b, b.upper()]
        w = b.split()
        for k in range(4):
            v = list(w)
            v[rng.randrange(80)] = "changed"
            texts.append(" \n".join(v) if k % 2 else " ".join(v))
    texts += [None, "", "one", "One", "two words", "x y z", "é É"]
    rows = [(3 * i + 1, t, 0, "") for i, t in enumerate(texts)] + [(None, base[0], 0, "")]
    rng.shuffle(rows)
    out = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain_print(t) for _, t, *_ in rows]
    comp = plain_components(fps, [r[0] for r in rows])
    want = sorted(((r[0], f, c) for r, f, c in zip(rows, fps, comp)), key=str)
    assert sorted(((r.doc, r.fp % (1 << 64), r.component) for r in out), key=str) == want


def test_links_with_crowded_buckets(spark):
    """Many fingerprints around two centres, in chains and clusters: the star way and the pivot way agree with brute force."""
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(250):
            x = centre
            for b in rng.sample(range(20), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from quarrystone.operators.components import connected_components

    for bucket in (8, 10_000):
        got = {r.node: r.component for r in connected_components(S.links(nodes, bucket), "a", "b").collect()}
        want = plain_components(fps, signed)
        assert [got.get(f, f) for f in signed] == want


def test_pairs_of_blocks_meet_all_links():
    rng = random.Random(7)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any((x ^ y) >> a & 0xFFFF == 0 == (x ^ y) >> b & 0xFFFF for a, b in S.PAIRS)
    assert len(S.PAIRS) == 6


def test_stage_keeps_one_of_each_group(spark):
    text, other, third = "a b c d e", "quite another text here", "nothing like the others at all"
    rows = [(1, text), (2, "A b c d e"), (2, "A b c d e"), (5, text), (5, other), (5, other), (None, text), (None, third), (None, third), (7, None), (8, ""), (9, "w x y z " * 30_000)]
    df = spark.createDataFrame([(i, t, 0, "x", 0, 1) for i, t in rows], SCHEMA + ", mark long, n int")
    out = S.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text), (5, other), (None, third), (7, None), rows[-1]], key=str)
    assert S.stage(spark, df.limit(0), "").count() == 0 and S.near_duplicates(df.limit(0)).count() == 0

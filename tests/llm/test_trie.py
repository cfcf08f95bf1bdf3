import hashlib
import random
import zlib

import numpy as np
import pytest

from quarrystone.llm import prefix_trie as P
from quarrystone.storage import stored

SCHEMA = "conv_id long, turn long, role string, text string, key string, shard int, depth int"


def plain(rows):
    """The nodes by brute force, from (conv_id, turn, role, text)."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq) == d))
    out = []
    for node, who in members.items():
        below = [k for k in members if k[: len(node)] == node]
        kids = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c, e in who if e)))
        out.append((min(c for c, _ in who), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(who), len(kids(node)),
                    sum(not kids(k) for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, shard_turns):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, P.trie(P.rebuilt(stored(P.sequences(df), "t")), shard_turns).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Few different turns, so that spines of many shards meet: copies, prefixes of each other, one long conversation, ties and nulls."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), 110):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 2 else "user", rng.choice(["a", "é"]) if t else "hello"))
    rows += [(300 + c, t, "user", "all alike") for c in range(40) for t in range(3)]
    rows += [(500, t, "user", "long" * (t % 3)) for t in range(60)]
    rows += [(7, 1, None, None), (7, None, "bot", "z"), (7, None, "bot", "a"), (7, 1, "user", "b"), (7, 1, "user", "b"), (None, 0, "user", "none")]
    rng.shuffle(rows)
    want = plain(rows)
    assert nodes(spark, rows, 10) == want  # some dozens of shards
    assert nodes(spark, rows, 10_000) == want


def test_small_cases(spark):
    assert nodes(spark, [], 10) == []
    assert nodes(spark, [(3, 0, "user", "x")], 10) == plain([(3, 0, "user", "x")])


def test_findclose():
    rng = random.Random(3)
    for n in (1, 40, 3000):
        steps, depth = [1], 1
        for _ in range(2 * n):
            step = 1 if depth == 1 or rng.random() < (0.7 if n == 3000 and len(steps) < n else 0.45) else -1
            steps.append(step)
            depth += step
        steps += [-1] * depth
        tree = P.Parens(np.array(steps, np.int8))
        stack, want = [], {}
        for i, s in enumerate(steps):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = tree.opens()
        assert tree.findclose(at).tolist() == [want[i] for i in at.tolist()]


def test_shared_turns():
    a, b = bytes(range(64)), bytes(range(48)) + b"other turn......"
    assert P.shared_turns(a, b) == 3 and P.shared_turns(a, a[:32]) == 2 and P.shared_turns(b"", a) == 0 and P.shared_turns(a, a) == 4

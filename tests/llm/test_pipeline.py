import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quarrystone.llm import best_fit_packing, toxicity  # noqa: E402
from quarrystone.llm.tokens import Encoder  # noqa: E402
from tests.llm.test_line_mix import targets  # noqa: E402
from tests.llm.test_models import word  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_print  # noqa: E402


def corpus():
    rng = random.Random(21)
    shared = ["This passage stands in many of the documents, number " + str(k) for k in range(3)]
    docs, labels = [], []
    for i in range(240):
        words = [word(rng) for _ in range(rng.randint(20, 70))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zurgle", "vexbar", "idiot"])
        lines = [" ".join(words)] + ([rng.choice(shared)] if i % 3 == 0 else [])
        docs.append((i, "\n".join(lines), "xx", rng.choice(["a", "b", "b", "b", None])))
        labels.append((i, 1, int(toxic)))
    for i in range(40):  # exact and near copies
        t = docs[7 * (i % 5) + 1][1]
        docs.append((300 + i, t if i % 2 else t + " ", "xx", "c"))
    docs += [(400, None, "xx", "a"), (401, "", None, "b"), (402, "word " * 5000, "xx", "c")]
    # one id with another text, ids that are null, a row twice
    docs += [(7, docs[8][1] + " and more of it", "xx", "a"), (None, "a text without an id " * 3, "xx", "b"), (None, "one more without an id " * 4, "xx", "b"), docs[50], (9, docs[1][1], "xx", "a")]
    return [(*d, len(d[1] or "")) for d in docs], labels


#: Columns that the stages use as names of their own.
CLASH = "doc long, mark long, row string, size long, s string, fp long, lines string, copies long, length int, kept string, was_null boolean, number long, th long"


def write(spark, path, docs, labels):
    more = (1, 2, "r", 3, "s", 4, "l", 5, 6, "k", True, 7, 8)
    spark.createDataFrame([(*d, *more) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]


def test_pipeline_against_plain_version(spark, tmp_path):
    docs, labels = corpus()
    write(spark, str(tmp_path), docs, labels)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon, a, b = toxicity.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    rows = [d for d in docs if 1 / (1 + math.exp(-(a * math.log1p(lexicon.evidence(d[1] or "")) + b))) < toxicity.CUTOFF]
    assert 30 <= len(docs) - len(rows) <= 45
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(line.strip()) >= 40:
                holders[line.strip().lower()].add(i)
    owner = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= 5}
    rows = [(i, None if t is None else "\n".join(x for x in t.split("\n") if owner.get(x.strip().lower(), i) == i), s) for i, t, _, s, _ in rows]
    groups = defaultdict(set)
    for r, c in zip(rows, plain_components([plain_print(t) for _, t, _ in rows], list(range(len(rows))))):
        groups[c].add(r)
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63) - (1 << 63)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]))) for g in groups.values()]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, e, pieces = targets(sizes), Encoder(best_fit_packing.tokenizer_path()), Counter()
    for i, t, s in rows:
        rate = want[s] / sizes[s] if sizes[s] else 0
        mark = hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix:{'' if i is None else i}:0:{mark}".encode()).hexdigest()[:13], 16) / 2**52
        ids = e.whole(t or "") + np.array([0], "<u4").tobytes()
        for k in range(-(-len(ids) // 8192)):
            p = ids[8192 * k : 8192 * (k + 1)]
            pieces[i, k, 2048 * k, len(p) // 4, zlib.crc32(p)] += int(rate) + (u < rate - int(rate))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +pieces
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048


def test_empty(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import json
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from quarrystone.llm import best_fit_packing, simple8b, token_file, tokens  # noqa: E402
from quarrystone.llm.tokens import Encoder  # noqa: E402
from quarrystone.storage import shared_dir  # noqa: E402

TEXTS = [
    "", " ", "a", " a b", "a \nb", "a\n b c", "It's a  b   c", "foo ", "foo \n", "\n\n a", "ÀÉ ßtraße's x²y", "你 好, x", "a\tb c", "<|endoftext|> x",
    "x" * 300 + " y", "İstanbul ÇA", "don't!!! can'T ...", "#a,b c-d 12345 67 8.", "é é ½", "word, word, Word. WORD", "\x01 a \x01", "no break  wide",
]


def library(name):
    """The library's own encoding, with its defaults."""
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_library_ids(name):
    e, want = Encoder(public_tokenizers.path(name)), library(name)
    assert e.fits
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(TEXTS) for _ in range(6)) for _ in range(200)]
    texts += ["".join(rng.choice(["Wort", "mot,", "é", "\n", "\n", " ", " ", ".", "7", "'s", "<|", "|>"]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    for special in ("<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"):
        texts += [special, f"hello {special} there", f"a{special}b", f"x \n{special}\ny", f"word. {special}{special}"]
    for t in texts + texts:
        assert e(t) == want(t), t


def test_memo_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    e, want, rng = Encoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json"), random.Random(2)
    for _ in range(300):
        t = " ".join(str(rng.choice(["often", "many", rng.randint(0, 10**6)])) for _ in range(20))
        assert e(t) == want(t) and len(e.memo) < 80


def test_other_shapes_go_whole(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shape = json.load(f)
    shape["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(shape))
    e = Encoder(str(tmp_path / "other.json"))
    assert not e.fits and e("two words") == e.whole("two words")


def test_simple8b_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 59, 60, 61, 1000, 70_000):
        for top in (1, 2, 60, 50_257, 1 << 33):
            v = rng.integers(0, top, n).astype(np.uint64)
            v[rng.random(n) < 0.01] = np.uint64(2**64 - 1)
            block = simple8b.to_block(v)
            assert np.array_equal(simple8b.read_block(block), v)
            for _ in range(4):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert np.array_equal(simple8b.read_values(block, a, b), v[a:b])
    zeros = simple8b.encode(np.zeros(600, np.uint64))
    assert len(zeros) == 10


def docs(spark, extra=()):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(50, "long text, " * 4000, 1), (51, None, 1), (3, "a", 1), *extra]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length int")


def test_token_file(spark):
    rows, df = docs(spark)
    name = public_tokenizers.path("byte_bpe_50k.json")
    encode, path = library("byte_bpe_50k.json"), shared_dir(spark, "test-tokens")
    token_file.write_tokens(df, path, name, shards=3)
    got = [tuple(r) for r in token_file.read_tokens(spark, path).orderBy("start").collect()]
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = encode(t or "") + np.array([2], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert [g[:3] for g in got] == [w[:3] for w in want] and got == want
    with_ids = {r.doc: r.ids for r in token_file.read_tokens(spark, path, with_ids=True).collect()}
    assert with_ids[50][:-1] == np.frombuffer(encode("long text, " * 4000), "<u4").tolist()
    empty = shared_dir(spark, "test-tokens")
    token_file.write_tokens(df.limit(0), empty, name)
    assert token_file.read_tokens(spark, empty).count() == 0


def test_plan_fills_every_rank_once():
    rng = random.Random(9)
    for _ in range(60):
        cap = rng.choice([5, 64, 2048])
        hist = {rng.randint(1, cap): rng.randint(1, 400) for _ in range(rng.randint(1, 60))}
        room, seen = {}, {}
        for length, rank, n, seq, offset in best_fit_packing.plan(hist, cap):
            for k in range(n):
                assert (length, rank + k) not in seen
                seen[length, rank + k] = 1
                room.setdefault(seq + k, []).append((offset, length))
        assert len(seen) == sum(hist.values())
        for parts in room.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= cap
        total = sum(k * v for k, v in hist.items())
        assert len(room) <= 11 / 9 * (total / cap) * 1.35 + 2 or max(hist) > cap / 3


def test_packing(spark):
    rows, df = docs(spark, [(200 + i, "word " * (i % 37), 1) for i in range(300)])
    name = best_fit_packing.tokenizer_path()
    encode = library("word_bpe_49k.json")
    got = best_fit_packing.pack(df, name, with_ids=True).collect()
    want = []
    for i, t, _ in rows:
        ids = encode(t or "") + np.array([0], "<u4").tobytes()
        want += [(i, k, 2048 * k, len(p) // 4, zlib.crc32(p), p) for k in range(-(-len(ids) // 8192)) for p in [ids[8192 * k : 8192 * (k + 1)]]]
    assert sorted((r.doc, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert best_fit_packing.pack(df.limit(0), name).count() == 0


def test_words_around_a_line_end_are_two_pieces():
    """Pairs of words with a line end between them hardly ever come again: they are not kept; odd line ends still give the library's ids."""
    import public_tokenizers

    from quarrystone.llm.simple8b import widths
    from quarrystone.llm.tokens import Encoder

    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two.\nThree four\nfive's", "a\n\nb c\nd", " a b\nc", "a \nb c", "a b\n c", "\na b", "a b\n", "a b\nc ", "é b\n7 ñ.\n##x"]
    assert [enc(t) for t in texts] == [enc.whole(t) for t in texts]
    fresh = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    fresh(texts[0])
    assert not [p for p in fresh.memo if "\n" in p] and "Three" in fresh.bare
    some = [0, 1, 65535, 65536, (1 << 53) - 1, 1 << 53, (1 << 64) - 1]
    for n in range(1, len(some) + 1):
        assert widths(np.array(some[:n], dtype=np.uint64)).tolist() == [max(1, v.bit_length()) for v in some[:n]]

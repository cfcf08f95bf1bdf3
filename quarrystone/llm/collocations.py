r"""Phrase collocations by direct-address tiling.

Texts become blocks of word ids. A block sends its distinct words with their counts to groups of the words' hash; a
group adds them up, gives frequent words ids in the order of frequency, and answers each block with the ids of its own
words. So no dictionary is broadcast or held whole anywhere. Ids being ranks, neighbouring words of a block fall into
tiles of pairs (left id // T, right id // T): crowded tiles, those of the frequent words, are counted by a dense
`numpy.bincount` that addresses pairs directly, all others as sorted coordinates. Pairs go through the same exchange
and get ids in the order of frequency, which take the place of the left word in the next round; three rounds give
phrases of up to four words. A phrase is counted only where both phrases within it, without its first and without its
last word, are frequent: no frequent one is missed, since none of its parts can be rarer. Counts are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.storage import forget, stored

#: Fixed values of the query: least count, most words, phrases of a language, and the share (percent) of a phrase's count at which a longer one takes its place.
LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Words of a block; entries that meet in a group; bytes of text taken apart at once.
BLOCK, GROUP, SLICE = 1 << 20, 1 << 20, 1 << 20
#: Ids on a tile's side, tiles in a row that may be dense, and pairs from which a tile is.
TILE, HEAD, DENSE = 1024, 8, 1 << 17
#: Left ids are multiplied by this to make a pair's code: words have fewer ids, and left parts fewer than 2 ** 32.
WIDTH = 1 << 31

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(SEPARATORS))


def packed(x: np.ndarray) -> bytes:
    """An array of whole numbers in the narrowest type that holds them, compressed."""
    import zstandard

    if len(x):
        low, high = x.min(), x.max()
        x = x.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    return x.dtype.char.encode() + zstandard.compress(x.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), data[:1].decode())


class Ids(dict):
    """Words of a block, numbered as they come; the empty word and a separator have ids below zero."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 2
        return n


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A normalized text in slices that end behind a separator, or else between words: what is between them is not a border of pieces."""
    at = 0
    while len(text) - at > size:
        end = text.find(b"\n", at + size, at + 2 * size)
        if end < 0:
            end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = BLOCK) -> DataFrame:
    """(block, lang, n, words, hashes, counts, seq): the texts of a language in a partition, cut into blocks at borders of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[Ids, list]] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            ids, parts = open_.pop(lang)
            seq = np.concatenate(parts)
            seq = seq[(seq >= 0) | (np.append(-1, seq[:-1]) >= 0)]
            names = list(ids)[2:]
            number += 1
            counts = np.bincount(seq[seq >= 0], minlength=len(names))
            hashes = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
            row = [[number], [lang], [int(counts.sum())], [len(names)], [b"\n".join(names)], [packed(hashes)], [packed(counts)], [packed(seq)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["block", "lang", "n", "m", "words", "hashes", "counts", "seq"])

        full: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in slices(text.as_py().translate(_NORMAL) + b"\n"):
                    if lang not in open_:
                        open_[lang], full[lang] = (Ids(), []), 0
                    ids, parts = open_[lang]
                    tokens = part.replace(b"\n", b" \n ").split(b" ")
                    seq = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
                    parts.append(seq[seq != -2])
                    full[lang] += len(parts[-1])
                    if full[lang] >= words and part.endswith(b"\n"):
                        yield flush(lang)
        for lang in list(open_):
            yield flush(lang)

    src = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return src.mapInArrow(run, "block long, lang string, n long, m long, words binary, hashes binary, counts binary, seq binary")


class PairTiles:
    """Distinct pairs of ids with their counts: crowded tiles by direct address, the rest as sorted coordinates."""

    def __init__(self, left: np.ndarray, right: np.ndarray, tile: int = TILE, dense: int = DENSE):
        head = np.flatnonzero((left < HEAD * tile) & (right < HEAD * tile))
        of = (left[head] // tile) * HEAD + right[head] // tile
        crowded = np.flatnonzero(np.bincount(of, minlength=HEAD * HEAD) >= dense)
        self.index = np.empty(len(left), np.int64)
        codes, counts, rest, made = [], [], np.ones(len(left), bool), 0
        for t in crowded.tolist():
            mine = head[of == t]
            at = (left[mine] % tile) * tile + right[mine] % tile
            count = np.bincount(at, minlength=tile * tile)
            there = np.flatnonzero(count)
            place = np.zeros(tile * tile, np.int64)
            place[there] = made + np.arange(len(there))
            self.index[mine], rest[mine] = place[at], False
            codes.append((t // HEAD * tile + there // tile) * WIDTH + t % HEAD * tile + there % tile)
            counts.append(count[there])
            made += len(there)
        code = left[rest] * WIDTH + right[rest]
        ordered = np.sort(code)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        codes.append(ordered[first])
        counts.append(np.diff(np.append(first, len(ordered))))
        self.index[rest] = made + np.searchsorted(codes[-1], code)
        self.codes, self.counts = np.concatenate(codes), np.concatenate(counts)


def dealt(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): entries sorted by the group of their hash, and where each group ends."""
    mixed = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    of = ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
    return np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=groups))


MESSAGE = "lang string, grp int, block long, keys binary, counts binary"


def _messages(lang: str, block: int, order: np.ndarray, ends: np.ndarray, keys, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each group that has entries; keys: from places to bytes."""
    starts = np.append(0, ends[:-1])
    full = np.flatnonzero(ends > starts)
    of = [order[starts[g] : ends[g]] for g in full]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block)), pa.array([keys(p) for p in of], pa.binary()), pa.array([packed(counts[p]) for p in of], pa.binary())],
        names=["lang", "grp", "block", "keys", "counts"],
    )


def word_messages(rows: DataFrame, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, m, words, hashes, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if m:
                    names = words.split(b"\n")
                    yield _messages(lang, block, *dealt(unpacked(hashes), groups), lambda p: b"\n".join([names[i] for i in p.tolist()]), unpacked(counts))

    return rows.select("block", "lang", "m", "words", "hashes", "counts").mapInArrow(run, MESSAGE)


def followed(s: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, left ids, right ids) where a frequent phrase of `size` words goes on to one more word, both phrases within being frequent."""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, s[at].astype(np.int64), g[at + size].astype(np.int64)


def pair_messages(state: DataFrame, size: int, groups: int, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, g, s in zip(*[c.to_pylist() for c in batch.columns]):
                _, left, right = followed(unpacked(s), unpacked(g), size)
                if len(left):
                    tiles = PairTiles(left, right, tile, dense)
                    yield _messages(lang, block, *dealt(tiles.codes, groups), lambda p: packed(tiles.codes[p]), tiles.counts)

    return state.select("block", "lang", "g", "s").mapInArrow(run, MESSAGE)


def exchange(messages: DataFrame, words: bool, groups: int, least: int, answer: bool = True) -> DataFrame:
    """(lang, grp, block, keys, data): for each group its frequent keys and their counts, most frequent first (block null), and answers to blocks: the ids of
    the keys they sent, -1 for rare ones. The id is the rank within the group times the number of groups plus the group: about the rank among all."""

    def add(table: pa.Table) -> pa.Table:
        lang, grp = table.column("lang")[0].as_py(), table.column("grp")[0].as_py()
        sent = table.column("block").to_pylist()
        raw = [k.as_py() for k in table.column("keys")]
        counts = [unpacked(c.as_py()) for c in table.column("counts")]
        sizes = [len(c) for c in counts]
        keys = pa.array([w for k in raw for w in k.split(b"\n")], pa.binary()) if words else pa.array(np.concatenate([unpacked(k).astype(np.int64) for k in raw]))
        coded = keys.dictionary_encode()
        at, distinct = coded.indices.to_numpy(), coded.dictionary
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        hot = np.flatnonzero(total >= least)
        kept = pa.table({"n": total[hot], "key": distinct.take(pa.array(hot))})
        order = pc.sort_indices(kept, sort_keys=[("n", "descending"), ("key", "ascending")])
        kept = kept.take(order)
        out = {"block": [None], "keys": [b"\n".join(kept.column("key").to_pylist()) if words else packed(kept.column("key").to_numpy())], "data": [packed(kept.column("n").to_numpy())]}
        if answer:
            ids = np.full(len(distinct), -1, np.int64)
            ids[hot[order.to_numpy()]] = np.arange(len(hot)) * groups + grp
            for block, part in zip(sent, np.split(ids[at], np.cumsum(sizes)[:-1])):
                if (part >= 0).any():
                    out["block"].append(block)
                    out["keys"].append(None)
                    out["data"].append(packed(part))
        n = len(out["block"])
        return pa.table([pa.array([lang] * n), pa.array([grp] * n, pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["keys"], pa.binary()), pa.array(out["data"], pa.binary())], names=["lang", "grp", "block", "keys", "data"])

    return stored(messages.groupBy("lang", "grp").applyInArrow(add, "lang string, grp int, block long, keys binary, data binary"), "phrase-exchange")


def symbols(exchanged: DataFrame, words: bool, groups: int) -> DataFrame:
    """Words: (lang, id, phrase, a); pairs: (lang, id, left, word, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, grp, keys, data in zip(*[c.to_pylist() for c in batch.columns]):
                a = unpacked(data).astype(np.int64)
                if len(a):
                    head = [pa.array([lang] * len(a)), pa.array(np.arange(len(a)) * groups + grp)]
                    if words:
                        yield pa.RecordBatch.from_arrays([*head, pa.array([w.decode() for w in keys.split(b"\n")]), pa.array(a)], names=["lang", "id", "phrase", "a"])
                    else:
                        code = unpacked(keys).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([*head, pa.array(code // WIDTH), pa.array(code % WIDTH), pa.array(a)], names=["lang", "id", "left", "word", "a"])

    rows = exchanged.where("block is null").select("lang", "grp", "keys", "data")
    return stored(rows.mapInArrow(run, "lang string, id long, phrase string, a long" if words else "lang string, id long, left long, word long, a long"), "phrase-symbols")


STATE = "block long, lang string, g binary, s binary, m long"


def _answered(right: pa.Table, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ids = np.full(len(order), -1, np.int64)
    for grp, data in zip(right.column("grp").to_pylist(), right.column("data").to_pylist()):
        ids[order[ends[grp - 1] if grp else 0 : ends[grp]]] = unpacked(data)
    return ids


def _state(block: int, lang: str, g: np.ndarray, s: np.ndarray) -> pa.Table:
    m = int(((s[:-1] >= 0) & (s[1:] >= 0)).sum())
    row = [[block], [lang], [packed(g)], [packed(s)], [m]] if m else [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["block", "lang", "g", "s", "m"])


def word_state(rows: DataFrame, exchanged: DataFrame, groups: int) -> DataFrame:
    """(block, lang, g, s, m): the ids of a block's words, -1 for rare ones and separators, as the first phrases; m places go on."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _state(0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        block, lang, hashes, seq = (left.column(c)[0].as_py() for c in ("block", "lang", "hashes", "seq"))
        ids = np.append(_answered(right, *dealt(unpacked(hashes), groups)), -1)  # the last for separators
        g = ids[unpacked(seq)]
        return _state(block, lang, g, g)

    return _joined(rows.select("block", "lang", "hashes", "seq"), exchanged, run)


def pair_state(state: DataFrame, exchanged: DataFrame, size: int, groups: int, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """The state with frequent phrases of one word more."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _state(0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        block, lang, g, s = (left.column(c)[0].as_py() for c in ("block", "lang", "g", "s"))
        g, s = unpacked(g), unpacked(s)
        at, first, last = followed(s, g, size)
        tiles = PairTiles(first, last, tile, dense)
        new = np.full(len(s), -1, np.int64)
        new[at] = _answered(right, *dealt(tiles.codes, groups))[tiles.index]
        return _state(block, lang, g, new)

    return _joined(state.select("block", "lang", "g", "s"), exchanged, run)


def _joined(state: DataFrame, exchanged: DataFrame, run) -> DataFrame:
    answers = exchanged.where("block is not null").select("block", "grp", "data")
    return stored(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, STATE), "phrase-state")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, group: int = GROUP, tile: int = TILE, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a), every phrase of up to `longest` words found `least` times or more, and (lang, n), the words of each language."""
    rows = stored(blocks(docs, text_col, lang_col, block), "phrase-blocks")
    n_groups = lambda df: max(1, -(-(df.agg(F.sum("m").alias("m")).first()["m"] or 0) // group))  # noqa: E731  entries sent, at most
    totals = stored(rows.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")  # one row a language
    groups = n_groups(rows)
    got = exchange(word_messages(rows, groups), True, groups, least)
    words = symbols(got, True, groups)
    state = word_state(rows, got, groups)
    forget(rows, got)
    level, found = words.withColumn("size", F.lit(1)), [words.select("lang", "phrase", F.lit(1).alias("size"), "a")]
    for size in range(1, longest):
        groups = n_groups(state)
        got = exchange(pair_messages(state, size, groups, tile, dense), False, groups, least, answer=size + 1 < longest)
        pairs = symbols(got, False, groups)
        ahead = pair_state(state, got, size, groups, tile, dense) if size + 1 < longest else None
        forget(state, got)
        state = ahead
        named = pairs.join(level.select("lang", F.col("id").alias("left"), F.col("phrase").alias("_first")), ["lang", "left"])
        named = named.join(words.select("lang", F.col("id").alias("word"), F.col("phrase").alias("_last")), ["lang", "word"])
        level = stored(named.select("lang", "id", F.concat_ws(" ", "_first", "_last").alias("phrase"), "a"), "phrase-level")
        forget(pairs)
        found.append(level.select("lang", "phrase", F.lit(size + 1).alias("size"), "a"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), the `top` phrases of each language.

    Defined cases: a null text is empty, a null language is `und`; a language without candidates has no row; a very long
    text is taken apart in slices, and only a piece without any separator has to fit a task; repeated rows count
    each; an empty table gives an empty table; further columns are not read.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, least, longest, **sizes)
    cand = found.where("size >= 2")
    part = lambda first, n: F.array_join(F.slice(F.col("w"), first, n), " ")
    split = cand.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = split.select("lang", "phrase", "size", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )).alias("s")).select("lang", "phrase", "size", "a", "k", "s.first", "s.part")
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    met = sides.join(counts, ["lang", "part"]).repartition("lang", "phrase")
    cuts = met.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = stored(scored.select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score"), "phrase-scored")
    # the largest count of a longer candidate around each
    inner = scored.where("size > 2").withColumn("w", F.split("phrase", " ")).withColumn("n_", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n_") + 1)))
    around = inner.select("lang", part(F.col("i"), F.col("n_")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM w, unnest(range(1, 5)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
u AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.w, x.a AS l, y.a AS r, i, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM c, unnest(range(1, c.k)) AS t(i)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[i + 1 :], ' ')),
s AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, c.k)) AS t(m), unnest(range(1, c.k - m + 2)) AS v(i) GROUP BY ALL),
q AS (SELECT s.* FROM s LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM q JOIN n USING (lang) QUALIFY rank <= 2000
"""

"""Conversation prefix trie as balanced parentheses, a shard at a time.

Conversations are sequences of turns, each a 128-bit mark of role and text. Sorted by their marks they form the
trie in depth-first order, so a range of the sorted rows is a shard that can be encoded by itself: a turn that the
conversation before does not share opens a parenthesis, one that the next does not share closes it. Over a
shard's parentheses `findclose` (excess blocks under a tree of minima) delimits every subtree, the rank of leaf pairs
counts leaves, and cumulative arrays over conversations and nodes give members, bytes and savings.

Only the spines, the nodes open where two shards meet, belong to more than one shard. All figures are sums over member
conversations and over opened nodes, so each shard adds its part of a spine node, and parts are merged by the
node's mark. A node is opened, and a leaf counted, in exactly one shard. The ids that end in a spine node are
hashed as a stream, in the order of shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.storage import forget, stored

#: Turns that a shard has on average, at most; bytes of a mark; parentheses in an excess block.
SHARD_TURNS, MARK, BLOCK = 200_000, 16, 64

FAR = np.int32(1 << 30)


class Parens:
    """Balanced parentheses (steps of +1 and -1) with the excess in blocks, and a tree of the blocks' minima."""

    def __init__(self, steps: np.ndarray):
        self.n, self.steps = len(steps), steps
        excess = np.full(-(-self.n // BLOCK) * BLOCK, FAR, np.int32)
        np.cumsum(steps, out=excess[: self.n])
        self.excess, self.blocks = excess, excess.reshape(-1, BLOCK)
        level = self.blocks.min(axis=1)
        self.tree = [level]
        while len(level) > 1:
            level = np.append(level, FAR) if len(level) % 2 else level
            self.tree[-1] = level
            level = level.reshape(-1, 2).min(axis=1)
            self.tree.append(level)

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.steps > 0)

    def leaf_rank(self) -> np.ndarray:
        """At each position how many leaf pairs () have begun there or before."""
        leaf = np.zeros(self.n, np.int64)
        leaf[:-1] = (self.steps[:-1] > 0) & (self.steps[1:] < 0)
        return np.cumsum(leaf)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """For open parentheses the positions of those that close them: where the excess first falls below what it was before them."""
        out = np.empty(len(at), np.int64)
        for s in range(0, len(at), 1 << 16):
            out[s : s + (1 << 16)] = self._close(at[s : s + (1 << 16)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        target, block = self.excess[at] - 1, at // BLOCK
        hit = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        here = hit.any(axis=1)
        out = block * BLOCK + hit.argmax(axis=1)
        far = np.flatnonzero(~here)
        if len(far):
            block = self._first_block(block[far] + 1, target[far])
            out[far] = block * BLOCK + (self.blocks[block] <= target[far, None]).argmax(axis=1)
        return out

    def _first_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block from `block` on whose minimum is no greater than the target: up the tree, then down."""
        node, level = block.copy(), np.full(len(block), -1)
        for k, minima in enumerate(self.tree):
            going = np.flatnonzero(level < 0)
            odd = going if k == len(self.tree) - 1 else going[node[going] % 2 == 1]
            found = minima[node[odd]] <= target[odd]
            level[odd[found]] = k
            up = np.flatnonzero(level < 0)
            node[up] = (node[up] + 1) // 2  # an odd node that does not hold it passes to the next, an even one to its parent
        for k in range(len(self.tree) - 1, 0, -1):
            down = np.flatnonzero(level == k)
            left = 2 * node[down]
            node[down] = left + (self.tree[k - 1][left] > target[down])
            level[down] = k - 1
        return node


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * MARK : mid * MARK] == b[low * MARK : mid * MARK]:
            low = mid
        else:
            high = mid - 1
    return low


def encode(keys: list[bytes], sizes: list[np.ndarray], ids: np.ndarray, left: int, right: int) -> dict[str, list]:
    """The nodes of one shard, sorted by key and id. `left` and `right`: turns shared with the shards beside it, -1 without one."""
    n = len(keys)
    length = np.array([len(k) // MARK for k in keys])
    lcp = np.array([0, *[shared_turns(a, b) for a, b in zip(keys, keys[1:])]])
    opened = length - lcp
    opened[0] += 1  # the root
    closed = np.append(length[:-1] - lcp[1:], length[-1] + 1)
    turns = np.stack([opened, closed], axis=1).ravel()
    tree = Parens(np.repeat(np.tile(np.array([1, -1], np.int8), n), turns))
    at = tree.opens()
    close = tree.findclose(at)
    depth = tree.excess[at].astype(np.int64) - 1
    conv = np.repeat(np.arange(n), opened)
    prefix = [np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes]  # bytes of the first turns
    own = np.concatenate([[0], *[s[d:] for s, d in zip(sizes, lcp)]]).astype(np.int64)
    above = np.concatenate([[0], *[p[d:-1] for p, d in zip(prefix, lcp)]]).astype(np.int64)
    parent, path, first, ends = np.full(len(at), -1), [0], 1, np.zeros(n, np.int64)
    for i in range(n):
        count = int(length[i] - lcp[i])
        del path[lcp[i] + 1 :]
        fresh = range(first, first + count)
        parent[first : first + count] = [path[-1], *fresh[:-1]] if count else []
        path.extend(fresh)
        ends[i], first = at[path[-1]], first + count
    inherited = (conv == 0) & (depth <= left)
    shared = inherited.copy()
    shared[path[: right + 1]] = True
    low, high = np.searchsorted(ends, at), np.searchsorted(ends, close)
    members = high - low
    least = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([low, high], axis=1).ravel())[::2]
    rank = tree.leaf_rank()
    if right == length[-1]:  # the next shard goes on from this end or repeats it: the leaf is counted there
        rank[ends[-1] :] -= 1
    leaves = rank[close] - np.where(at > 0, rank[at - 1], 0)
    total = np.concatenate([[0], np.cumsum([p[-1] for p in prefix], dtype=np.int64)])
    node = np.concatenate([[0], np.cumsum(np.where(inherited, 0, own))])
    k = np.arange(len(at))
    saved = total[high] - total[low] - members * above - (node[k + (close - at + 1) // 2] - node[k])
    mine = ~inherited & (parent >= 0)
    children = np.bincount(parent[mine], minlength=len(at))
    stop = np.searchsorted(ends, at, side="right")
    names = ids.astype(str)
    text = [",".join(names[a:b]) for a, b in zip(low, stop)]
    hashed = [t if s else hashlib.sha256(t.encode()).hexdigest() for t, s in zip(text, shared)]
    mark = lambda j: hashlib.md5(keys[conv[j]][: depth[j] * MARK]).digest()
    up_shared = (parent >= 0) & shared[parent]
    return {
        "shared": shared.tolist(), "key": [mark(j) if shared[j] else None for j in k], "parent_key": [mark(parent[j]) if up_shared[j] else None for j in k],
        "parent_conv_id": [None if p < 0 or u else int(least[p]) for p, u in zip(parent, up_shared)], "conv_id": least, "depth": depth, "n_convs": members, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved, "ends": hashed,
    }


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, marks, sizes) of each conversation in the order of turn, role and text. Texts move only for conversations where turn and role tie."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).isNotNull().alias("has"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
        F.octet_length(text(text_col)).cast("long").alias("size"),
    )
    rows = rows.withColumn("mark", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))

    def lists(df: DataFrame, *order: str) -> DataFrame:
        return df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*order, "mark", "size"))).alias("turns"))

    narrow = stored(lists(rows, "has", "turn", "role"), "trie-turns")
    places = lambda *cs: F.size(F.array_distinct(F.transform("turns", lambda t: F.struct(*[t[c].alias(c) for c in cs]))))
    tied = stored(narrow.where(places("has", "turn", "role") < places("has", "turn", "role", "mark")).select("conv"), "trie-tied")
    picked = lambda df: df.select("conv", F.col("turns.mark").alias("marks"), F.col("turns.size").alias("sizes"))
    if tied.isEmpty():
        return picked(narrow)
    whole = lists(rows.join(tied, "conv", "left_semi"), "has", "turn", "role", "text")
    return picked(narrow.join(tied, "conv", "left_anti")).unionByName(picked(whole))


def rebuilt(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % every, h being crc32(c) % most, and goes on with its own turns after h."""
    base = seqs.select(F.col("conv").alias("base"), F.slice("marks", 1, most).alias("base_marks"), F.slice("sizes", 1, most).alias("base_sizes"))
    own = seqs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % every)
    rest = lambda c: F.slice(c, F.col("h") + 1, F.size(c))
    begin = lambda c: F.coalesce(F.slice(c, F.lit(1), F.col("h")), F.array().cast(seqs.schema[c.removeprefix("base_")].dataType))
    both = own.join(base, "base", "left")
    return both.select("conv", *[F.concat(begin(f"base_{c}"), rest(c)).alias(c) for c in ("marks", "sizes")])


def trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """seqs: (conv, marks, sizes), marks as 32 hex digits. One row per node, as the query returns it.

    Defined cases: a conversation without turns is a member of the root; an empty table has no node; the list of a
    conversation's turns fits a task, as a text does.
    """
    spark = seqs.sparkSession
    rows = stored(seqs.select(F.unhex(F.array_join("marks", "")).alias("key"), "conv", "sizes"), "trie-rows")
    turns = rows.agg(F.sum(F.size("sizes")).alias("n")).first()["n"] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    dealt = stored(rows.repartitionByRange(n, "key", "conv").withColumn("shard", F.spark_partition_id()), "trie-shards")
    ends = dealt.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))  # one row a shard
    order = W.orderBy("shard")
    ends = ends.select("shard", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for first, last, before, after in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                left.append(-1 if before is None else shared_turns(before, first))
                right.append(-1 if after is None else shared_turns(last, after))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["shard", "left", "right"])

    borders = stored(ends.mapInArrow(beside, "shard int, left int, right int"), "trie-borders")

    def nodes(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("key", "ascending"), ("conv", "ascending")])
        sizes = [np.array(s, np.int64) for s in shard.column("sizes").to_pylist()]
        out = encode(shard.column("key").to_pylist(), sizes, shard.column("conv").to_numpy(), shard.column("left")[0].as_py(), shard.column("right")[0].as_py())
        return pa.table({"shard": pa.array([shard.column("shard")[0].as_py()] * len(out["ends"]), pa.int32())} | {f.name: pa.array(out[f.name], f.type) for f in SCHEMA})

    encoded = stored(dealt.join(borders, "shard").groupBy("shard").applyInArrow(nodes, NODE), "trie-nodes")
    parts = encoded.where("shared")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stored(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *sums), "trie-spines")
    hashed = stored(stream_hash(parts.where("ends <> ''").select("key", "shard", "ends")), "trie-ends")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spine = merged.join(hashed, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)))
    spine = spine.join(names, "parent_key", "left")
    inside = encoded.where("not shared")
    below = inside.where("parent_key is not null").drop("parent_conv_id").join(names, "parent_key")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    out = inside.where("parent_key is null").select(*cols).unionByName(below.select(*cols)).unionByName(spine.select(*cols))
    forget(rows, dealt, borders)
    return out


NODE = "shard int, shared boolean, key binary, parent_key binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
SCHEMA = [
    pa.field("shared", pa.bool_()), pa.field("key", pa.binary()), pa.field("parent_key", pa.binary()),
    *[pa.field(c, pa.int64()) for c in ("parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")], pa.field("ends", pa.string()),
]


def stream_hash(chunks: DataFrame) -> DataFrame:
    """chunks: (key, shard, ends). (key, ends): the SHA-256 of a key's chunks in the order of shards, comma-joined; one chunk at a time is in memory."""
    ordered = chunks.repartition("key").sortWithinPartitions("key", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(2)):
                key = key.as_py()
                if key != last:
                    if state:
                        yield row()
                    last, state = key, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
        if state:
            yield row()

    return ordered.mapInArrow(run, "key binary, ends string")


def query(spark, sf_dir: str) -> DataFrame:
    """Rows without a conv_id take no part; ties of turn go by role, then text; null roles and texts are empty."""
    from quarrystone.llm.common import table

    return trie(rebuilt(stored(sequences(table(spark, sf_dir, "conversations")), "trie-sequences")))


SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT i.conv_id, 0 AS part, k, role, text FROM i JOIN t ON t.conv_id = i.base AND k <= h
  UNION ALL SELECT i.conv_id, 1, k, role, text FROM i JOIN t ON t.conv_id = i.conv_id AND k > h),
p AS (
  SELECT conv_id, row_number() OVER o AS d, strlen(text) AS b, string_agg(md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER (o ROWS UNBOUNDED PRECEDING) AS key
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, k)),
l AS (SELECT i.conv_id, count(p.d) AS n FROM i LEFT JOIN p ON p.conv_id = i.conv_id GROUP BY i.conv_id),
m AS (SELECT conv_id, d, b, key FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (
  SELECT key, d, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b,
         coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE l.n = d), '') AS ends
  FROM m JOIN l ON l.conv_id = m.conv_id GROUP BY key, d),
c AS (SELECT substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key)),
a AS (SELECT substr(key, 1, 32 * x) AS key, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * b AS saved FROM f, unnest(range(0, d + 1)) AS u(x)),
s AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY key)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.key = f.key LEFT JOIN n q ON f.d > 0 AND q.key = substr(f.key, 1, 32 * (f.d - 1))
"""

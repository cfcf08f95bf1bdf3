r"""SimHash near-dedup with pivot distance tables.

Every document becomes a 64-bit fingerprint; documents with one fingerprint are one node, so copies cost
nothing further. Two fingerprints at `RADIUS` (2) or fewer differing bits agree in two of four blocks of 16
bits, so candidates meet in buckets (pair of blocks, 32 bits). In a bucket a table of Hamming distances to many
reference fingerprints (pivots) is computed once, and a pair goes when its largest coordinate difference
passes the radius: by the triangle inequality no link is lost. Survivors are verified, and a bucket returns a
spanning forest of its links instead of its pairs. With 32 bits in common, ten billion different texts leave two or
three fingerprints in a bucket, so the tables work at every size.

What fills a bucket further is a large group of near copies, and its pair table would grow with the square. A bucket
of more than `BUCKET` fingerprints therefore takes an exact way that does not: each member emits itself and its 64
one-bit neighbours as keys. Two fingerprints share a key exactly when they differ in at most two bits, and all
members of a key (65 at most) are linked to each other, so a star to the smallest of them has the same
components. No pair within a group is ever written out, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.components import connected_components
from quarrystone.storage import forget, stored

RADIUS, BUCKET, PIVOTS = 2, 48, 32

#: Shifts of the four blocks of 16 bits, and their pairs: fingerprints that differ in at most two bits agree in one pair.
BLOCKS = (0, 16, 32, 48)
PAIRS = tuple((a, b) for i, a in enumerate(BLOCKS) for b in BLOCKS[:i])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of a UTF-8 text; 0 where it has no word."""
    w = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, fp): fp is the fingerprint's 64 bits as a signed long, mark the text's hash. A null text has no words."""
    src = docs.select(F.col(id_col).alias("doc"), mark(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc", "mark", "fp"])

    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, mark long, fp long")


def mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def pivots(k: int = PIVOTS) -> np.ndarray:
    """k reference fingerprints: the hashes of 0 .. k-1."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(k)], dtype=np.uint64)


def bucket_links(fps: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints (uint64)."""
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    i, j = np.triu_indices(len(fps), 1)
    near = np.abs(table[i] - table[j]).max(axis=1) <= radius
    i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i[near].tolist(), j[near].tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[y] = x
            out.append((a, b))
    return out


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """nodes: (fp), distinct. Edges (a, b) with the components of 'differ in at most two bits'."""
    block = lambda shift: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFF))
    keys = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftleft(block(a), 16).bitwiseOR(block(b)).alias("value")) for i, (a, b) in enumerate(PAIRS)
    ])).alias("k")).select("fp", "k.block", "k.value")
    large = stored(keys.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "simhash-large")
    small = (
        keys.join(large, ["block", "value"], "left_anti")
        .groupBy("block", "value").agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1).select("fps")
    )
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, a, b = batch.column(0), [], []
            flat, offs = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for s, e in zip(offs[:-1], offs[1:]):
                for x, y in bucket_links(flat[s:e], refs):
                    a.append(flat[s + x])
                    b.append(flat[s + y])
            ends = [pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (a, b)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    verified = small.mapInArrow(run, "a long, b long")
    crowded = keys.join(large, ["block", "value"], "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)])
    stars = (
        crowded.select("fp", F.explode(flips).alias("key"))
        .groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select(F.explode(F.slice(F.array_sort("fps"), 2, 65)).alias("a"), F.array_min("fps").alias("b"))
        .distinct()
    )
    return verified.union(stars)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The prints (doc, mark, fp) of all rows, and (fp, root, component, first): of each fingerprint its component's root, smallest id and
    first row (doc, mark), null ids last."""
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    nodes = stored(prints.groupBy("fp").agg(F.min(row).alias("first")), "simhash-nodes")
    comp = stored(connected_components(links(nodes.select("fp")), "a", "b"), "simhash-components")
    named = stored(nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "simhash-named")
    firsts = stored(named.groupBy("root").agg(F.min("first").alias("first")), "simhash-first")
    names = stored(named.drop("first").join(firsts, "root").select("fp", "root", F.col("first.doc").alias("component"), "first"), "simhash-names")
    forget(nodes, comp, named, firsts)
    return prints, names


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp, component): component is the smallest id among all documents reachable over links.

    Defined cases: null and empty texts have fingerprint zero, linked like any other; rows with equal ids
    stay separate rows; a null id is never a component's name while another id is there; very long texts are read to
    their end; an empty table gives an empty table; further columns are not touched. Crowded buckets are met exactly, see above.
    """
    prints, names = groups(docs, id_col, text_col)
    return prints.join(names, "fp").select("doc", "fp", "component")


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest id, null ids last, then with the smallest text hash.

    Defined cases: rows are told apart by id and text, so of rows with one id and different texts each is judged by
    its own text; of rows equal in both one stays; null and empty texts are one group; an empty table gives an empty
    table; further columns travel along.
    """
    prints, names = groups(docs)
    kept = names.select("first.doc", "first.mark").distinct()
    same = prints["doc"].eqNullSafe(kept["doc"]) & (prints["mark"] == kept["mark"])
    gone = stored(prints.join(kept, same, "left_anti").select("doc", "mark").distinct(), "simhash-gone")
    again = stored(prints.groupBy("doc", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc", "mark"), "simhash-again")
    forget(prints, names)
    on = lambda t: docs["doc_id"].eqNullSafe(t["doc"]) & (mark("text") == t["mark"])
    left = docs.join(gone, on(gone), "left_anti")
    once = left.join(again, on(again), "left_anti")
    repeated = left.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).select(*docs.columns)

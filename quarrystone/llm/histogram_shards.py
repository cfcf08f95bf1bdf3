"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts lie side by side. A border between
two shards is wanted where a given number of bytes lies below it. In each round all partitions count, exactly, the
bytes between candidate borders; the interval that holds a wanted position is tightened to the keys found in it
and probed again, until a border is within the tolerance. Where a single key reaches over the wanted position (a
large group of equal texts) the next part of the order is probed inside it, down to single rows. Only the counts of a
round, some `PROBES` numbers for each border, reach the driver. Then every row knows its shard, and rows are exchanged
once, by shard and part of a shard, to take their slots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.storage import forget, stored

SHARDS, OVERHEAD = 24, 8
#: Part of a shard's mean size by which a border may be off where that keeps equal texts together.
TOLERANCE = 0.005
#: Candidates for each border in a round; rows that a part of a shard has on average.
PROBES, PART = 64, 50_000

KEY = ("h", "g", "row")
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Open:
    """A border still looked for: rows of `prefix` whose next key lies in [lo, hi] reach over it; `below` bytes lie before them."""

    wanted: float
    prefix: tuple[int, ...] = ()
    lo: int = LEAST
    hi: int = MOST
    below: int = 0


def candidates(lo: int, hi: int, count: int) -> np.ndarray:
    """Up to `count` keys in (lo, hi], evenly spread."""
    n = min(count, hi - lo)
    return np.array([lo + -(-(hi - lo) * k // n) for k in range(1, n + 1)], dtype=np.int64)


def histogram(keys: DataFrame, probes: list[tuple[tuple[int, ...], int, int, np.ndarray]]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(probe, bucket) -> (bytes, rows, smallest key, largest key). A probe is (prefix, lo, hi, candidates); a bucket ends before its candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(c) + 1), np.int64) for *_, c in probes]
        ends = [np.repeat([[MOST], [LEAST]], len(c) + 1, axis=1) for *_, c in probes]
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in KEY]
            size = batch.column("size").to_numpy()
            for (prefix, lo, hi, cand), total, end in zip(probes, sums, ends):
                key = cols[len(prefix)]
                mine = (key >= lo) & (key <= hi)
                for col, value in zip(cols, prefix):
                    mine &= col == value
                key = key[mine]
                bucket = np.searchsorted(cand, key, side="right")
                np.add.at(total[0], bucket, size[mine])
                np.add.at(total[1], bucket, 1)
                np.minimum.at(end[0], bucket, key)
                np.maximum.at(end[1], bucket, key)
        for i, (total, end) in enumerate(zip(sums, ends)):
            full = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), i)), pa.array(full), *[pa.array(x[full]) for x in (*total, *end)]], names=["probe", "bucket", "bytes", "n", "lo", "hi"])

    each = keys.select(*KEY, "size").mapInArrow(run, "probe long, bucket long, bytes long, n long, lo long, hi long")
    rows = each.groupBy("probe", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {(r["probe"], r["bucket"]): (r["bytes"], r["n"], r["lo"], r["hi"]) for r in rows.collect()}  # as many rows as candidates


def border_before(prefix: tuple[int, ...], key: int) -> tuple[int, int, int]:
    return (*prefix, key, LEAST, LEAST)[:3]


def border_after(prefix: tuple[int, ...], key: int) -> tuple[int, int, int]:
    """Behind all rows with this key: the last part of a key, the row number, never is MOST."""
    return (*prefix, key, MOST, MOST)[:3] if len(prefix) < 2 else (*prefix, key + 1)


def splitters(keys: DataFrame, total: int, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """The shards - 1 borders, ascending, as keys: a row is behind a border that is not greater than its key."""
    slack = tolerance * total / shards
    open_ = {i: Open(total * i / shards) for i in range(1, shards)}
    found: dict[int, tuple[int, int, int]] = {}
    while open_:
        wide: dict[tuple, list[int]] = {}
        for i, o in open_.items():
            wide.setdefault((o.prefix, o.lo, o.hi, o.below), []).append(i)
        asked = [(*k[:3], candidates(k[1], k[2], probes * len(own))) for k, own in wide.items()]
        counts = histogram(keys, asked)
        for p, ((prefix, _, _, below), own) in enumerate(wide.items()):
            full = sorted(b for q, b in counts if q == p)
            starts = below + np.concatenate([[0], np.cumsum([counts[p, b][0] for b in full])])
            for i in own:
                wanted = open_[i].wanted
                at = min(int(np.searchsorted(starts, wanted, side="right")) - 1, len(full) - 1)
                size, n, lo, hi = counts[p, full[at]]
                before, after = wanted - starts[at], starts[at + 1] - wanted
                alone = lo == hi and (n == 1 or len(prefix) == 2)
                if alone or min(before, after) <= slack:
                    found[i] = border_before(prefix, lo) if before <= after else border_after(prefix, hi)
                    del open_[i]
                elif lo == hi:
                    open_[i] = Open(wanted, (*prefix, lo), below=int(starts[at]))
                else:
                    open_[i] = Open(wanted, prefix, lo, hi, int(starts[at]))
    return sorted(found.values())


def shard_of(cols: Sequence[np.ndarray], borders: list[tuple[int, int, int]]) -> np.ndarray:
    """How many borders each key is behind."""
    h, g, row = cols
    first = np.array([b[0] for b in borders], np.int64)
    out = np.searchsorted(first, h, side="left")
    for value in np.unique(first):
        mine = np.flatnonzero(h == value)
        for b in borders:
            if b[0] == value and len(mine):
                out[mine] += (g[mine] > b[1]) | ((g[mine] == b[1]) & (row[mine] >= b[2]))
    return out


def shards(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), tolerance: float = TOLERANCE, probes: int = PROBES) -> DataFrame:
    """(doc, size, text_crc32, carry..., shard, part, slot): every row in one of `n` shards of near equal bytes.

    A size is the UTF-8 bytes of the text plus 8. Slots count from 0 in a shard without gaps. Equal texts share a shard
    but where a border falls inside a group larger than the tolerance. A shard is worked on in parts, which a writer may
    take as its files. Defined cases: a null text has no bytes and lies with the empty ones; null and repeated ids and
    wholly equal rows are rows of their own, of equal ones any may be on either side of a border; a text longer than a
    shard lies alone as far as its neighbours allow, and shards may stay empty where there are fewer rows; an empty table
    gives an empty table; further columns travel only where `carry` names them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("doc"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.col(id_col)).alias("g"), F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
    )
    keys = stored(keys, "shard-keys")  # the row number is stored, so it stays
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    borders = splitters(keys, total, n, tolerance, probes) if total and n > 1 else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of([batch.column(c).to_numpy() for c in KEY], borders) if borders else np.zeros(batch.num_rows, np.int64)
            kept = [c for c in batch.schema.names if c not in ("h", "g")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(shard.astype(np.int32))], names=[*kept, "shard"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema if f.name not in ("h", "g"))
    placed = stored(keys.mapInArrow(place, f"{kinds}, shard int"), "shard-placed")
    forget(keys)
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / PART).alias("parts"))
    sizes = F.broadcast(stored(sizes.withColumnRenamed("shard", "s"), "shard-parts"))  # at most n rows
    split = placed.join(sizes, placed["shard"] == sizes["s"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("s", "parts")
    counts = split.groupBy("shard", "part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stored(counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), base.alias("base")), "shard-bases")
    within = F.row_number().over(W.partitionBy("shard", "part").orderBy("row")) - 1
    ranked = split.withColumn("within", within).join(bases, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return ranked.select("doc", "size", "text_crc32", *[F.col("carried").getField(c).alias(c) for c in carry], "shard", "part", (F.col("base") + F.col("within")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard under `path`, its parts as files, committed by Spark."""
    sharded.write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    out = shards(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

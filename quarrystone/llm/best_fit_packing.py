"""Best-fit packing planned over a histogram of lengths.

Texts become token ids and pieces of at most `capacity` tokens. Only the histogram of piece lengths, at most
`capacity` rows, reaches the driver. Best fit, longest first, runs over its counts: pieces of one length fill
equally open sequences in one step, so the plan has a few rows for each length however many documents there
are. Every piece then takes the planned slot of its rank among pieces of its length. Ranks are counted within
salted parts of a length and shifted by what the parts before hold, so a length that a third of all pieces
share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.tokens import encoder
from quarrystone.storage import stored

CAPACITY, END_ID = 2048, 0
#: Pieces that one part of a length has on average, at most: there are as many parts in all as pieces / PART, and one for each length.
PART = 1000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): pieces of these ranks go, one each, to consecutive sequences."""
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    slots, sequences = [], 0

    def fill(length: int, rank: int, room: int, first: int, count: int, each: int) -> None:
        for j in range(each):
            slots.append((length, rank + j * count, count, first, capacity - room + j * length))
        open_[room - each * length].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank, room = histogram[length], 0, length
        while left:
            while room <= capacity and not open_[room]:
                room += 1
            if room > capacity:
                room = capacity
                first, count = sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = open_[room].pop()
            each = min(room // length, left)
            whole = min(count, left // each)
            fill(length, rank, room, first, whole, each)
            rank, left, first, count = rank + whole * each, left - whole * each, first + whole, count - whole
            if count and left and left < each:
                fill(length, rank, room, first, 1, left)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                open_[room].append((first, count))
            room = length
    return slots


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc, piece, start, length, ids_crc32[, ids]) of every document, cut only where it is longer than a sequence."""
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = src.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text) + end
                for k, s in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces with (sequence_id, offset): gapless from 0 in each sequence, in about as few sequences as can be.

    `with_ids` adds the token ids (little-endian unsigned 32-bit) of each piece. Defined cases: null and empty
    texts are one piece, the end id; rows with equal ids are separate documents that get slots of their own; an
    empty table gives an empty table; further columns are not read.
    """
    part = stored(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")  # the number is stored, so it stays
    names = [c for c in part.columns if c != "row"]
    lengths = stored(part.groupBy(F.col("length").alias("l")).agg(F.count("*").alias("n")), "pack-lengths")  # at most `capacity` rows
    histogram = {r["l"]: r["n"] for r in lengths.collect()}
    slots = sorted(plan(histogram, capacity))
    salts = F.ceil(F.col("n") / PART)
    salted = part.join(lengths, part["length"] == lengths["l"]).withColumn("salt", F.pmod(F.xxhash64("row"), salts)).select(*names, "row", "salt")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stored(counts.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("base")), "pack-bases")
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1
    ranked = salted.withColumn("within", within)
    ranked = ranked.join(bases, (ranked["length"] == bases["l"]) & (ranked["salt"] == bases["s"]))
    ranked = ranked.select(*names, (F.col("base") + F.col("within")).alias("rank"))
    keys = np.array([(length << 44) | rank for length, rank, *_ in slots], dtype=np.int64)
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            cols = [batch.column(c) for c in names] + [pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema if f.name in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: placements of all pieces instead of documents.

    The cases are those of `pack`: a null or empty text is one piece, every row is packed whatever its id, a very long
    text is cut into many pieces, an empty table gives an empty table, and further columns are not read.
    """
    return pack(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")

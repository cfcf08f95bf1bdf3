"""Token-ID files: documents in ascending id order, ids in Simple-8b blocks.

Documents are range-partitioned by id; each partition encodes its documents in order and becomes one shard, a
Parquet file of blocks. A block holds whole documents: their ids (Simple-8b words with a directory), their
lengths (Simple-8b too) and how many ids of the shard stand before it, so every block is decoded by itself.
Spark's writer commits the shards, so a lost executor or a repeated task leaves no half file. Where a shard
starts in the whole sequence follows from one number per shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.llm.simple8b import read_block, to_block
from quarrystone.llm.tokens import encoder
from quarrystone.storage import shared_dir, stored

#: Ids after which a block ends (with the document that passes it), and the id that ends a document.
BLOCK_IDS, END_ID = 1 << 16, 2
#: Bytes of text in a shard, about; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode every text, append `end_id`, and write the shards under `path`.

    Defined cases: a null text is encoded as the empty text (one id, the end id); null ids come first; rows
    with equal ids stand side by side, ordered by their text's hash, over several shards where they are many; an empty table writes a table
    without rows; further columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not shards:
        size = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]  # the hash lets rows of one id (null ids too) fall into many shards
    ordered = src.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    kind = src.schema["doc"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer)
        docs_, data, size = [], [], 0

        def flush():
            nonlocal block, start, docs_, data, size
            ids = np.frombuffer(b"".join(data), "<u4")
            lens = np.array([len(d) // 4 for d in data], dtype=np.uint64)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([docs_], pa.list_(doc_type)), pa.array([to_block(lens)], pa.binary()), pa.array([to_block(ids)], pa.binary())],
                names=["shard", "block", "start", "n_ids", "docs", "lengths", "ids"],
            )
            block, start, docs_, data, size = block + 1, start + len(ids), [], [], 0
            return row

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_.append(doc)
                data.append(encode(text) + end)
                size += len(data[-1]) // 4
                if size >= BLOCK_IDS:
                    yield flush()
        if data:
            yield flush()

    ordered.mapInArrow(run, f"shard int, block int, start long, n_ids long, docs array<{kind}>, lengths binary, ids binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32[, ids]) per document, from the files: start counts the ids of all documents before.

    The one window without a key runs over a row per shard, and a shard is `SHARD_BYTES` of text: 400,000 rows at 100 TB.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per file
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stored(sizes.select(F.col("shard").alias("s"), before.alias("base")), "token-shards")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                docs = batch.column(2).slice(i, 1).flatten()
                lens = read_block(batch.column(3)[i].as_py()).astype(np.int64)
                ids = memoryview(read_block(batch.column(4)[i].as_py()).astype("<u4").tobytes())
                ends = np.cumsum(lens)
                texts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lens.tolist())]
                cols = [pa.array(np.full(len(lens), shard, np.int32)), docs, pa.array(start + ends - lens), pa.array(lens), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["shard", "doc", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(t, "<u4").astype(np.int64) for t in texts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = blocks.select("shard", "start", "docs", "lengths", "ids").mapInArrow(run, f"shard int, doc {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    rows = rows.join(bases, rows["shard"] == bases["s"])
    return rows.select("doc", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarrystone.llm.common import table

    path = shared_dir(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).withColumnRenamed("doc", "doc_id")

"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words and is stripped from line ends: `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where the text is ASCII anyway."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label): at most `per_class` training ids of each class, those with the smallest hashes of the id.

    Its size is bounded by 2 * per_class rows of two numbers, whatever the input, so it may be broadcast.
    Null ids or labels, and ids labelled both ways, take no part.
    """
    rows = (
        labels.where(train & F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("y1"))
        .where("y = y1")
        .select("id", F.col("y").cast("int").alias("y"), F.xxhash64(F.lit("sample"), "id").alias("h"))
    )
    return (
        rows.where("y = 0").orderBy("h", "id").limit(per_class)
        .union(rows.where("y = 1").orderBy("h", "id").limit(per_class))
        .select("id", "y")
    )


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of the sampled documents. The sample's size is bounded, so it is broadcast and no text is shuffled."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.join(F.broadcast(sample), "id")

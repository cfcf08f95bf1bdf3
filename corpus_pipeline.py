"""Documents in, packed sequences out: the stages of the corpus pipeline.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import best_fit_packing, line_dedup, simhash_dedup, source_mixing, toxicity
from quarrystone.storage import stored

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", simhash_dedup.stage),
    ("mixing", source_mixing.stage),
    ("packing", best_fit_packing.stage),
]

#: Tokenizing and fingerprints can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, f in STAGES:
        docs = stored(f(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

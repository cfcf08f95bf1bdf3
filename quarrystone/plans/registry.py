"""Every query of the reference's operators, by name, with its SQL where SQL can express it.

A query takes (spark, sf_dir) and reads the tables it needs; modules of this package fill the two dicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(
    "f2_top_findings",
    """
    SELECT o_orderkey AS finding_id, o_custkey AS project_id,
           CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3
                WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS severity_rank
    FROM orders WHERE o_orderstatus IN ('O', 'P')
    ORDER BY severity_rank DESC, o_orderdate DESC, o_orderkey LIMIT 100
    """,
)
def top_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    rank = F.lit(0)
    for value, r in {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}.items():
        rank = F.when(F.col("o_orderpriority") == value, r).otherwise(rank)
    o = o.withColumn("severity_rank", rank)
    o = o.orderBy(F.desc("severity_rank"), F.desc("o_orderdate"), "o_orderkey").limit(100)
    return o.select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("project_id"), "severity_rank")


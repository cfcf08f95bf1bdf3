"""The driver's tables read as the findings model, in Spark and as SQL prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.plans.registry import table

PRIORITY = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "LOW", "5-LOW": "INFO"}
STATUS = {"O": "OPEN", "P": "CONFIRMED", "F": "RESOLVED"}


def findings(spark, sf_dir) -> DataFrame:
    """orders: order = finding, customer = project, priority = severity, order status = status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("project_id"),
        X.mapped(F.col("o_orderpriority"), PRIORITY, "INFO").alias("severity"), X.mapped(F.col("o_orderstatus"), STATUS, "OPEN").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.round("o_totalprice", 2).alias("price"),
    )


FINDINGS = """f AS (
  SELECT o_orderkey AS finding_id, o_custkey AS project_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '4-NOT SPECIFIED' THEN 'LOW' ELSE 'INFO' END AS severity,
         CASE o_orderstatus WHEN 'P' THEN 'CONFIRMED' WHEN 'F' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
         o_orderdate AS created_at, round(o_totalprice, 2) AS price
  FROM orders)"""

RANK = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"


def reviews(spark, sf_dir) -> DataFrame:
    """lineitem: one review of the order per line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("review_id"), F.col("l_shipdate").alias("created_at"),
        X.mapped(F.col("l_returnflag"), {"A": "TRUE_POSITIVE", "R": "FALSE_POSITIVE"}, "UNCERTAIN").alias("verdict"), F.col("l_quantity").alias("quantity"),
    )


REVIEWS = """r AS (
  SELECT l_orderkey AS finding_id, l_linenumber AS review_id, l_shipdate AS created_at,
         CASE l_returnflag WHEN 'A' THEN 'TRUE_POSITIVE' WHEN 'R' THEN 'FALSE_POSITIVE' ELSE 'UNCERTAIN' END AS verdict, l_quantity AS quantity
  FROM lineitem)"""


def tasks(spark, sf_dir) -> DataFrame:
    """events: one task each; props.k decides type and repository."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), F.col("user_id").alias("project_id"), k.alias("k"), F.col("ts").alias("created_at"),
        F.when(k % 7 == 0, "SCA_CHECK").when(k % 7 == 1, "SUPPLY_CHAIN").otherwise("CODE_CHECK").alias("type"),
        X.mapped(F.col("event_type"), {"signup": "PENDING", "view": "RUNNING", "click": "SUCCEEDED", "purchase": "SUCCEEDED", "error": "FAILED"}, "PENDING").alias("status"),
        F.when(k % 3 == 0, F.expr("ts + INTERVAL 2 HOURS")).alias("updated_at"), F.round("value", 4).alias("value"),
    )


TASKS = """t AS (
  SELECT event_id AS task_id, user_id AS project_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts AS created_at,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 7 = 0 THEN 'SCA_CHECK' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 7 = 1 THEN 'SUPPLY_CHAIN' ELSE 'CODE_CHECK' END AS type,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'SUCCEEDED' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' ELSE 'PENDING' END AS status,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 THEN ts + INTERVAL 2 HOUR END AS updated_at, round(value, 4) AS value
  FROM events)"""


def day(col: str):
    return F.date_format(col, "yyyy-MM-dd")

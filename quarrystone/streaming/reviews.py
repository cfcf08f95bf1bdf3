"""Pending reviews applied in micro-batches: a ledger of applied jobs, and bad results set aside so that the rest go on.

A batch writes its review rows, the status changes of findings and the results it could not read in one folder, by one
commit. What was applied before is read from the folders of earlier batches, so a batch that runs again replaces its
own folder with the same rows, and a job that was applied is not applied again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.operators.relational import latest
from quarrystone.operators.upsert import review_decisions
from quarrystone.streaming.outbox import written

RESULT = "target_id LONG, status STRING, verdict STRING, reason STRING, confidence DOUBLE, suggested STRING"
LEDGER = "kind STRING, job_id LONG, target_id LONG, verdict STRING, reason STRING, confidence DOUBLE, status_before STRING, status_after STRING, applied_at TIMESTAMP, error STRING, payload STRING"
STATES = ("RUNNING", "FAILED", "COMPLETED")


def checked(results: DataFrame) -> DataFrame:
    """results: (job_id, payload), payload being JSON. With the fields of RESULT, and `error`, null where the result can be applied."""
    doc = F.try_parse_json(F.col("payload"))
    rows = results.select("job_id", "payload", F.from_json("payload", RESULT).alias("r"), doc.alias("_doc"))
    said = F.try_variant_get("_doc", "$.confidence", "string")
    error = (
        F.when(F.col("job_id").isNull(), "no job").when(F.col("_doc").isNull(), "no JSON").when(F.col("r.target_id").isNull(), "no target")
        .when(~F.coalesce(F.col("r.status"), F.lit("")).isin(*STATES), "unknown status")
        .when(said.isNotNull() & ~F.coalesce(said.try_cast("double").between(0, 1), F.lit(False)), "confidence out of range")
    )
    return rows.select("job_id", "payload", "r.*", error.alias("error"))


def statuses(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """The findings with the status that the ledger's changes left them in."""
    changes = ledger.where("kind = 'finding'")
    last = changes.groupBy(F.col("target_id").alias("_id")).agg(F.max_by("status_after", "batch").alias("_after"))
    return findings.join(last, F.col("finding_id") == F.col("_id"), "left").withColumn("status", F.coalesce("_after", "status")).drop("_id", "_after")


def review_sink(spark: SparkSession, path: str, findings: DataFrame, now) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for (job_id, payload). findings: (finding_id, status, ...), as they were before any batch; read results with `written(spark, path, LEDGER)`.

    Of several results of a job in a batch the first by payload counts; of several that change one finding the first job's does.
    """

    def sink(batch: DataFrame, number: int) -> None:
        before = written(spark, path, LEDGER).where(F.col("batch") < number)
        rows = checked(batch)
        bad = rows.where("error is not null").select(F.lit("rejected").alias("kind"), "job_id", "target_id", "error", "payload")
        good = latest(rows.where("error is null"), ["job_id"], [F.col("payload")]).withColumnRenamed("status", "job_status")
        reviews = before.where("kind = 'review'").select("job_id", "applied_at", "status_before")
        done = review_decisions(good, reviews, statuses(findings, before))
        first = F.row_number().over(W.partitionBy("target_id", F.col("status_after").isNotNull()).orderBy("job_id")) == 1
        done = done.withColumn("_first", first).withColumn("status_after", F.when(F.col("_first"), F.col("status_after"))).withColumn("applied_at", now)
        review = done.select(F.lit("review").alias("kind"), "job_id", "target_id", "verdict", "reason", "confidence", "status_before", "status_after", "applied_at")
        change = done.where("status_after is not null").select(F.lit("finding").alias("kind"), "job_id", "target_id", "status_before", "status_after", "applied_at")
        out = review.unionByName(change, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
        names = spark.createDataFrame([], LEDGER).columns
        out.select(*names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink

"""Keyed mutations as set operations: a target and its updates give the next snapshot.

Plain Parquet has no MERGE, so a mutation returns the whole next state, to be written as a new snapshot (or
inside foreachBatch). Updates are reduced to one row per key first; a key is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators.relational import latest


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] = (), reset: dict[str, Column] | None = None) -> DataFrame:
    """The updates over the target by key: of several updates the first in the order counts.

    Rows that existed keep the columns in `keep`; `reset` sets columns of every updated row. Keys compare
    null-safely. A full outer join over keys that are unique on both sides.
    """
    new = latest(updates, keys, order).withColumn("_new", F.lit(True)).alias("n")
    old = target.withColumn("_old", F.lit(True)).alias("o")
    on = None
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = c if on is None else on & c
    cols = []
    for c in target.columns:
        if c in keys:
            v = F.coalesce(f"o.{c}", f"n.{c}")
        elif c in keep:
            v = F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        else:
            v = F.when(F.col("_new"), (reset or {}).get(c, F.col(f"n.{c}"))).otherwise(F.col(f"o.{c}"))
        cols.append(v.alias(c))
    return old.join(new, on, "full_outer").select(*cols)


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The target with those rows whose key it lacks, one for each key."""
    fresh = latest(rows, keys, order).join(target, list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_sets(target: DataFrame, rows: DataFrame, owner: Sequence[str]) -> DataFrame:
    """All rows of the owners in `rows` replaced by theirs, without repeats."""
    rest = target.join(rows.select(*owner).distinct(), list(owner), "left_anti")
    return rest.unionByName(rows.select(*target.columns).distinct())


def ingest_findings(target: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """One active row per (project_id, fingerprint, status): a repeat keeps the row there is and refreshes updated_at."""
    keys = ["project_id", "fingerprint", "status"]
    live = F.col("deleted_at").isNull() & F.col("status").isin("OPEN", "CONFIRMED")
    fresh = latest(found.where(live), keys, [F.col("created_at"), F.col("finding_id")])
    again = fresh.select(*keys).withColumn("_again", F.lit(True))
    kept = target.join(again, keys, "left").withColumn("updated_at", F.when(F.col("_again") & live, now).otherwise(F.col("updated_at")))
    new = fresh.join(target.where(live), keys, "left_anti")
    return kept.select(*target.columns).unionByName(new.select(*target.columns)).unionByName(found.where(~live).select(*target.columns))


def change_status(target: DataFrame, changes: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """changes: (key, status, reviewer). The next state, and an audit row with the status before and after for each change."""
    c = changes.select(F.col(key), F.col("status").alias("_status"), F.col("reviewer").alias("_by"))
    both = target.join(c, key, "left")
    hit = F.col("_status").isNotNull()
    state = both.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_status", "status"))
    audit = both.where(hit).select(key, F.lit("HUMAN").alias("review_type"), F.col("_by").alias("reviewer"), F.col("status").alias("status_before"), F.col("_status").alias("status_after"), now.alias("applied_at"))
    return state.select(*target.columns), audit


def soft_delete(target: DataFrame, keys: DataFrame, key: str, now: Column) -> DataFrame:
    """deleted_at set on active rows of the keys."""
    both = target.join(keys.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return both.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*target.columns)


def retain(df: DataFrame, now: Column, days: int = 7, created: str = "created_at") -> DataFrame:
    return df.where(F.col(created) >= now - F.make_dt_interval(F.lit(days)))


def review_decisions(results: DataFrame, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """What each review result does; one row for each job that is not applied yet and says something.

    results: (job_id, target_id, job_status, verdict, reason, confidence, suggested). FAILED gives verdict FAILED
    and no status. COMPLETED applies a suggestion of CONFIRMED or FALSE_POSITIVE to a finding that is OPEN.
    `is_new` says that the review row is missing and has to be inserted; jobs without a finding do nothing,
    but for a failed job that already has its row.
    """
    seen = reviews.select("job_id", "applied_at", F.col("status_before").alias("_before"), F.lit(True).alias("_known"))
    own = findings.select(F.col("finding_id").alias("target_id"), F.col("status").alias("_status"))
    rows = results.where(F.col("job_status").isin("FAILED", "COMPLETED")).join(seen, "job_id", "left").where("applied_at is null").join(own, "target_id", "left")
    failed, known = F.col("job_status") == "FAILED", F.coalesce("_known", F.lit(False))
    rows = rows.where(F.col("_status").isNotNull() | (failed & known))
    after = F.when(~failed & (F.col("_status") == "OPEN"), X.normalize_status(F.col("suggested")))
    return rows.select(
        "job_id", "target_id", F.when(failed, "FAILED").otherwise(F.coalesce("verdict", F.lit("DONE"))).alias("verdict"), "reason",
        F.when(~failed, F.col("confidence")).alias("confidence"), F.coalesce("_before", F.when(~failed | ~known, F.col("_status"))).alias("status_before"),
        after.alias("status_after"), (~known).alias("is_new"),
    )


def review_route(findings: DataFrame, default_mode: str = "simple", dataflow_mode: str | None = "precise") -> DataFrame:
    """OPEN findings with the review mode they go to and whether they are ticket candidates (HIGH or worse)."""
    mode = F.when(F.col("has_dataflow"), F.lit(dataflow_mode or "precise")).otherwise(F.lit(default_mode))
    return findings.where(F.col("status") == "OPEN").withColumn("mode", mode).withColumn("ticket", X.severity_rank(F.col("severity")) >= 4)


def merge_identities(grants: DataFrame, remap: DataFrame, user: str = "user_id") -> DataFrame:
    """Grants with old user ids replaced; what the new id already has comes out once. remap: (old_id, new_id), unique in old_id."""
    both = grants.join(remap, grants[user] == remap["old_id"], "left")
    return both.withColumn(user, F.coalesce("new_id", user)).select(*grants.columns).distinct()


def merge_drafts(drafts: DataFrame, remap: DataFrame, user: str = "user_id") -> DataFrame:
    """One draft per user: a draft the new id has itself wins over the old id's, of several old ones the smallest old id's."""
    both = drafts.join(remap, drafts[user] == remap["old_id"], "left").withColumn("_own", F.col("new_id").isNull()).withColumn("_from", F.col(user))
    both = both.withColumn(user, F.coalesce("new_id", user))
    return latest(both, [user], [F.desc("_own"), F.col("_from")]).select(*drafts.columns)


def ruleset_selection(mode: str, given: DataFrame, rulesets: DataFrame, rules: DataFrame, profile: str = "default") -> DataFrame:
    """(rule_id): EXPLICIT: the given ids, or none if one is unknown; PROFILE: the latest ruleset's; AUTO: that, else for `default` all enabled rules."""
    if mode == "EXPLICIT":
        missing = given.join(rules, "rule_id", "left_anti").agg(F.count("*").alias("n"))
        return given.select("rule_id").distinct().join(F.broadcast(missing), F.col("n") == 0).select("rule_id")
    newest = latest(rulesets.where((F.col("profile") == profile) & F.col("deleted_at").isNull()), ["profile"], [F.desc("created_at"), F.col("ruleset_id")])
    own = newest.select(F.explode("rule_ids").alias("rule_id"))
    if mode == "PROFILE" or profile != "default":
        return own
    none = newest.agg(F.count("*").alias("n"))
    return own.union(rules.where("enabled").join(F.broadcast(none), F.col("n") == 0).select("rule_id"))


def result_status(results: DataFrame) -> DataFrame:
    """SUCCEEDED only with the success flag and, for SCAN_EXEC, a result file; the log level is ERROR otherwise."""
    ok = F.coalesce("success", F.lit(False)) & ((F.col("stage_type") != "SCAN_EXEC") | F.coalesce("has_file", F.lit(False)))
    return results.withColumn("status", F.when(ok, "SUCCEEDED").otherwise("FAILED")).withColumn("log_level", F.when(ok, "INFO").otherwise("ERROR"))

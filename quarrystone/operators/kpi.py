"""Overview aggregates: each in one pass over its input, conditional counts instead of a query per figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import expr as X


def task_kpis(tasks: DataFrame, keys: Sequence[str], start, day_ago) -> DataFrame:
    """running, failed within a day, all of the window, and the share of terminal tasks that succeeded (0.0 when none)."""
    at = F.coalesce("updated_at", "created_at")
    inside, status = F.col("created_at") >= F.lit(start), F.col("status")
    done = F.count_if(inside & status.isin("SUCCEEDED", "FAILED", "CANCELED"))
    return tasks.groupBy(*keys).agg(
        F.count_if(status == "RUNNING").alias("running"), F.count_if((status == "FAILED") & (at >= F.lit(day_ago))).alias("failed_24h"),
        F.count_if(inside).alias("total_window"), F.count_if(inside & (status == "SUCCEEDED")).alias("_ok"), done.alias("_done"),
    ).withColumn("success_rate", F.when(F.col("_done") > 0, F.col("_ok") / F.col("_done")).otherwise(F.lit(0.0))).drop("_ok", "_done")


def finding_kpis(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """open, confirmed, and the unresolved of each severity."""
    unresolved = F.col("status").isin("OPEN", "CONFIRMED")
    return findings.groupBy(*keys).agg(
        F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"),
        *[F.count_if(unresolved & (F.col("severity") == s)).alias(s.lower()) for s in X.SEVERITIES],
    )


def review_kpis(reviews: DataFrame, keys: Sequence[str], start) -> DataFrame:
    """AI reviews queued, completed in the window, and applied with a change of status."""
    ai, done = F.col("review_type") == "AI", F.col("applied_at").isNotNull()
    changed = F.col("status_before").isNotNull() & F.col("status_after").isNotNull() & (F.col("status_before") != F.col("status_after"))
    inside = done & (F.col("applied_at") >= F.lit(start))
    return reviews.groupBy(*keys).agg(F.count_if(ai & ~done).alias("queued"), F.count_if(ai & inside).alias("completed"), F.count_if(ai & inside & changed).alias("auto_applied"))


def by_status_and_type(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., dimension, value, n): both groupings from one scan."""
    both = tasks.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("status", "type")])).alias("_g"))
    return both.groupBy(*keys, "_g.dimension", "_g.value").agg(F.count("*").alias("n"))


def daily_trend(opened: DataFrame, closed: DataFrame, opened_at: str, closed_at: str, start: str, end: str, keys: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """(keys..., day, new, closed) of every day from start to end, zero where nothing happened, for each of the groups' keys."""
    spark = opened.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    if keys:
        days = groups.select(*keys).dropna().distinct().crossJoin(F.broadcast(days))  # a row for each day
    per = lambda df, at, n: df.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias(n))
    out = days.join(per(opened, opened_at, "new"), [*keys, "day"], "left").join(per(closed, closed_at, "closed"), [*keys, "day"], "left")
    return out.na.fill(0, ["new", "closed"])


def worst(df: DataFrame, keys: Sequence[str], severity: str = "severity") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(severity, X.severity_rank(F.col(severity))).alias(severity))


def content_digest(rules: DataFrame, keys: Sequence[str], rule: str, *parts: str) -> DataFrame:
    """SHA-256 of rule:part:part... in the order of rule ids, joined by |. An entry a group has is collected once.

    One digest runs over all of a group, so a group's entries meet in one row: for groups of the size of a rule set or a
    project's file list.
    """
    entry = F.concat_ws(":", F.col(rule).cast("string"), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    listed = F.array_sort(F.collect_list(F.struct(F.col(rule).cast("string").alias("r"), entry.alias("e"))))
    return rules.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["e"]), "|"), 256).alias("digest"))


def languages(rules: DataFrame, keys: Sequence[str], langs: str = "langs") -> DataFrame:
    return rules.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(langs)))).alias("langs"))


def permission_catalog(permissions: DataFrame, col: str = "permission") -> DataFrame:
    """(group, permissions): the group is what stands before the colon."""
    return permissions.groupBy(F.substring_index(col, ":", 1).alias("group")).agg(F.array_sort(F.collect_set(col)).alias("permissions"))


def usage_packages(vulns: DataFrame, most: int = 200) -> DataFrame:
    """(key, tokens) per package, case-insensitive, tokens merged, at most `most` packages in key order."""
    key = X.first_text(F.col("package"), F.col("purl"))
    rows = vulns.withColumn("key", F.lower(key)).where("key is not null").withColumn("tokens", X.usage_tokens(F.col("purl"), F.col("package")))
    out = rows.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"))
    return out.orderBy("key").limit(most)


def graph_stats(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """One row: edges, their kinds, edges without a target, and nodes."""
    ends = edges.select(F.col(kind).alias("kind"), F.posexplode(F.array(source, target)).alias("end", "node"))
    return ends.agg(F.count_if(F.col("end") == 0).alias("edges"), F.count_distinct("kind").alias("kinds"), F.count_if((F.col("end") == 1) & F.col("node").isNull()).alias("unresolved"), F.count_distinct("node").alias("nodes"))


def type_stats(edges: DataFrame, child: str = "child", parent: str = "parent", kind: str = "kind") -> DataFrame:
    """One row: types named on either side, edges, and edges that implement or extend."""
    ends = edges.select(F.col(kind).alias("kind"), F.posexplode(F.array(child, parent)).alias("end", "type"))
    edge = lambda k: F.count_if((F.col("end") == 0) & (F.col("kind") == k))
    return ends.agg(F.count_distinct("type").alias("types"), F.count_if(F.col("end") == 0).alias("edges"), edge("IMPL").alias("impl_edges"), edge("EXTE").alias("exte_edges"))


def field_stats(accesses: DataFrame, field: str = "field", kind: str = "kind") -> DataFrame:
    """One row: READ and WRITE accesses, and distinct fields."""
    return accesses.agg(F.count_if(F.col(kind) == "READ").alias("reads"), F.count_if(F.col(kind) == "WRITE").alias("writes"), F.count_distinct(field).alias("fields"))


def bean_stats(beans: DataFrame, injections: DataFrame) -> DataFrame:
    """One row: beans and injections. Both are counted in one pass over their union."""
    both = beans.select(F.lit(0).alias("_k")).union(injections.select(F.lit(1)))
    return both.agg(F.count_if(F.col("_k") == 0).alias("beans"), F.count_if(F.col("_k") == 1).alias("injections"))


def points_to_stats(sets: DataFrame, truncated: str = "truncated") -> DataFrame:
    """One row: nodes with a points-to set, and sets that were cut."""
    return sets.agg(F.count("*").alias("entries"), F.count_if(truncated).alias("truncated"))


def counts(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))

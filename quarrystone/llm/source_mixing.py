r"""Mix sources to target weights by repetition rates and a hash-seeded Bernoulli copy.

Tokens are summed per source; each source's target gives its repetition rate target / size. A document is
emitted floor(rate) times, plus once more when a uniform number made from a hash of its id and text lies below the
fraction of the rate. Rows equal in both are numbered in the order of their sources and other columns, so each draws a
number of its own, the same in every run: only rows equal in every column may change places. Texts are read once, into
a narrow table of marks and sizes; documents are not shuffled to be mixed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.storage import forget, stored

#: Weights that sources take in turn, and the multiple of its own size a source may reach.
WEIGHTS, CAP = (5, 2, 1), 3
#: Sources that one task ranks, on average.
PART = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, part: int = PART) -> DataFrame:
    """sizes: (source, size) per document -> one row per source: (source, source_size, weight, target).

    Sources in code-point order, null last, take `weights` in turn and share the total of all sizes by
    weight, none above `cap` times its own size; what that cuts off is shared again by weight among the rest.
    Sources may be many (hosts): they are ranked in ranges, and a round of sharing needs only sums.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n, total = per.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    order = F.col("source").asc_nulls_last()
    dealt = stored(per.repartitionByRange(max(1, -(-n // part)), order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    within = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    counts = dealt.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n"))  # one row a range
    base = counts.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("within", within).join(base, F.col("part") == F.col("p"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("base") + F.col("within"), F.lit(len(weights)))).cast("long")
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most")), "mix-weights")
    level, over = None, F.lit(False)
    while True:  # the level that sources not yet at their cap share; it only rises
        left, free = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not free:
            break
        level, before = float(total - left) / float(free), level
        if level == before:
            break
        over = F.lit(level) * F.col("weight") > F.col("most")
    forget(per, dealt)
    target = F.when(over, F.col("most").cast("double")).otherwise(F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def uniform(doc_id: Column, mark: Column, number: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on id, text, the row's number among equal rows and the seed: 52 bits of an MD5."""
    parts = [F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(":"), mark]
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(id, mark, source, rest, ...): the text's MD5, and a hash of all other columns."""
    others = [F.to_json(c) if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c != text_col]
    return docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("mark"), F.col(source_col).alias("source"), F.xxhash64(*others).alias("rest"), *more)


def repeated(narrow: DataFrame) -> DataFrame:
    """(i, m): ids and marks that more than one row has."""
    return stored(narrow.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("i"), F.col("mark").alias("m")), "mix-again")


def numbered(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows: (id, mark, source, rest, ...) with `number` added, 0 to n - 1 among the rows of one id and mark, by source (null first), then rest.

    Only rows that have an equal are stored and numbered: within each of their partitions first, then shifted by what
    comes before, so a row that a third of all rows repeat is numbered by many tasks.
    """
    alone = rows.withColumn("number", F.lit(0).cast("long"))
    if again.isEmpty():
        return alone
    same = rows["id"].eqNullSafe(again["i"]) & (rows["mark"] == again["m"])
    equal = stored(rows.join(again, same, "left_semi").withColumn("part", F.spark_partition_id()), "mix-equal")
    key = ["id", "mark", "source", "rest", "part"]
    counts = equal.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("id", "mark").orderBy("source", "rest", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stored(counts.select(*[F.col(c).alias(f"_{c}") for c in key], before.alias("base")), "mix-bases")
    within = F.row_number().over(W.partitionBy(*key).orderBy("mark")) - 1
    on = reduce(and_, [equal[c].eqNullSafe(bases[f"_{c}"]) for c in key])
    ranked = equal.withColumn("within", within).join(bases, on).withColumn("number", F.col("base") + F.col("within"))
    return alone.join(again, same, "left_anti").unionByName(ranked.select(*rows.columns, "number"))


def decided(rows: DataFrame, targets: DataFrame, again: DataFrame, seed: str = "mix:") -> DataFrame:
    """rows: (id, mark, source, rest, ...) with (source_size, target, copies) added."""
    rows = numbered(rows, again)
    both = rows.join(targets.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.when(uniform(F.col("id"), F.col("mark"), F.col("number"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return both.withColumn("copies", (F.floor(rate) + extra).cast("long")).drop("_source", "number", "weight")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, mark, source, rest, size) of every document, stored: the one pass that counts words."""
    return stored(marked(docs, id_col, text_col, source_col, n_words(F.col(text_col)).alias("size")), "mix-sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix:", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: (row, size, source_size, target, copies); `row` is the input row as a struct.

    Defined cases: a null text has size 0; documents of a source without any word get 0 copies; null is a
    source of its own; rows with equal ids (null ids too) are decided each by its own text, and rows equal in both each
    by its own number, in the order of source and other columns, so reruns agree row by row; very long texts count whole; an
    empty table gives an empty table; further columns travel in `row`. `emit` turns copies into rows.
    """
    narrow = sized(docs, id_col, text_col, source_col)
    targets = stored(source_targets(narrow, weights, cap), "mix-targets")
    rows = marked(docs, id_col, text_col, source_col, F.struct("*").alias("row"), n_words(F.col(text_col)).alias("size"))
    return decided(rows, targets, repeated(narrow), seed).select("row", "size", "source_size", "target", "copies")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    narrow = sized(table(spark, sf_dir, "documents"))
    targets = stored(source_targets(narrow), "mix-targets")
    out = decided(narrow, targets, repeated(narrow))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with its columns as they are; the cases are those of `mix`."""
    return emit(mix(docs), docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, coalesce(text, '') ORDER BY source NULLS FIRST) - 1 AS number, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM p),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM r),
q AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM w),
c AS (SELECT *,
        CAST((SELECT sum(source_size) FROM p) - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM q),
f AS (SELECT arg_min(level, ratio) AS fit FROM c WHERE level * weight <= most),
t AS (SELECT c.source, c.source_size,
             CASE WHEN fit IS NULL OR fit * weight > most THEN CAST(most AS DOUBLE) ELSE fit * weight END AS target
      FROM c, f),
e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(d.number AS VARCHAR) || ':' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""

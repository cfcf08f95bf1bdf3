r"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, owner), one row per line key, in buckets of the 128-bit key hash, one sorted file
each, and Spark knows it as such. Documents come in batches of descending id, so the first batch that holds a key also
holds its largest document. A new batch reduces its lines to one row per key, which deals them to the same buckets, is
sorted once, and merge-anti-joins the entries of every run that are already decided (in `min_docs` documents or more:
owner and verdict cannot change any more); what is left becomes its own run on level 0. No run is shuffled or sorted
again for that. When a level has `fanout` runs they are merged into one run of the next level, so a key is rewritten
once per level and the number of runs stays logarithmic.

Only 128-bit hashes are shuffled on the way to the verdicts. Texts move once, to meet their own dropped lines.
Everything is DataFrame functions; hot keys are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACE, ascii_lower
from quarrystone.storage import forget, plain, sorted_run, stored

RUN = ["h1", "h2", "n_docs", "owner"]


def line_key(line: Column) -> Column:
    """The line without surrounding ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The levelled runs. `add` takes batches in descending order of document id."""

    def __init__(self, buckets: int, min_docs: int = 5, fanout: int = 3):
        self.buckets, self.min_docs, self.fanout, self.levels = buckets, min_docs, fanout, []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """lines: (doc, h1, h2), repeats allowed. One merge anti-join against the runs, one new run."""
        own = (
            lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("owner"))
        )
        for run in self.runs():
            decided = run.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            own = own.join(decided.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, own)

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(sorted_run(rows.select(*RUN), f"lines-l{level}", self.buckets, "h1", "h2"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, merged(old))
            forget(*old)

    def repeated(self) -> DataFrame:
        """(h1, h2, n_docs, owner) of every key in at least `min_docs` documents."""
        return merged(self.runs()).where(F.col("n_docs") >= self.min_docs)


def merged(runs: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, map(plain, runs))
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    r"""Drop repeated lines; (row, was_null, n_lines, n_dropped, kept), `row` being the input row as a struct.

    A text is split at \n. Keys (`line_key`) of at least `min_chars` code points that occur in at least
    `min_docs` documents lose all their lines except in the document with the largest id. `n_dropped` lines
    of a row's `n_lines` go; `kept` is the rest joined by \n.

    Defined cases: a null or empty text is one empty line and stays; a text that loses every line becomes
    empty, the row stays; rows with equal ids are one document, and all of them keep or lose a line
    together; rows with null ids are one document, smaller than any other; an empty table gives an empty
    table; further columns travel in `row` and cannot clash.
    """
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("was_null"))
    cuts = docs.agg(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else None
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):  # batch 0 has the largest ids
        batch = batch + F.when(F.coalesce(F.col("doc") <= F.lit(cut), F.lit(True)), 1).otherwise(0)
    line_rows = (
        src.select("doc", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"), batch.alias("batch"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "batch")
    )
    lines = stored(line_rows, "lines", "batch")  # a batch reads its own files only
    runs = LineRuns(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min_docs, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    repeated = stored(runs.repeated(), "lines-repeated")
    forget(*runs.runs())
    doc = F.col("doc")
    drops = (
        lines.join(repeated, ["h1", "h2"])
        .where(~doc.eqNullSafe(F.col("owner")))
        .groupBy("doc", "th").agg(F.collect_set("pos").alias("drop"))
    )
    whole = src.select(F.col("doc").alias("d"), F.xxhash64("text").alias("t"), "row", "was_null", F.split("text", "\n", -1).alias("lines"))
    both = whole.join(drops, whole["d"].eqNullSafe(drops["doc"]) & (whole["t"] == drops["th"]), "left")
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).when(F.size("drop") == n, F.lit("")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return both.select("row", "was_null", n.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated lines dropped; n_chars follows the text.

    Defined cases: those of `dedup_lines`; every row stays, with its columns; a null text stays null; n_chars is changed
    only where a line went.
    """
    out = dedup_lines(docs)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(~F.col("was_null"), F.col("kept")).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.line, k.pos, (r.key IS NOT NULL AND k.doc_id <> r.owner) AS dropped
  FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

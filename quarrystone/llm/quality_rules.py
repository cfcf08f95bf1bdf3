r"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

Five rules look at one ratio each and reject a document at or above a cutoff. A cutoff is chosen per rule and
stratum (language) so that, with confidence 1 - `DELTA` over all of them together, each stratum loses at most
`ALPHA` of its good documents. Of near copies among the labelled documents one counts, so that draws are independent
(texts with the least or the largest hash of their word triples in common); they are split by that hash; on one half candidate
cutoffs are rated by what they reject, on the other half they are certified with the exact binomial
(Clopper-Pearson) bound. For a rule and stratum the candidates are tested from lenient to strict and the
testing stops at the first failure, so the order needs no correction; over rules and strata the error
probability is divided (Bonferroni), and ALPHA is divided over the rules. A stratum without enough labels gets
no cutoff, so it loses nothing.

Spark counts the labelled documents into (stratum, half, label, rule, bin) and certifies each (stratum, rule)
group of the histogram, at most 4 * (BINS + 1) rows, in a task of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import stored

ALPHA, DELTA = 0.05, 0.05
#: Candidate cutoffs of a rule: k / BINS for k = 1 .. BINS.
BINS = 200

#: rule -> the ratio of a document that it looks at, from the counts of `measure`.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "bangs": ("n_bangs", "n_words"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs"]

#: What counts as a symbol, and which bytes start no new character in UTF-8.
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(0x41, 0x5B))
EVERY = bytes(range(256))


def measure(text: bytes) -> list[int]:
    """The counts of one UTF-8 text, in the order of COUNTS."""
    words = text.split()  # of bytes: exactly the six ASCII spaces
    joined = b"".join(words)
    kept = lambda chars: len(joined) - len(joined.translate(None, chars))
    return [
        len(words), len(joined.translate(None, CONTINUATION)), kept(SYMBOLS), dup_lines(text), repeat_words(words),
        text.count(b"\n") + 1, kept(CAPITALS), joined.count(b"!"),
    ]


def ends(words: list[bytes]) -> tuple[int, int]:
    """The least and the largest hash of the text's word triples (of all words together where there are fewer than three)."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if len(h) < 3:
        return (zlib.crc32(b" ".join(words)),) * 2
    t = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    t = (t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
    return int(t.min()), int(t.max())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= n:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(*[ids[i:] for i in range(n)]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    again = set()
    for w in windows:
        if w in seen:
            again.add(w)
        seen[w] = 1
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in again:
            covered[i : i + n] = b"\1" * n
    return sum(covered)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc, stratum, counts..., lo, hi) of every document; lo and hi as in `ends`. A null text has no words and one line."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(stratum_col).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    names = [*COUNTS, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*measure(t), *ends(t.split())) for t in batch.column(2).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc", "stratum", *names])

    kinds = [f"{c} {src.schema[c].dataType.simpleString()}" for c in ("doc", "stratum")]
    return src.mapInArrow(run, ", ".join(kinds + [f"{c} long" for c in names]))


def without_copies(rows: DataFrame) -> DataFrame:
    """Of rows with one `lo`, and then of those with one `hi`, the one with the smallest id."""
    for key in ("lo", "hi"):
        rows = rows.groupBy(key).agg(F.min(F.struct("doc", *[c for c in rows.columns if c not in ("doc", key)])).alias("first")).select(key, "first.*")
    return rows


def base_failed() -> Column:
    """The fixed part: fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(rule: str) -> Column:
    """The highest candidate (in 1 / BINS) at which the rule would still reject; 0 where it never would."""
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.least(F.floor(F.lit(BINS) * F.col(part) / F.col(whole)), F.lit(BINS))).otherwise(0).cast("int")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the exact test behind the Clopper-Pearson upper bound.

    It is the incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction: some dozens of steps for any n.
    """
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):  # where the fraction converges slowly its mirror image does not
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """The incomplete beta function for x up to about a / (a + b)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * value)


def certify(good: list[int], good_held: list[int], bad: list[int], alpha: float, delta: float) -> int | None:
    """The chosen cutoff, or None. Lists: documents by level 0 .. BINS (good and bad for rating, good_held for the test)."""
    n, rejected = sum(good_held), 0
    rated_good = rated_bad = 0
    best, worth = None, 0.0
    if not n:
        return None
    for cut in range(len(good_held) - 1, 0, -1):
        rejected, rated_good, rated_bad = rejected + good_held[cut], rated_good + good[cut], rated_bad + bad[cut]
        if tail(rejected, n, alpha) > delta:
            break
        value = rated_bad / max(1, sum(bad)) - 10 * rated_good / max(1, sum(good))
        if value > worth + 1e-12:
            best, worth = cut, value
    return best


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """labelled: (doc, stratum, quality, counts..., lo, hi) -> (stratum, one column per rule: the cutoff's level or null)."""
    rated = F.pmod("lo", F.lit(2)) == 0
    rows = without_copies(labelled.where(F.col("quality").isin(0, 1) & ~base_failed())).select(
        F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum"), "quality", rated.alias("rated"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("bin")) for r in RULES])).alias("x"),
    )
    hist = stored(rows.groupBy("stratum", "x.rule", "quality", "rated", "x.bin").agg(F.count("*").alias("n")), "rules-hist")
    tests = hist.select("stratum").distinct().count() * len(RULES)

    def choose(h: pd.DataFrame) -> pd.DataFrame:
        def bins(quality: int, on: bool) -> list[int]:
            out = [0] * (BINS + 1)
            for b, n in h[(h.quality == quality) & (h.rated == on)][["bin", "n"]].itertuples(index=False):
                out[b] += int(n)
            return out

        bad = [a + b for a, b in zip(bins(0, True), bins(0, False))]
        cut = certify(bins(1, True), bins(1, False), bad, alpha / len(RULES), delta / max(1, tests))
        return pd.DataFrame({"stratum": h.stratum[:1], "rule": h.rule[:1], "cut": pd.array([cut], dtype="Int64")})

    chosen = hist.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cut int")
    return stored(chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut")), "rules-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc, stratum, counts..., base_failed, rejected_by, kept) per document.

    `rejected_by` lists the rules that reject it. Defined cases: null and empty texts have no words and fail
    the base; null is a stratum of its own; labels that are null, of ids that no document has, or that
    contradict each other take no part; a document labelled twice counts once in the holdout, and so do copies; rows with
    equal ids are judged each by its own text; very long texts are read to their end; an empty table gives an empty
    table; further columns are not read.
    """
    rows = stored(measured(docs, id_col, text_col, stratum_col), "rules-counts")
    own = labels.select(F.col(id_col).alias("doc"), F.col("quality").cast("int").alias("quality")).where("doc is not null and quality is not null")
    own = own.groupBy("doc").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    cuts = cutoffs(rows.join(own, "doc"), alpha, delta).withColumnRenamed("stratum", "of")
    out = rows.join(cuts, F.coalesce(F.col("stratum").cast("string"), F.lit("")) == F.col("of"), "left")
    hit = [F.when(F.coalesce(level(r) >= F.col(r), F.lit(False)), F.lit(r)) for r in RULES]
    by = F.array_compact(F.array(*hit))
    return out.select("doc", "stratum", *COUNTS, base_failed().alias("base_failed"), by.alias("rejected_by"), (~base_failed() & (F.size(by) == 0)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

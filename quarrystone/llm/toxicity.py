r"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other). Five transducers read them. Three
rewrite: negation marks the insults and threats that follow within a few words, reported speech those in the rest of
the clause, target those that come after a person is named. Two accept: a path of the insult machine picks one
insult, a path of the threat machine one threat in a clause that names a person, before or after it, and the arc that
picks weighs the word by its marks. They are composed, rewriters first and then the union of the acceptors, into one
table built once; the weight of a clause is the sum over its accepting paths. A document's evidence is the sum over
its matched clauses, not over isolated words, and a logistic curve fitted to labelled documents turns the logarithm
of it into a score.

The insult lexicon is learned: words and word beginnings that are significantly over-represented in documents
labelled toxic, weighted by log-odds. It is fitted on a bounded sample (`PER_CLASS` labelled documents of each
class), counted by Spark; scoring reads every document whole, in Arrow batches, without a shuffle. Near copies count
once in the sample and an entry must pass Bonferroni's bound, which keeps clean documents out of the lexicon; the
price is that with a few dozen toxic labels rare insults are not learned (see the README for recall).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import id_crc, labelled_sample, labelled_texts, table
from quarrystone.storage import stored

#: Bound of the training sample: labelled documents of each class.
PER_CLASS = 5000
CUTOFF = 0.7

#: Word lists and endings (fixed values): a verb is a stem with one of the endings.
TARGETS = "you your yours yourself yourselves u ur he she they them him her his their du dich dir dein deine euch ihr ihn ihm sie tu te toi vous lui leur tú ti tu usted ustedes vosotros".split()
THREATS = "kill murder hurt destroy stab strangl shoot töt ermord umbring verletz erwürg frapp détrui étrangl golpe destru asesin".split()
THREAT_WORDS = "tuer tue tuez tuerai tuerais matar mataré mataría".split()  # stems too short for endings
NEGATIONS = "not never isn't aren't don't won't wasn't nicht kein keine keinen niemals nie pas jamais ni nunca jamás".split()
REPORTS = "said say wrote writ call quot alleg claim report sag schrieb schreib nannt behaupt dit écri déclar affirm dijo dice escrib llam afirm".split()
ENDINGS = "e s es ed d ing er ers en n t st te ten et é ée és ées er ez ent ait ant re it ar aron ó o a as an aba ado ada ando ir ir en ió iendo".split()
#: What a threat weighs, and what each mark does to a weight.
THREAT_WEIGHT, NEGATED_GAIN, REPORTED_GAIN, DIRECTED_GAIN = 2.0, 0.4, 0.6, 1.25

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[^.,;:!?\n|()\[\]{}\"“”«»]+")

KINDS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATED, REPORTED, DIRECTED = 8, 16, 32  # marks that are added to a kind


def beginnings(word: str) -> list[str]:
    """What may stand for a word in the lexicon: the word itself (marked by a final $) and its beginnings."""
    return [word + "$", *(word[:k] for k in (4, 5, 6) if len(word) > k)] if len(word) > 2 else []


def forms(stems: list[str]) -> set[str]:
    """The stems with and without each ending."""
    return {stem + end for stem in stems for end in ["", *ENDINGS]}


@dataclass(frozen=True)
class Transducer:
    """arcs(state, symbol) gives (next state, output, weight, whether the word's own weight counts too)."""

    start: object
    arcs: Callable[[object, int], list[tuple[object, int, float, bool]]]
    final: Callable[[object], float]


def rewriter(mark: int, after: Callable[[int, int], int]) -> Transducer:
    """Marks insults and threats read in any state but 0; `after` gives the next state."""

    def arcs(state, symbol):
        marked = symbol | mark if state and symbol % 8 in (INSULT, THREAT) else symbol
        return [(after(state, symbol % 8), marked, 1.0, False)]

    return Transducer(0, arcs, lambda state: 1.0)


def gain(symbol: int) -> float:
    return math.prod(g for mark, g in ((NEGATED, NEGATED_GAIN), (REPORTED, REPORTED_GAIN), (DIRECTED, DIRECTED_GAIN)) if symbol & mark)


def insult_arcs(state: int, symbol: int) -> list[tuple[int, int, float, bool]]:
    """State 1: an insult is picked."""
    return [(state, symbol, 1.0, False)] + [(1, symbol, gain(symbol), True)] * (state == 0 and symbol % 8 == INSULT)


def threat_arcs(state: int, symbol: int) -> list[tuple[int, int, float, bool]]:
    """State 1: a threat is picked and a person still to be named; state 2: both are there."""
    stay = 2 if state == 1 and symbol % 8 == TARGET else state
    pick = [(2 if symbol & DIRECTED else 1, symbol, gain(symbol), True)] if state == 0 and symbol % 8 == THREAT else []
    return [(stay, symbol, 1.0, False), *pick]


NEGATION_SCOPE = rewriter(NEGATED, lambda state, kind: 3 if kind == NEGATION else max(0, state - 1))
REPORTED_SPEECH = rewriter(REPORTED, lambda state, kind: 1 if state or kind == REPORT else 0)
NAMED_TARGET = rewriter(DIRECTED, lambda state, kind: 1 if state or kind == TARGET else 0)
INSULTS = Transducer(0, insult_arcs, lambda state: float(state == 1))
THREATENED = Transducer(0, threat_arcs, lambda state: float(state == 2))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; weights multiply."""

    def arcs(state, symbol):
        return [((x, y), out, v * w, p or q) for x, mid, v, p in a.arcs(state[0], symbol) for y, out, w, q in b.arcs(state[1], mid)]

    return Transducer((a.start, b.start), arcs, lambda state: a.final(state[0]) * b.final(state[1]))


def union(a: Transducer, b: Transducer) -> Transducer:
    """The paths of either; the state says whose, none before the first word."""

    def arcs(state, symbol):
        own = [(0, a, a.start), (1, b, b.start)] if state is None else [(state[0], (a, b)[state[0]], state[1])]
        return [((k, x), out, w, p) for k, m, s in own for x, out, w, p in m.arcs(s, symbol)]

    return Transducer(None, arcs, lambda state: 0.0 if state is None else (a, b)[state[0]].final(state[1]))


def tabled(machine: Transducer) -> tuple[list[list[list[tuple[int, float, bool]]]], list[float]]:
    """Reachable states by number: arcs of (state, kind), and final weights. State 0 is the start."""
    number, todo, arcs, final = {machine.start: 0}, [machine.start], [], []
    for state in todo:  # grows while it is read
        final.append(machine.final(state))
        rows = []
        for kind in KINDS:
            row = []
            for nxt, _, w, own in machine.arcs(state, kind):
                if nxt not in number:
                    number[nxt] = len(todo)
                    todo.append(nxt)
                row.append((number[nxt], w, own))
            rows.append(row)
        arcs.append(rows)
    return arcs, final


GRAMMAR, FINAL = tabled(compose(compose(compose(NEGATION_SCOPE, REPORTED_SPEECH), NAMED_TARGET), union(INSULTS, THREATENED)))
CLASSES = dict.fromkeys(forms(REPORTS), REPORT) | dict.fromkeys([*forms(THREATS), *THREAT_WORDS], THREAT) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET)


def clause_weight(read: list[tuple[int, float]]) -> float:
    """The sum over the grammar's accepting paths; read: (kind, the word's own weight)."""
    paths = {0: 1.0}
    for kind, own in read:
        ahead: dict[int, float] = {}
        for state, weight in paths.items():
            for nxt, w, counts in GRAMMAR[state][kind]:
                ahead[nxt] = ahead.get(nxt, 0.0) + weight * w * (own if counts else 1.0)
        paths = ahead
    return sum(weight * FINAL[state] for state, weight in paths.items())


class Lexicon:
    """The learned insult weights, with the quick test that skips texts and clauses without any match."""

    def __init__(self, insult: dict[str, float]):
        self.insult = insult
        self.heads = {k[:3] for k in insult} | {w[:3] for w, kind in CLASSES.items() if kind == THREAT}

    def read(self, word: str) -> tuple[int, float]:
        """(kind, own weight) of a word; a learned insult comes before the lists."""
        weight = max((self.insult[b] for b in beginnings(word) if b in self.insult), default=0.0)
        kind = INSULT if weight else CLASSES.get(word, OTHER)
        return kind, weight if weight else THREAT_WEIGHT * (kind == THREAT)

    def evidence(self, text: str) -> float:
        low, heads = text.lower(), self.heads
        hot = {w for w in set(WORD.findall(low)) if w[:3] in heads}
        hot = {w for w in hot if self.read(w)[0] in (INSULT, THREAT)}
        if not hot:
            return 0.0
        total = 0.0
        for clause in CLAUSE.findall(low):
            words = WORD.findall(clause)
            if not hot.isdisjoint(words):
                total += clause_weight([self.read(w) for w in words])
        return total


def count_beginnings(sample: DataFrame) -> DataFrame:
    """(item, toxic, clean): documents of either label with the word or beginning. Counted per batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b["y"], b["text"]):
                counts[int(y == 1)].update({x for w in set(WORD.findall(text.lower())) for x in beginnings(w)})
            items = list(set(counts[0]) | set(counts[1]))
            yield pd.DataFrame({"item": items, "toxic": [counts[1][i] for i in items], "clean": [counts[0][i] for i in items]})

    return sample.select("y", "text").mapInPandas(run, "item string, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def without_copies(sample: DataFrame) -> DataFrame:
    """The sampled texts without near copies of each other: a large group of copies would make every word of its text
    look like a sign of its label. Texts that share the least or the largest hash of their word triples count once."""

    def ends(text: str) -> tuple[int, int]:
        w = text.lower().encode().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) >> 1 for i in range(max(1, len(w) - 2))]
        return min(hashes), max(hashes)

    sketch = F.pandas_udf(lambda s: pd.DataFrame([ends(t) for t in s], columns=["lo", "hi"]), "lo long, hi long")
    rows = stored(sample.withColumn("s", sketch("text")), "toxic-sample")
    once = rows.groupBy("s.lo").agg(F.min(F.struct("id", "s.hi")).alias("m")).groupBy("m.hi").agg(F.min("m.id").alias("id")).select("id")
    return rows.join(F.broadcast(once), "id", "left_semi").select("id", "y", "text")  # ids of a bounded sample


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Lexicon, float, float]:
    """Lexicon and the logistic curve (slope, intercept). Without labels of both classes: no lexicon, scores low.

    Null labels, null ids and ids labelled both ways take no part, near copies in the sample count once.
    """
    sample = without_copies(labelled_texts(docs, labelled_sample(labels, "toxic", train, per_class, id_col), id_col, text_col))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(4)) == 0  # a quarter is left to fit the curve on
    n = {r["y"]: r["n"] for r in sample.where(~fold).groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean_n, toxic_n = n.get(0, 0), n.get(1, 0)
    if not clean_n or not toxic_n:
        return Lexicon({}), 1.0, -3.0
    counts = stored(count_beginnings(sample.where(~fold)), "toxic-words")
    odds = F.log(((F.col("toxic") + 0.5) / (toxic_n + 1)) / ((F.col("clean") + 0.5) / (clean_n + 1)))
    # how unlikely so many toxic documents are among those with the word, by the Chernoff bound of the binomial tail
    n, rate = F.col("toxic") + F.col("clean"), toxic_n / (toxic_n + clean_n)
    share = F.col("toxic") / n
    unlikely = n * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    found = (
        counts.where(F.col("toxic") >= 3).select("item", "toxic", odds.alias("odds"), unlikely.alias("unlikely"))
        .where((F.col("odds") >= 3.0) & (F.col("unlikely") >= math.log(2 * max(1, counts.count()))))  # Bonferroni: half a false entry expected
    )
    lexicon = Lexicon({r["item"]: float(r["odds"]) for r in found.collect()})
    evidence = F.pandas_udf(lambda s: s.map(lexicon.evidence), "double")
    bins = sample.where(fold).select("y", F.floor(F.log1p(evidence("text")) * 8).alias("bin")).groupBy("y", "bin").agg(F.count("*").alias("n")).collect()
    # each class weighs as much as it has labels in all, so the curve knows how rare toxic documents are
    labelled = {r["y"]: r["n"] for r in labels.where(train & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    of = {c: max(1, sum(r["n"] for r in bins if r["y"] == c)) * sum(labelled.values()) / max(1, labelled.get(c, 0)) for c in (0, 1)}
    x = np.array([r["bin"] / 8 for r in bins], dtype=float)
    y = np.array([r["y"] for r in bins], dtype=float)
    w = np.array([r["n"] / of[r["y"]] for r in bins], dtype=float)
    return lexicon, *logistic(x, y, w)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton steps; the slope is kept above zero."""
    a, b = 0.5, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([np.sum(w * (p - y) * x) + ridge * a, np.sum(w * (p - y)) + ridge * b])
        v = w * p * (1 - p)
        h = np.array([[np.sum(v * x * x) + ridge, np.sum(v * x)], [np.sum(v * x), np.sum(v) + ridge]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1.0, 2.0 / size) if size else 1.0
        a, b = a - step[0], b - step[1]
        if size < 1e-9:
            break
    return max(a, 0.05), b


def score(text: Column, model: tuple[Lexicon, float, float]) -> Column:
    """Toxicity of a text, 0 to 1, of each row by its own text.

    Null and empty texts have no evidence and get the curve's lowest value; very long texts are read to their end; equal
    texts, repeated rows among them, get equal scores; an empty table has no score.
    """
    lexicon, a, b = model

    def run(s: pd.Series) -> pd.Series:
        x = np.log1p(s.map(lexicon.evidence).to_numpy(dtype=float))
        return pd.Series(1 / (1 + np.exp(-(a * x + b))))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), fit(docs, labels, ~held_out(F.col("doc_id")))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected as toxic, rows and columns as they are.

    Defined cases: null and empty texts stay; rows with equal ids are judged each by its own text; a document at the
    cutoff goes; without labels of both classes all stay; an empty table gives an empty table; further columns travel along.
    """
    labels = table(spark, sf_dir, "labels")
    return docs.where(score(F.col("text"), fit(docs, labels, ~held_out(F.col("doc_id")))) < CUTOFF)

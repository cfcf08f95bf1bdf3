"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, and overlapping chunks that cover the whole text are convolved with learned
filters and max-pooled: a chunk becomes one number per filter. Over the chunks of a document their mean and
their maximum go through a small hidden layer into one probability. Varied prose sets off most filters
somewhere in a chunk; padding, symbol runs and repeated words set off few, or others.

Training is plain stochastic gradient descent on the driver over a bounded sample (`PER_CLASS` labelled
documents of each class, every chunk of each), so its cost does not grow with the corpus. Scoring runs in Arrow
batches over every chunk of every document; a text's score depends on its own bytes only, not on what shares its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import id_crc, labelled_sample, labelled_texts, table

#: Bound of the training sample: labelled documents of a class.
PER_CLASS = 1000
#: Bytes of a chunk, its overlap with the next, the filter's width and stride, numbers of a byte, filters and hidden units.
CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 16, 8, 2, 6, 24, 16
#: Epochs and, for small samples, steps at least; documents of a step; first step size.
EPOCHS, STEPS, BATCH, RATE = 8, 300, 32, 0.004
CUTOFF = 0.3
#: Chunks that are convolved in one go, counted from the start of a text: bounds memory for very long texts.
AT_ONCE = 256

POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunked(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text, zero-padded; one chunk of zeros for an empty text."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    data = np.zeros(step * (n - 1) + CHUNK, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::step]


class Net:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    NAMES = ("embed", "filters", "bias", "w1", "b1", "w2", "b2")

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks * positions, WIDTH * EMBED): what each filter sees."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        v = np.lib.stride_tricks.as_strided(e, (len(chunks), POSITIONS, WIDTH * EMBED), (e.strides[0], STRIDE * EMBED * e.itemsize, e.itemsize))
        return np.ascontiguousarray(v).reshape(-1, WIDTH * EMBED)

    def convolved(self, chunks: np.ndarray) -> np.ndarray:
        """(FILTERS, chunks, positions)."""
        return (self.filters.T @ self.windows(chunks).T).reshape(FILTERS, len(chunks), POSITIONS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS) after ReLU and max-pooling over positions."""
        return np.maximum(self.convolved(chunks).max(axis=2).T + self.bias, 0)

    def probability(self, text: bytes) -> float:
        chunks = chunked(text)
        total, most = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
        for i in range(0, len(chunks), AT_ONCE):
            p = self.pooled(chunks[i : i + AT_ONCE])
            total += p.sum(axis=0)
            most = np.maximum(most, p.max(axis=0))
        x = np.concatenate([(total / len(chunks)).astype(np.float32), most])
        return float(sigmoid(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]))

    def gradients(self, chunks: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss over documents; `sizes` chunks belong to each document in turn."""
        n = len(chunks)
        where, p = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), self.filters.dtype)
        for i in range(0, n, AT_ONCE):
            part = chunks[i : i + AT_ONCE]
            c = self.convolved(part)
            where[i : i + AT_ONCE] = c.argmax(axis=2).T
            p[i : i + AT_ONCE] = np.maximum(c.max(axis=2).T + self.bias, 0)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        mean = np.add.reduceat(p, starts, axis=0) / sizes[:, None]
        most = np.maximum.reduceat(p, starts, axis=0)
        x = np.concatenate([mean, most], axis=1).astype(np.float32)
        h = np.maximum(x @ self.w1 + self.b1, 0)
        d = (weight * (sigmoid(h @ self.w2 + self.b2[0]) - y) / len(y)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": np.array([d.sum()], np.float32)}
        dh = np.outer(d, self.w2) * (h > 0)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ self.w1.T
        dp = (dx[:, :FILTERS] / sizes[:, None].astype(np.float32))[doc] + dx[:, FILTERS:][doc] * (p == most[doc])
        dp = dp * (p > 0)
        g["bias"] = dp.sum(axis=0)
        g["filters"], back = np.zeros_like(self.filters), np.zeros((256, EMBED), np.float32)
        for i in range(0, n, AT_ONCE):
            part, at, dq = chunks[i : i + AT_ONCE], where[i : i + AT_ONCE], dp[i : i + AT_ONCE]
            v, row = self.windows(part), np.arange(len(part))
            for f in range(FILTERS):
                used = row[dq[:, f] != 0]  # most chunks do not set off most filters
                if len(used):
                    g["filters"][:, f] += v[POSITIONS * used + at[used, f]].T @ dq[used, f]
                    into = np.outer(dq[used, f], self.filters[:, f]).reshape(-1, EMBED)
                    np.add.at(back, part[used[:, None], STRIDE * at[used, f][:, None] + np.arange(WIDTH)].ravel(), into)
        back[0] = 0
        g["embed"] = back
        return g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(parts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam over shuffled batches of documents, both classes of one weight; `parts` has the chunks of each."""
    net, rng = Net(seed), np.random.default_rng(seed)
    mean = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}
    square = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}
    share = y.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    step, epochs = 0, max(epochs, -(-STEPS * BATCH // len(parts)))
    for epoch in range(epochs):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            sizes = np.array([len(parts[k]) for k in pick])
            g = net.gradients(np.concatenate([parts[k] for k in pick]), sizes, y[pick], weight[pick])
            step += 1
            for n in Net.NAMES:
                mean[n] = 0.9 * mean[n] + 0.1 * g[n]
                square[n] = 0.99 * square[n] + 0.01 * g[n] ** 2
                move = RATE * (1 - 0.7 * epoch / epochs) * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-7)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """The network for the labelled sample, or None where a class has no example.

    Null labels, null ids and ids labelled both ways take no part; of rows with one id each text is an example; an
    empty table has none; further columns are not read. The sample's whole texts come to the driver, which trains on them.
    """
    sample = labelled_texts(docs, labelled_sample(labels, "quality", train_rows, per_class, id_col), id_col, text_col)
    got = sorted(sample.select("id", "y", F.col("text").cast("binary").alias("text")).distinct().collect())
    y = np.array([r["y"] for r in got], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return train([chunked(bytes(r["text"])) for r in got], y)


def score(text: Column, net: Net | None) -> Column:
    """Probability of label 1, of each row by its own text.

    Null and empty texts are one chunk of zeros; very long texts are read to their end; equal texts, repeated rows among
    them, get equal scores; an empty table has no score. Without a network: 0.5.
    """
    if net is None:
        return F.lit(0.5)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([net.probability(bytes(t)) for t in s], dtype=float)

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), fit(docs, labels, ~held_out(F.col("doc_id")))).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))

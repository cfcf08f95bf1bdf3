"""Nearest neighbours by collision counting over single-projection sorted arrays.

Largest inner product becomes smallest distance by one more coordinate: a row x goes to (x / M,
sqrt(1 - |x|^2 / M^2)), M being the largest norm, a query q to (q / |q|, 0). Rows are indexed by `PROJECTIONS`
random projections, each a sorted array. A query opens a window around its own value in every array, and a row
that lies in `SHARE` of the windows or more collides often enough to be verified. Virtual rehashing widens all
windows together, from a width set by the k-th distance among `SAMPLE` rows, until the k-th best verified row is
nearer than the distance up to which rows pass the threshold with the wanted probability. Windows that take in
everything verify everything, so the search ends exact where nothing stops it before. Nothing is capped.

Verifying is exact: single precision sets aside rows that cannot be among the k best by more than its own error
bound, the others are scored in double precision, products added from the first coordinate to the last, so equal
vectors get equal scores. Lengths are scaled by logarithms, so tiny and huge components neither vanish nor overflow.

Collisions of a (query, row) pair must be counted together, and without structure in the vectors nearly half of all
pairs collide in each array; sending collisions through a shuffle would move them `PROJECTIONS` times over. So the
query set meets the rows in large blocks: a row block of `ROW_VALUES` numbers is indexed once for every
`QUERY_VALUES` numbers of queries, each such cell is a task of bounded memory, and the k best of each cell are
merged per query. Rows are sent (queries / query block) times and queries (rows / row block) times.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, PROJECTIONS = 20, 128
#: Share of projections that must collide, the factor of virtual rehashing, and the rows that set the first width.
SHARE, GROWTH, SAMPLE = 0.55, 1.2, 512
#: Standard deviations of safety: a row at the stopping distance passes the threshold with about 90 %, nearer ones more surely.
SAFETY = 1.3
#: Numbers of a row block and of a query block, rows of a block at most, and cells below which queries are dealt finer.
ROW_VALUES, QUERY_VALUES, MOST_ROWS, CELLS = 1 << 21, 1 << 22, 60_000, 16
#: Rows whose collisions are counted at a time, and the part of all ranks from which they are counted in place.
TILE, WIDE = 8192, 1 / 24
#: ln of the scores beyond which products may vanish or overflow; such queries verify every row.
FRAGILE = 650.0

NORMAL = NormalDist()


def directions(dim: int, count: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """(dim, count) random directions, orthogonal in groups, scaled so that a difference of length 1 projects to about N(0, 1)."""
    r = np.random.default_rng([seed, dim])
    groups = [np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(-(-count // dim))]
    return (np.concatenate(groups, axis=1)[:, :count] * np.sqrt(dim)).astype(np.float32)


def reach(count: int = PROJECTIONS, share: float = SHARE, safety: float = SAFETY) -> float:
    """The distance, for windows of half-width 1, up to which rows collide in `share` of the windows with `safety`."""
    p = share + safety * np.sqrt(share * (1 - share) / count)
    return 1 / NORMAL.inv_cdf((1 + min(p, 0.999)) / 2)


def log_norms(x: np.ndarray) -> np.ndarray:
    """ln of the length of each row; no row is zero. The largest component is taken out first."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return np.log(top[:, 0]) + 0.5 * np.log(((x / top) ** 2).sum(axis=1))


def scaled(x: np.ndarray, log_length: float | np.ndarray) -> np.ndarray:
    """x / exp(log_length), in two steps so that neither overflows."""
    half = np.exp(-0.5 * np.asarray(log_length))
    return x * half * half


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the coordinates."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return np.cumsum(x * q, axis=1)[:, -1]


class Block:
    """The index over one block of rows."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, x: np.ndarray, log_largest: float):
        self.ids, self.marks, self.x, self.log_largest = ids, marks, x, log_largest
        y = scaled(x, log_largest)
        lift = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))
        self.y = y.astype(np.float32)
        self.a = directions(x.shape[1] + 1)
        values = np.ascontiguousarray((np.column_stack([self.y, lift.astype(np.float32)]) @ self.a).T)
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        rank = np.empty(values.shape, np.uint16)
        np.put_along_axis(rank, self.order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.tiles = [np.ascontiguousarray(rank[:, i : i + TILE]) for i in range(0, len(ids), TILE)]
        self.sample = self.y[:: max(1, len(ids) // SAMPLE)]
        self.error = (x.shape[1] + 8) * 2.4e-7  # of a single-precision score and of its rival

    def windows(self, values: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, projections): where each window begins and ends in each sorted array."""
        low = np.stack([np.searchsorted(s, values[:, j] - width, "left") for j, s in enumerate(self.sorted)], axis=1)
        high = np.stack([np.searchsorted(s, values[:, j] + width, "right") for j, s in enumerate(self.sorted)], axis=1)
        return low, high

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each row, in how many windows it lies: along the sorted arrays where windows are narrow, by rank where they are wide."""
        n = len(self.ids)
        if int((high - low).sum()) < WIDE * n * len(low):
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist())]), minlength=n)
        first, size = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        # in unsigned numbers a rank below the window is a large one, so one comparison does for both ends
        return np.concatenate([np.add.reduce((t - first) < size, axis=0, dtype=np.uint16) for t in self.tiles])

    def search(self, queries: np.ndarray, own: np.ndarray, marks: np.ndarray, k: int = K) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(row positions, scores) of each query's k best, best first, ties to the smaller id. The query's own row is left out."""
        n, need, unit_reach = len(self.ids), max(1, int(np.ceil(SHARE * len(self.order)))), reach()
        lengths = log_norms(queries)
        unit = scaled(queries, lengths[:, None]).astype(np.float32)
        values = np.column_stack([unit, np.zeros(len(unit), np.float32)]) @ self.a
        at = [np.empty(0, np.int64) for _ in queries]
        rough = [np.empty(0, np.float32) for _ in queries]
        seen: list[np.ndarray | None] = [None] * len(queries)
        # the share of the sample that would hold k rows gives the first width
        near = np.sort(unit @ self.sample.T, axis=1)[:, ::-1]
        guess = near[:, min(near.shape[1], int(np.ceil((k + 1) * near.shape[1] / n))) - 1]
        width = np.maximum(0.05, 0.9 * np.sqrt(np.maximum(0, 2 - 2 * guess)) / unit_reach)
        fragile = np.abs(lengths + self.log_largest) > FRAGILE
        for i in np.flatnonzero(fragile):
            at[i] = np.flatnonzero((self.ids != own[i]) | (self.marks != marks[i]))
        active = np.flatnonzero(~fragile)
        while len(active):
            low, high = self.windows(values[active], width[active])
            still = []
            for i, lo, hi in zip(active.tolist(), low, high):
                hit = self.collisions(lo, hi) >= need
                new = np.flatnonzero(hit if seen[i] is None else hit & ~seen[i])
                seen[i] = hit if seen[i] is None else hit | seen[i]
                if len(new):
                    new = new[(self.ids[new] != own[i]) | (self.marks[new] != marks[i])]
                    at[i], rough[i] = np.concatenate([at[i], new]), np.concatenate([rough[i], self.y[new] @ unit[i]])
                kth = -np.inf
                if len(at[i]) > k:
                    kth = float(np.partition(rough[i], len(rough[i]) - k)[-k])
                    keep = rough[i] >= kth - self.error
                    at[i], rough[i] = at[i][keep], rough[i][keep]
                elif len(at[i]) == k:
                    kth = float(rough[i].min())
                wanted = np.sqrt(max(0.0, 2 - 2 * kth)) / unit_reach if kth > -np.inf else np.inf
                if width[i] < wanted and not (lo.max() == 0 and hi.min() == n):
                    width[i] = min(width[i] * GROWTH, max(wanted, width[i] * 1.02))
                    still.append(i)
            active = np.array(still, dtype=np.int64)
        scores = []
        for i, q in enumerate(queries):
            s = exact_scores(self.x[at[i]], q)
            best = np.lexsort((self.ids[at[i]], -s))[:k]
            at[i] = at[i][best]
            scores.append(s[best])
        return at, scores


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, mark, v, dim, log_norm), a row for each id and vector; no null, empty, zero or non-finite vector. `mark` is the vector's hash."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & fine).dropDuplicates(["id", "v"]).withColumn("top", F.array_max(F.transform(v, F.abs)))
    log_norm = F.log("top") + 0.5 * F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))
    return rows.select("id", F.xxhash64("v").alias("mark"), "v", F.size("v").alias("dim"), log_norm.alias("log_norm"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, nor do
    null ids; rows equal in id and vector count once, and rows of one id with different vectors are rows of their
    own, each a candidate and, where the id is asked for, a query; vectors of different lengths never meet; fewer
    candidates than k are all returned; ties in score go to the smaller id; products that leave the range of a
    double are scored as double arithmetic gives them; an empty table gives an empty table; further columns are not read.
    """
    from quarrystone.storage import stored

    rows = stored(usable(vectors, id_col, vector_col), "ann-vectors")
    query = F.pmod(F.col("id"), F.lit(every)) == 0
    size = stored(rows.groupBy("dim").agg(F.max("log_norm").alias("largest"), F.count("*").alias("n"), F.count_if(query).alias("q")), "ann-sizes")
    # a row for each vector length; lengths differ only where tables are mixed
    rbs = F.ceil(F.col("n") / F.least(F.ceil(F.lit(ROW_VALUES) / F.col("dim")), F.lit(MOST_ROWS)))
    finer = F.least(F.ceil(F.lit(CELLS) / F.col("rbs")), F.ceil(F.col("q") / 64))
    blocks = size.withColumn("rbs", rbs).select(
        F.col("dim").alias("d"), "largest", "rbs", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("dim") / QUERY_VALUES), finer).alias("qbs")
    )
    rows = rows.join(blocks, rows["dim"] == blocks["d"])
    part = lambda total: F.pmod(F.xxhash64("id", "mark"), total)
    upto = lambda total: F.explode(F.sequence(F.lit(0).cast("long"), total - 1))
    base = rows.select("dim", part(F.col("rbs")).alias("rb"), upto(F.col("qbs")).alias("qb"), "largest", "id", "mark", "v")
    asked = rows.where(query).select(F.col("dim").alias("qdim"), upto(F.col("rbs")).alias("qrb"), part(F.col("qbs")).alias("qqb"), F.col("id").alias("qid"), F.col("mark").alias("qmark"), F.col("v").alias("qv"))
    names = ["query_id", "query_mark", "vec_id", "score"]

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        flat = t.column(name).combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if x.num_rows and q.num_rows:
            block = Block(x.column("id").to_numpy(), x.column("mark").to_numpy(), matrix(x, "v"), x.column("largest")[0].as_py())
            ids, marks, vs = q.column("qid").to_numpy(), q.column("qmark").to_numpy(), matrix(q, "qv")
            for i in range(0, len(ids), 64):
                own, mark = ids[i : i + 64], marks[i : i + 64]
                for qid, m, at, s in zip(own, mark, *block.search(vs[i : i + 64], own, mark, k)):
                    for column, more in zip(out, (np.full(len(at), qid), np.full(len(at), m), block.ids[at], s)):
                        column.append(more)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

    near = base.groupBy("dim", "rb", "qb").cogroup(asked.groupBy("qdim", "qrb", "qqb")).applyInArrow(cell, "query_id long, query_mark long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from quarrystone.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"))

"""Connected components of an undirected edge table by alternating star contraction.

Each round relinks every node to the smallest node of its neighbourhood: first from the node to its
larger neighbours, then from the node to its smaller ones. Rounds grow with the logarithm of the
component size, and each is two aggregations and two joins. Minima are stored before they are joined
back, and not broadcast, as that would send them through the driver each round; a hub's rows are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.storage import dealt, forget, stored


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()


def connected_components(edges: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """(keys..., node, component): component is the smallest node reachable; isolated nodes have no row.

    `keys` names graph-id columns: components never cross them. Null ends and self-loops are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    e = edges.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(a).alias("x"), F.col(b).alias("y"))
    e = e.where("x is not null and y is not null and x <> y")
    e = e.select(*names, F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    edge = stored(e, "cc-edges")
    before = _signature(edge)
    on = lambda l, r: [l[c].eqNullSafe(r[c]) for c in names]
    while before[0]:
        both = edge.select(*names, "a", "b").union(edge.select(*names, F.col("b"), F.col("a")))
        both = both.toDF(*names, "u", "v")
        least = stored(both.groupBy(*names, "u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-min")
        large = (
            both.alias("l").join(dealt(least.alias("r")), [*on(both, least), both["u"] == least["u"]])
            .where(both["v"] > both["u"])
            .select(*[both[n] for n in names], both["v"].alias("a"), least["m"].alias("b"))
            .where("a <> b").distinct()
        )
        mid = stored(large, "cc-large")
        least2 = stored(mid.groupBy(*names, "a").agg(F.min("b").alias("m")), "cc-min")
        linked = mid.join(dealt(least2), [*on(mid, least2), mid["a"] == least2["a"]]).select(
            *[mid[n] for n in names], mid["b"].alias("a"), least2["m"].alias("b")
        )
        small = linked.where("a <> b").union(least2.select(*names, "a", F.col("m").alias("b"))).distinct()
        new = stored(small, "cc-edges")
        after = _signature(new)
        for t in (least, mid, least2, edge):
            forget(t)
        edge = new
        if after == before:
            break
        before = after
    nodes = edge.select(*names, F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edge.select(*names, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = nodes.union(roots)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "node", "component")

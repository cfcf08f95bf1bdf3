"""Graph jobs as loops of DataFrame joins.

A graph is an edge table (keys..., source, target); `keys` name columns that keep graphs apart, so all graphs
of a table are worked on at once. Each round joins a frontier with the edges and is written to the shared
folder, which cuts the lineage. Caps are applied per key and per round, in the order of node ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators.components import connected_components
from quarrystone.operators.relational import all_pairs, consecutive, first_n
from quarrystone.storage import Gathered, dealt, forget, stored


def known_edges(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges whose two ends are nodes, without repeats."""
    ends = lambda c: nodes.select(*keys, F.col("node").alias(c)).distinct()
    return edges.select(*keys, "source", "target").distinct().join(dealt(ends("source")), [*keys, "source"], "left_semi").join(dealt(ends("target")), [*keys, "target"], "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, n_in, n_out)."""
    on = [*keys, "node"]
    one = lambda node, n_in, n_out: F.struct(node.alias("node"), F.lit(n_in).cast("long").alias("n_in"), F.lit(n_out).cast("long").alias("n_out"), F.lit(False).alias("_own"))
    ends = edges.select(*keys, F.inline(F.array(one(F.col("target"), 1, 0), one(F.col("source"), 0, 1))))
    ends = ends.where(" and ".join(f"`{c}` is not null" for c in on))
    own = nodes.select(*on, F.lit(0).cast("long").alias("n_in"), F.lit(0).cast("long").alias("n_out"), F.lit(True).alias("_own"))
    return own.unionByName(ends).groupBy(*on).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"), F.bool_or("_own").alias("_own")).where("_own").drop("_own")


def roots(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, n_out): nodes nothing points to, or every node of a graph that has none."""
    deg = degrees(nodes, edges, keys)
    best = deg.groupBy(*keys).agg(F.min("n_in").alias("_least"))
    deg = deg.join(best, list(keys)) if keys else deg.crossJoin(F.broadcast(best))  # one row
    return deg.where((F.col("n_in") == 0) | (F.col("_least") > 0)).select(*keys, "node", "n_out")


def neighbours(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, other, direction): what each node depends on and what depends on it."""
    down = edges.select(*keys, F.col("source").alias("node"), F.col("target").alias("other"), F.lit("dependency").alias("direction"))
    up = edges.select(*keys, F.col("target").alias("node"), F.col("source").alias("other"), F.lit("dependent").alias("direction"))
    return down.union(up).distinct()


def subtree_worst(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), severity: str = "severity") -> DataFrame:
    """(keys..., node, rank): the worst severity rank of a node and all below it; cycles share their maximum.

    Semi-naive: a round sends on only the ranks that rose, against the edges.
    """
    on = [*keys, "node"]
    delta = stored(nodes.groupBy(*on).agg(F.max(X.severity_rank(F.col(severity))).alias("rank")), "worst")
    known, edge = Gathered(delta, *on, "rank", own=True), stored(edges.select(*keys, "source", "target").distinct(), "worst-edges")
    while not delta.isEmpty():
        sent = delta.withColumnRenamed("node", "target").join(edge, [*keys, "target"])
        best = sent.groupBy(*keys, F.col("source").alias("node")).agg(F.max("rank").alias("_new"))
        # a node's ranks of earlier rounds: the largest holds
        had = known.rows().join(best, on).groupBy(*on).agg(F.max("rank").alias("rank"), F.max("_new").alias("_new"))
        delta = stored(had.where(F.col("_new") > F.col("rank")).select(*on, F.col("_new").alias("rank")), "worst-delta")
        known.add(delta)
    state = stored(known.rows().groupBy(*on).agg(F.max("rank").alias("rank")), "worst")
    known.forget()
    forget(edge)
    return state


def reachable(edges: DataFrame, starts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """starts: (keys..., start, node). (keys..., start, node, depth): breadth-first from each start along the edges."""
    on = [*keys, "start", "node"]
    front = stored(starts.select(*on).distinct().withColumn("depth", F.lit(0)), "reach")
    seen, edge = Gathered(front, *on, "depth", own=True), stored(edges.select(*keys, F.col("source").alias("node"), F.col("target").alias("_to")).distinct(), "reach-edges")
    for depth in count(1):
        step = front.join(dealt(edge), [*keys, "node"]).select(*keys, "start", F.col("_to").alias("node")).distinct()
        front = stored(step.join(dealt(seen.rows()), on, "left_anti").withColumn("depth", F.lit(depth)), "reach-step")
        if front.isEmpty():
            break
        seen.add(front)
    forget(front, edge)
    return seen.rows()


def closure(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, ancestor): everything above a node along source -> target, without the node itself."""
    starts = edges.select(*keys, F.col("source").alias("start"), F.col("source").alias("node"))
    return reachable(edges, starts, keys).where("depth > 0 and start <> node").select(*keys, F.col("start").alias("node"), F.col("node").alias("ancestor"))


def related_types(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """edges: (source, target, kind), a type and one it extends or implements. (type, other, relation, kind): its parents and children, of one kind or of all."""
    e = edges.where(F.col("kind") == kind) if kind else edges
    e = e.where((F.trim("source") != "") & (F.trim("target") != "")).select("source", "target", "kind").distinct()
    up = e.select(F.col("source").alias("type"), F.col("target").alias("other"), F.lit("parent").alias("relation"), "kind")
    return up.union(e.select("target", "source", F.lit("child"), "kind"))


def entry_points_reaching(calls: DataFrame, targets: DataFrame, entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., target, entry, any_entry): entry points from which a target is reached, itself included.

    A target that none reaches comes once, with any_entry and no entry: it stands for all entry points of its
    keys, however many. `every_entry` gives the pairs.
    """
    back = calls.select(*keys, F.col("target").alias("source"), F.col("source").alias("target"))
    starts = targets.select(*keys, F.col("node").alias("start"), "node")
    found = reachable(back, starts, keys).join(entries.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
    found = found.select(*keys, F.col("start").alias("target"), F.col("node").alias("entry"), F.lit(False).alias("any_entry"))
    none = targets.select(*keys, F.col("node").alias("target")).distinct().join(found, [*keys, "target"], "left_anti")
    some = entries.select(*keys).distinct() if keys else entries.select(F.lit(True).alias("_some")).limit(1)
    none = none.join(some, list(keys), "left_semi") if keys else none.crossJoin(F.broadcast(some))  # one row
    return found.union(none.select(*keys, "target", F.lit(None).cast(found.schema["entry"].dataType).alias("entry"), F.lit(True).alias("any_entry")))


def every_entry(reaching: DataFrame, entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., target, entry): the pairs of `entry_points_reaching`, those of any_entry written out."""
    every = entries.select(*keys, F.col("node").alias("entry")).distinct()
    none = reaching.where("any_entry").drop("entry")
    none = none.join(every, list(keys)) if keys else none.crossJoin(every)
    return reaching.where("not any_entry").select(*keys, "target", "entry").union(none.select(*keys, "target", "entry"))


def _leading(way: DataFrame, ends: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys..., _to): nodes from which an end is reached, and all of graphs with `size` nodes, where a path may end by its length."""
    back = way.select(*keys, F.col("_to").alias("source"), F.col("_from").alias("target"))
    found = reachable(back, ends.select(*keys, F.lit(0).alias("start"), F.col("_from").alias("node")), keys).select(*keys, "node")
    nodes = way.select(*keys, F.col("_from").alias("node")).union(way.select(*keys, F.col("_to").alias("node"))).distinct()
    big = nodes.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= size)
    big = nodes.join(big, list(keys), "left_semi") if keys else nodes.crossJoin(F.broadcast(big)).select("node")  # one row
    return stored(found.union(big).distinct().withColumnRenamed("node", "_to"), "chain-leading")


def _first_paths(starts: DataFrame, edge: DataFrame, ends: DataFrame, keys: Sequence[str], on: Sequence[str], most: int, size: int) -> DataFrame:
    """(on..., chain): the first `most` simple paths, in the order of node ids, from the starts to one of the ends or of `size` nodes.

    A round goes on with the first `most` paths of `on` only and sets the others aside. What is set aside sorts
    behind what was gone on with, so it is taken up only where fewer than `most` paths came out, until those
    are found or none is left; edges that lead to no end are dropped before.
    """
    order = [F.col("chain")]
    way = edge.select(*keys, F.col("source").alias("_from"), F.col("target").alias("_to"))
    ends = stored(ends.select(*keys, F.col("node").alias("_from")).distinct().withColumn("_end", F.lit(True)), "chain-ends")
    aside = stored(starts.select(*on, "chain").dropna(subset=list(on)).where(F.element_at("chain", 1).isNotNull()), "chain-aside")
    done = aside.where("false")
    pruned = False
    ended = lambda df: df.withColumn("_from", F.element_at("chain", -1)).join(ends, [*keys, "_from"], "left")
    stop = F.coalesce("_end", F.lit(False)) | (F.size("chain") >= size)
    while True:
        front = stored(ended(first_n(aside, on, order, most)), "chain-front")
        if front.isEmpty():
            return done
        steps, fronts = [aside], [front]
        while not front.isEmpty():
            go = front.where(~stop).join(way, [*keys, "_from"]).where(~F.array_contains("chain", F.col("_to")))
            steps.append(stored(go.select(*on, F.array_append("chain", F.col("_to")).alias("chain")), "chain-step"))
            front = stored(ended(first_n(steps[-1], on, order, most)), "chain-front")
            fronts.append(front)
        out = [f.where(stop).select(*on, "chain") for f in fronts]
        done = stored(first_n(_union([done, *out]), on, order, most), "chain-done")
        full = done.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") >= most)
        taken = _union([f.select(*on, "chain") for f in fronts])
        aside = stored(_union(steps).join(taken, [*on, "chain"], "left_anti").join(full, list(on), "left_anti"), "chain-aside")
        forget(*steps, *fronts)
        if not pruned and not aside.isEmpty():
            leading, pruned = _leading(way, ends, keys, size), True
            way = stored(way.join(leading, [*keys, "_to"], "left_semi"), "chain-edges")
            aside = aside.withColumn("_to", F.element_at("chain", -1)).join(leading, [*keys, "_to"], "left_semi").select(*on, "chain")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chains(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], most: int = 20, depth: int = 200) -> DataFrame:
    """(keys..., chain array): simple paths from nodes nothing points to (else from every node) to a SINK or a leaf.

    nodes: (keys..., node, role). At most `most` chains of a graph, the first by node ids; a path that reaches
    `depth` ends there; a graph without any chain gives all its nodes as one.
    """
    edge = stored(known_edges(edges, nodes, keys), "chain-edges")
    deg = degrees(nodes, edge, keys)
    ends = deg.join(nodes.select(*keys, "node", "role").distinct(), [*keys, "node"]).where((F.upper("role") == "SINK") | (F.col("n_out") == 0))
    starts = roots(nodes, edge, keys).select(*keys, F.array("node").alias("chain"))
    out = _first_paths(starts, edge, ends, keys, keys, most, depth)
    whole = nodes.join(out.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("node")).alias("chain"))
    return out.unionByName(whole)


def caller_chains(calls: DataFrame, targets: DataFrame, keys: Sequence[str] = (), most: int = 20, depth: int = 10) -> DataFrame:
    """(keys..., target, chain): simple paths of callers that end in the target, outermost first.

    At most `most` chains of a target, the first by node ids as seen from the target; a path of `depth` calls ends there.
    """
    edge = stored(calls.select(*keys, F.col("target").alias("source"), F.col("source").alias("target")).distinct(), "callers")
    starts = targets.select(*keys, F.col("node").alias("target"), F.array("node").alias("chain")).distinct()
    nodes = targets.select(*keys, "node").union(edge.select(*keys, F.col("target").alias("node"))).distinct()
    ends = nodes.join(edge.select(*keys, F.col("source").alias("node")), [*keys, "node"], "left_anti")
    out = _first_paths(starts, edge, ends, keys, [*keys, "target"], most, depth + 1)
    return out.withColumn("chain", F.reverse("chain"))


def first_edge_paths(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], steps: int = 50) -> DataFrame:
    """(keys..., start, path): from each node nothing points to, and then from nodes no path has touched, along the smallest edge."""
    edge = stored(known_edges(edges, nodes, keys), "first-edges")
    first = stored(edge.groupBy(*keys, "source").agg(F.min("target").alias("target")), "first-edge")

    def follow(starts: DataFrame) -> DataFrame:
        path, done = stored(starts.select(*keys, F.col("node").alias("start"), F.array("node").alias("path")), "first-front"), []
        for _ in range(steps):
            ahead = path.withColumn("source", F.element_at("path", -1)).join(first, [*keys, "source"], "left")
            more = F.col("target").isNotNull() & ~F.array_contains("path", F.col("target")) & (F.size("path") < steps)
            done.append(stored(ahead.where(~F.coalesce(more, F.lit(False))).select(*keys, "start", "path"), "first-done"))
            path = stored(ahead.where(more).select(*keys, "start", F.array_append("path", F.col("target")).alias("path")), "first-front")
            if path.isEmpty():
                break
        out = done[0]
        for p in done[1:]:
            out = out.unionByName(p)
        return out

    out = follow(degrees(nodes, edge, keys).where("n_in = 0"))
    rest = nodes.select(*keys, "node").distinct().join(out.select(*keys, F.explode("path").alias("node")).distinct(), [*keys, "node"], "left_anti")
    while not rest.isEmpty():  # untouched nodes lie on or behind cycles: the smallest of each of their components goes next
        inner = first.join(rest.withColumnRenamed("node", "source"), [*keys, "source"], "left_semi").join(rest.withColumnRenamed("node", "target"), [*keys, "target"], "left_semi")
        comp = connected_components(inner, "source", "target", *keys)
        parts = rest.join(comp, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
        more = stored(follow(parts.groupBy(*keys, "component").agg(F.min("node").alias("node")).select(*keys, "node")), "first-more")
        out = out.unionByName(more)
        rest = stored(rest.join(more.select(*keys, F.explode("path").alias("node")).distinct(), [*keys, "node"], "left_anti"), "first-rest")
    return out


def traces(edges: DataFrame, starts: DataFrame, ends: DataFrame, keys: Sequence[str] = (), depth: int = 10, states: int | None = 2000, best: int | None = 3) -> DataFrame:
    """(keys..., start, path, priority, depth, truncated): the best ways from a start along the edges to an end.

    ends: (keys..., node, priority). Each state is entered once per start, by its smallest path; a start enters at most
    `states` in all, those of a round by their paths, and is truncated where there were more. Of the ends reached the `best` by
    priority, then depth, are given (None: no cap);
    a node without a way on, or at the last depth, ends with the lowest priority. Run it over turned edges to
    trace the other way, or over edges cut down to the steps of a chain to stay inside it. No side of a round's joins goes through the driver.
    """
    on = [*keys, "start"]
    edge = stored(edges.select(*keys, "source", "target").distinct(), "trace-edges")
    ways = edge.select(*keys, F.col("source").alias("node")).distinct().withColumn("_on", F.lit(True))
    end = ends.groupBy(*keys, "node").agg(F.min("priority").alias("priority"))
    mark = stored(ways.join(dealt(end), [*keys, "node"], "full"), "trace-ends")  # what a node is: an end, a node with a way on, or both
    met = lambda df: stored(df.join(dealt(mark), [*keys, "node"], "left"), "trace-front")
    front = met(starts.select(*on, F.col("start").alias("node"), F.array("start").alias("path"), F.lit(1).cast("long").alias("taken"), F.lit(False).alias("over")).distinct())
    seen, fronts, done, cut = Gathered(front, *on, "node"), [front], [], []
    for step in range(depth + 1):
        last = F.col("priority").isNotNull() | F.col("_on").isNull() | F.lit(step == depth)
        done.append(front.where(last).select(*on, "path", F.coalesce("priority", F.lit(1 << 20)).alias("priority"), F.lit(step).alias("depth")))
        go = front.where(~last).withColumnRenamed("node", "source").join(dealt(edge), [*keys, "source"]).select(*on, F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path"), "taken")
        go = go.groupBy(*on, "node").agg(F.min("path").alias("path"), F.max("taken").alias("taken")).join(dealt(seen.rows()), [*on, "node"], "left_anti")
        if states:  # one row more tells that there were more
            go = first_n(go, on, [F.col("path")], states + 1, "place").where(F.col("taken") + F.col("place") <= states + 1).withColumn("over", F.col("taken") + F.col("place") > states)
            go = go.withColumn("taken", F.col("taken") + F.count_if(~F.col("over")).over(W.partitionBy(*on))).drop("place")
        else:
            go = go.withColumn("over", F.lit(False))
        every = met(go.select(*on, "node", "path", "taken", "over"))
        fronts.append(every)
        cut.append(every.where("over").select(*on))
        front = every.where("not over")
        if front.isEmpty():
            break
        seen.add(front)
    out = _union(done)
    flagged = _union(cut).distinct().withColumn("_cut", F.lit(True)) if cut else starts.select(*on).where("false").withColumn("_cut", F.lit(True))
    out = (first_n(out, on, [F.col("priority"), F.col("depth"), F.col("path")], best) if best else out).join(dealt(flagged), on, "left")
    out = stored(out.withColumn("truncated", F.coalesce("_cut", F.lit(False))).drop("_cut"), "traces")
    seen.forget()
    forget(edge, mark, *fronts)
    return out


def points_to(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(keys..., node, roots, truncated), and the pairs (keys..., node, root) they come from.

    Inclusion constraints: whatever the source of an edge may point to, its target may too. Semi-naive: a round
    joins only new pairs with the edges. Sets are cut to the `most` smallest roots at the end, with a flag.
    """
    flow = reachable(edges, seeds.select(*keys, F.col("root").alias("start"), "node"), keys)
    pairs = flow.select(*keys, "node", F.col("start").alias("root"))
    size = pairs.groupBy(*keys, "node").agg(F.count("*").alias("_n"))
    kept = first_n(pairs, [*keys, "node"], [F.col("root")], most).groupBy(*keys, "node").agg(F.array_sort(F.collect_list("root")).alias("roots"))
    return kept.join(size, [*keys, "node"]).select(*keys, "node", "roots", (F.col("_n") > most).alias("truncated")), pairs


def foremost(writers: DataFrame, alike: Sequence[str], method: str, order: str, most: int) -> DataFrame:
    """Of writers that any read scores alike those that can be among the first `most` of a read, whatever the read's own method, which does not count:
    at most `most` of a method, and twice as many in all."""
    return first_n(first_n(writers, [*alike, method], [F.col(order)], most), alike, [F.col(order)], 2 * most)


def of_type(bases: DataFrame, id_: str, owner: str, above: DataFrame) -> DataFrame:
    """bases: (id, owner, roots, ...): roots whose type is known and is not below the owner are left out.

    above: (node, ancestor) of types. A root names its type behind its prefix and before an @.
    """
    each = bases.select(id_, owner, F.explode("roots").alias("_root")).withColumn("_type", F.nullif(F.trim(F.regexp_extract("_root", r"^(?:ALLOC|BEAN|INJECT):([^@]*)", 1)), F.lit("")))
    types = above.select(F.col("node").alias("_type")).distinct().withColumn("_known", F.lit(True))
    fits = above.select(F.col("node").alias("_type"), F.col("ancestor").alias(owner)).distinct().withColumn("_fits", F.lit(True))
    both = each.join(types, "_type", "left").join(fits, ["_type", owner], "left")
    stay = F.col(owner).isNull() | F.col("_type").isNull() | (F.col("_type") == F.col(owner)) | F.col("_known").isNull() | F.col("_fits")
    kept = both.where(stay).groupBy(F.col(id_).alias("_id")).agg(F.array_sort(F.collect_set("_root")).alias("_kept"))
    none = F.when(F.col("roots").isNotNull(), F.slice("roots", 1, 0))
    return bases.join(kept, F.col(id_) == F.col("_id"), "left").withColumn("roots", F.coalesce("_kept", none)).drop("_id", "_kept")


def heap_matches(reads: DataFrame, writes: DataFrame, sets: DataFrame, field: str = "field", most: int = 25, above: DataFrame | None = None) -> DataFrame:
    """(read, write, score): writes of the field a read looks at, in other methods, whose bases may be the same object.

    reads, writes: (id, method, cls, base, field); sets: (node, roots, truncated). Bases match when their roots
    overlap, or either is unknown, empty or truncated. Same class scores 10 and each common root 1; the `most` best of a read.
    With `above` (types) roots count only where their type fits the field's class, the part of its name before #. Of writes with
    one field, class and root set only the foremost meet the reads, and of those with one field and root set the foremost of all classes meet the
    reads of other classes, which score them alike: so a read's pairs do not grow with its field's writers or classes.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        known_ = sets.select(F.col("node").alias("base"), "roots", "truncated")
        both = df.select("id", "method", "cls", "base", field).join(known_, "base", "left")
        if above is not None:
            typed = of_type(both.withColumn("_owner", F.when(F.contains(field, F.lit("#")), F.substring_index(field, "#", 1))), "id", "_owner", above).drop("_owner")
            both = typed.withColumn("roots", F.when(F.size("roots") > 0, F.col("roots")))  # none that fits: unknown
        return both.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "method", "cls", "base")], field, F.array_sort(F.array_distinct("roots")).alias(f"{p}_roots"), F.coalesce("truncated", F.lit(False)).alias(f"{p}_cut"))

    r, w = side(reads, "r"), side(writes, "w")
    w = stored(foremost(w, [field, "w_cls", "w_roots", "w_cut"], "w_method", "w_id", most), "heap-writers")
    # without those of the read's class (two `most`) and method (one) enough are left
    others = stored(first_n(w, [field, "w_roots", "w_cut"], [F.col("w_id")], 4 * most), "heap-others")
    alike = F.col("r_cls") == F.col("w_cls")
    same = F.when(alike, 10).otherwise(0)
    loose = lambda p: F.col(f"{p}_roots").isNull() | F.col(f"{p}_cut")

    def met(reads_: DataFrame, pick, on: Sequence[str]) -> DataFrame:
        own = reads_.withColumn("w_cls", F.col("r_cls")).join(pick(w), [*on, "w_cls"])
        other = reads_.join(pick(others), list(on)).where(~F.coalesce(alike, F.lit(False)))
        return own.unionByName(other.select(*own.columns)).where("r_method <> w_method")

    # bases with known roots meet by field and root
    each = lambda df, p: df.where(~loose(p)).select("*", F.explode(f"{p}_roots").alias("_root")).drop(f"{p}_roots", f"{p}_cut")
    known = met(each(r, "r"), lambda df: each(df, "w"), [field, "_root"]).groupBy("r_id", "w_id").agg((F.max(same) + F.count("*")).alias("score"))
    # only where a side is unknown or truncated may any base of the field be the same
    common = F.coalesce(F.size(F.array_intersect("r_roots", "w_roots")), F.lit(0))
    open_ = met(r.where(loose("r")), lambda df: df, [field]).unionByName(met(r.where(~loose("r")), lambda df: df.where(loose("w")), [field]))
    both = known.unionByName(open_.select("r_id", "w_id", (same + common).alias("score")))
    both = both.select(F.col("r_id").alias("read"), F.col("w_id").alias("write"), "score")
    return first_n(both, ["read"], [F.desc("score"), F.col("write")], most)


def dispatch_edges(calls: DataFrame, methods: DataFrame, above: DataFrame, most: int | None = None) -> DataFrame:
    """Calls with edges to the overrides they may reach: (caller, callee, kind), a kind for each edge, the first by name.

    calls: (caller, callee, kind); methods: (method, cls, name, arity, abstract, virtual); above: (node, ancestor) of
    classes. A virtual method of an abstract type also leads to the concrete methods of the same name and
    number of parameters below it: all of them, or with `most` the first so many. In the latter case a caller's calls and their overrides
    meet in one row: a method's code is short (64 KB in a class file), and so an edge is not shuffled by itself.
    """
    m = methods.select("method", "cls", "name", "arity", "abstract", "virtual")
    wide = m.where("abstract and virtual").select(F.col("method").alias("callee"), F.col("cls").alias("ancestor"), "name", "arity")
    below = wide.join(above, "ancestor").select("callee", "name", "arity", F.col("node").alias("cls"))
    made = m.where("not abstract").select("cls", "name", "arity", "method").distinct()
    if most is None:
        return _with_all_overrides(calls, below, made)
    # the first of a callee are among the first of each class below it
    made = first_n(made, ["cls", "name", "arity"], [F.col("method")], most)
    over = below.join(made, ["cls", "name", "arity"]).select("callee", F.col("method").alias("override"))
    over = first_n(over.distinct(), ["callee"], [F.col("override")], most).groupBy("callee").agg(F.collect_list("override").alias("_over"))
    own = calls.join(over, "callee", "left").groupBy("caller").agg(F.collect_set(F.struct("callee", "kind")).alias("_own"), F.flatten(F.collect_set("_over")).alias("_over"))
    own = own.withColumn("_own", F.array_sort("_own")).withColumn("_callees", F.array_distinct("_own.callee"))
    first = F.filter("_own", lambda x, i: (i == 0) | ~F.get(F.col("_own"), i - 1)["callee"].eqNullSafe(x["callee"]))
    more = F.transform(F.array_except("_over", "_callees"), lambda c: F.struct(c.alias("callee"), F.lit("IMPL").alias("kind")))
    return own.select("caller", F.inline(F.concat(first, more)))


def _with_all_overrides(calls: DataFrame, below: DataFrame, made: DataFrame) -> DataFrame:
    """Methods of the same classes, name and number of parameters are one set, and a method is in one set only. A caller meets each set it may reach once, so
    edges to overrides are not compared; those of a set that it calls itself travel with it."""
    place = ["cls", "name", "arity"]
    where = made.groupBy("method").agg(F.array_sort(F.collect_set(F.struct(*place))).alias("_places"))
    sets = stored(where.select("_places").distinct().withColumn("_set", F.monotonically_increasing_id()), "dispatch-sets")
    members = stored(where.join(sets, "_places").select("method", "_set"), "dispatch-members")
    reach = stored(below.join(sets.select("_set", F.inline("_places")), place).select("callee", "_set").distinct(), "dispatch-reach")
    own = stored(calls.groupBy("caller", "callee").agg(F.min(F.struct("kind")).alias("_kind")), "dispatch-calls")
    called = own.join(members.withColumnRenamed("method", "callee"), "callee").select("caller", "_set", "callee", F.lit(False).alias("_reached"))
    met = own.join(reach, "callee").select("caller", "_set", F.lit(None).cast(called.schema["callee"].dataType).alias("callee"), F.lit(True).alias("_reached"))
    met = met.unionByName(called).groupBy("caller", "_set").agg(F.max("_reached").alias("_reached"), F.collect_set("callee").alias("_own")).where("_reached").drop("_reached")
    more = all_pairs(stored(met, "dispatch-met"), members, ["_set"], "caller").where(~F.array_contains("_own", F.col("method")))
    return own.select("caller", "callee", "_kind.kind").unionByName(more.select("caller", F.col("method").alias("callee"), F.lit("IMPL").alias("kind")))


def entry_points(methods: DataFrame, rules: DataFrame, above: DataFrame) -> DataFrame:
    """(method, rule) for methods a framework calls. methods: (method, cls, name, annotations, cls_annotations);
    rules: (rule, cls_annotation, annotation, ancestor, name), null parts match anything; above: (node, ancestor)."""
    up = above.groupBy(F.col("node").alias("cls")).agg(F.collect_set("ancestor").alias("_up"))
    m = methods.join(up, "cls", "left")
    has = lambda rule, col: F.col(rule).isNull() | F.coalesce(F.array_contains(F.col(col), F.col(rule)), F.lit(False))
    r = rules.select("rule", *[F.col(c).alias(f"_{c}") for c in ("cls_annotation", "annotation", "ancestor", "name")])
    hit = has("_cls_annotation", "cls_annotations") & has("_annotation", "annotations") & has("_ancestor", "_up") & (F.col("_name").isNull() | (F.col("_name") == F.col("name")))
    return m.join(r, hit).select("method", "rule").distinct()  # a theta join: Spark broadcasts the rules by their size


def chain_rows(chains_: DataFrame, keys: Sequence[str], chain: str = "chain") -> tuple[DataFrame, DataFrame]:
    """Chains as dataflow rows: nodes (keys..., node, pos, role) and edges (keys..., source, target)."""
    each = chains_.select(*keys, F.size(chain).alias("_n"), F.posexplode(chain).alias("pos", "node"))
    role = F.when(F.col("pos") == 0, "SOURCE").when(F.col("pos") == F.col("_n") - 1, "SINK").otherwise("PROPAGATOR")
    return each.select(*keys, "node", "pos", role.alias("role")), consecutive(each, "node", keys, [F.col("pos")])

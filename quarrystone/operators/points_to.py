"""Points-to index: which allocations, beans or unknowns a token of a method may stand for.

Method summaries become inclusion constraints between (method, token) nodes: whatever the right side of a copy, load or
store may point to, its left side may too; parameters take what callers pass, results what callees return. A field token
of a callee, `HEAP(base):field` however nested, is rewritten for every call site by putting in the caller's receiver,
argument or result, and takes what that token points to in the caller. The fixpoint keeps a sorted set of roots for each
node, capped inside the loop, and sends only what is new in a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.relational import first_n
from quarrystone.storage import dealt, forget, parts_for, plain, sorted_run, stored

#: Prefixes of tokens (fixed values): those that are roots by themselves, and those of results of calls.
ROOTS = ("BEAN:", "INJECT:", "ALLOC:")
UNKNOWN, RESULT = "UNKNOWN", "CALLRET@"
#: Levels of nesting that rewriting follows.
NESTED = 20

_NONE = ""  # stands for UNKNOWN while solving, as it sorts before all names


def is_unknown(token: Column) -> Column:
    return (token == UNKNOWN) | F.startswith(token, F.lit(UNKNOWN + ":"))


def is_root(token: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(token, F.lit(p)) for p in ROOTS], is_unknown(token))


def known(token: Column) -> Column:
    """The trimmed token, null where it is blank or unknown."""
    t = F.trim(token)
    return F.when((t != "") & (t != UNKNOWN), t)


def nesting(token: Column) -> tuple[Column, Column, Column]:
    """(levels, innermost base, fields from the inside): `HEAP(HEAP(PARAM:0):a):b` is (2, PARAM:0, [a, b]); levels are null where parentheses don't match."""
    open_ = F.regexp_extract(token, r"^((?:HEAP\()*)", 1)
    parts = F.split(F.substring(token, F.length(open_) + 1, F.length(token)), r"\):")
    levels = F.length(open_) / 5
    return F.when(F.size(parts) - 1 == levels, levels.cast("int")), parts[0], F.slice(parts, 2, F.size(parts))


def field_of(base: Column, field: Column) -> Column:
    """The token of a field of what `base` stands for."""
    return F.when(base == "THIS", F.concat(F.lit("THIS:"), field)).when(base == "STATIC", F.concat(F.lit("STATIC:"), field)).otherwise(F.concat(F.lit("HEAP("), base, F.lit("):"), field))


def rewritten(token: Column, receiver: Column, args: Column, result: Column, nested: tuple[Column, Column, Column] | None = None) -> Column:
    """A callee's token as its caller sees it at a call, null where it has no name there. Static fields keep theirs; at most NESTED levels.

    `nested` are columns that hold the token's `nesting`; without them it is parsed wherever it is looked at.
    """
    levels, base, fields = nested or nesting(token)
    own = F.startswith(base, F.lit("THIS:"))
    number = F.regexp_extract(base, r"^PARAM:(\d{1,9})$", 1)
    start = (
        F.when(own | (base == "THIS"), known(receiver)).when(base == "RET", known(result))
        .when(number != "", known(F.get(args, number.try_cast("int")))).when(F.startswith(base, F.lit("STATIC:")), base)
    )
    inner = F.when(own, F.array(F.substring(base, 6, 1 << 20))).otherwise(F.array().cast("array<string>"))
    all_ = F.aggregate(F.concat(inner, fields), start, field_of)
    return F.when(F.startswith(token, F.lit("STATIC:")), token).when(levels <= NESTED, all_)


def is_field(token: Column) -> Column:
    """Whether a token names a field: of this object, of a class, or of what another token stands for."""
    levels, _, fields = nesting(token)
    named = F.startswith(token, F.lit("THIS:")) | F.startswith(token, F.lit("STATIC:"))
    deep = F.startswith(token, F.lit("HEAP("))  # most tokens are no fields and need no parsing
    return F.coalesce(F.when(named, F.length(token) > F.instr(token, ":")).when(deep, (levels > 0) & (F.try_element_at(fields, F.lit(-1)) != "")), F.lit(False))


def call_sites(calls: DataFrame, targets: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """calls: (keys..., method, callee, offset, receiver, args, result), once for each method that a call may reach.

    targets: (keys..., method, offset, callee), as dispatch finds them at a place; without it the declared callee counts alone. A call without any
    target stays, with a null callee.
    """
    if targets is None:
        return calls
    more = targets.select(*keys, "method", F.col("offset").alias("_at"), F.col("callee").alias("_to")).distinct()
    at = [*keys, "method"]
    found = calls.withColumn("_at", F.col("offset")).join(more, [*at, "_at"]).where(~F.col("_to").eqNullSafe(F.col("callee")))
    found = found.select(*[F.col("_to").alias("callee") if c == "callee" else F.col(c) for c in calls.columns])
    reached = found.select(*at, "offset").distinct()
    declared = calls.where("callee is not null").unionByName(calls.where("callee is null").join(reached, [*at, "offset"], "left_anti").select(*calls.columns))
    return declared.unionByName(found)


def constraints(copies: DataFrame, loads: DataFrame, stores: DataFrame, sites: DataFrame, keys: Sequence[str] = (), by_site: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (keys..., method, token, to_method, to_token), the second flowing into the first, and seeds (keys..., method, token, root, truncated).

    copies: (method, left, right); loads: (method, target, source_field); stores: (method, target_field, value); sites: as `call_sites` gives them.
    An allocation is named by its class, or with `by_site` also by the place it is made at.
    """
    at = [*keys, "method"]
    inside = lambda df, left, right: df.select(*at, F.trim(left).alias("token"), F.col("method").alias("to_method"), F.trim(right).alias("to_token"))
    seed = lambda df, token, root: df.select(*at, F.trim(token).alias("token"), root.alias("root"), F.lit(False).alias("truncated"))
    named = sites.withColumn("_ret", F.concat(F.lit(RESULT), F.col("offset").cast("string")))
    results = named.withColumn("_out", F.explode(F.array_distinct(F.array_compact(F.array("_ret", F.when(F.trim("result") != "", F.trim("result")))))))
    made = F.endswith("callee", F.lit("#<init>"))
    site = F.concat(F.lit("@"), "method", F.lit("@"), F.coalesce(F.col("offset").cast("string"), F.lit(UNKNOWN))) if by_site else F.lit("")
    alloc = F.concat(F.lit("ALLOC:"), F.substring_index("callee", "#", 1), site)
    to_callee = lambda df, token, value: df.select(*keys, F.col("callee").alias("method"), token.alias("token"), F.col("method").alias("to_method"), F.trim(value).alias("to_token"))
    reached = named.where("callee is not null")
    args = reached.select(*keys, "callee", "method", F.posexplode("args").alias("i", "arg"))
    edges = [
        inside(copies, "left", "right"), inside(loads, "target", "source_field"), inside(stores, "target_field", "value"),
        to_callee(reached, F.lit("THIS"), F.col("receiver")), to_callee(args, F.concat(F.lit("PARAM:"), F.col("i").cast("string")), F.col("arg")),
        results.where(~made).select(*at, F.col("_out").alias("token"), F.col("callee").alias("to_method"), F.lit("RET").alias("to_token")),
    ]
    seeds = [seed(results.where(made), F.col("_out"), alloc), seed(results.where("callee is null"), F.col("_out"), F.lit(UNKNOWN))]
    edges.append(field_edges(tokens_of(copies, loads, stores, sites, keys), reached, keys))
    edge = stored(reduce(DataFrame.unionByName, edges).where("token <> '' and to_token <> ''").distinct(), "points-constraints")  # read for edges and for seeds
    root = is_root(F.col("to_token"))
    seeds.append(edge.where(root).select(*at, "token", F.when(is_unknown(F.col("to_token")), UNKNOWN).otherwise(F.col("to_token")).alias("root"), F.lit(False).alias("truncated")))
    return edge.where(~root), reduce(DataFrame.unionByName, seeds).where("token <> ''")


def tokens_of(copies: DataFrame, loads: DataFrame, stores: DataFrame, sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., method, token): every token that a method's summary names."""
    at = [*keys, "method"]
    lists = [(copies, F.array("left", "right")), (loads, F.array("target", "source_field")), (stores, F.array("target_field", "value"))]
    lists.append((sites, F.concat(F.coalesce("args", F.array().cast("array<string>")), F.array("receiver", "result"))))
    each = [df.select(*at, F.explode(some).alias("token")) for df, some in lists]
    return reduce(DataFrame.unionByName, each).withColumn("token", F.trim("token")).where("token <> ''").distinct()


def field_edges(tokens: DataFrame, sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., method, token, to_method, to_token): field tokens of a callee with what they are called in each caller."""
    parsed = [c.alias(n) for c, n in zip(nesting(F.col("token")), ("_levels", "_base", "_fields"))]  # once a token, not once a call
    fields = tokens.where(is_field(F.col("token"))).select(*keys, F.col("method").alias("callee"), "token", *parsed)
    met = fields.join(dealt(sites.where("callee is not null").select(*keys, "callee", "method", "receiver", "args", "result")), [*keys, "callee"])
    there = rewritten(F.col("token"), F.col("receiver"), F.col("args"), F.col("result"), (F.col("_levels"), F.col("_base"), F.col("_fields")))
    # exploded, so that what filters the outcome does not work it out again
    return met.select(*keys, F.col("callee").alias("method"), "token", F.col("method").alias("to_method"), F.explode(F.array_compact(F.array(there))).alias("to_token"))


def injection_seeds(tokens: DataFrame, fields: DataFrame, params: DataFrame, candidates: DataFrame, keys: Sequence[str] = (), most: int = 20) -> DataFrame:
    """(keys..., method, token, root, truncated) of injected fields and parameters.

    fields: (keys..., token, target), the token being `THIS:Class#name`; params: (keys..., method, token, target); candidates: (target, bean), one
    more than `most` telling that there are more. Without a candidate, and where there are more, the injection itself is a root and the set is truncated.
    """
    asked = tokens.join(fields, [*keys, "token"]).select(*keys, "method", "token", "target").unionByName(tokens.join(params, [*keys, "method", "token"]).select(*keys, "method", "token", "target"))
    per = candidates.groupBy("target").agg(F.array_sort(F.collect_set("bean")).alias("beans"))
    both = asked.join(per, "target", "left").withColumn("beans", F.coalesce("beans", F.array().cast("array<string>")))
    itself = F.struct(F.concat(F.lit("INJECT:"), "target").alias("root"), F.lit(True).alias("truncated"))
    beans = F.transform(F.slice("beans", 1, most), lambda b: F.struct(F.concat(F.lit("BEAN:"), b).alias("root"), F.lit(False).alias("truncated")))
    none = (F.size("beans") == 0) | (F.size("beans") > most)
    return both.select(*keys, "method", "token", F.inline(F.when(none, F.concat(beans, F.array(itself))).otherwise(beans)))


def solve(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), most: int = 50) -> DataFrame:
    """(keys..., method, token, roots, truncated): the least sets that hold the seeds and are closed under the edges.

    A set that would pass `most` roots keeps the first by name, UNKNOWN before all, and is truncated; what it flows into is
    truncated too and holds UNKNOWN. As the first of a union are among the first of its parts, the result does not depend on
    the order of rounds. Edges and sets lie in runs sorted by node, so a round shuffles new roots alone, once, and looks up
    only the nodes they reach.
    """
    on, state = [*keys, "method", "token"], "array<string>"
    parts = parts_for(edges, 200_000)
    edge = edges.select(*keys, F.col("to_method").alias("method"), F.col("to_token").alias("token"), F.col("method").alias("_method"), F.col("token").alias("_token"))
    edge = sorted_run(edge.repartition(parts, *on), "points-edges", parts, *on, dealt_so=True)
    arrive = seeds.select(*on, F.explode(F.array(F.when(F.col("root") == UNKNOWN, _NONE).otherwise(F.col("root")), F.when(F.col("truncated"), F.lit(None).cast("string")).otherwise(F.lit(_NONE)))).alias("root"), F.col("root").alias("_r"))
    arrive = arrive.where((F.col("root").isNull()) | (F.col("root") != _NONE) | (F.col("_r") == UNKNOWN)).select(*on, "root")  # a null tells that a set is truncated
    sets = _Sets(on, parts)
    for step in count():
        sent = first_n(arrive.repartition(parts, *on).distinct(), on, [F.col("root").asc_nulls_first()], most + 2)
        got = sent.groupBy(*on).agg(F.collect_list("root").alias("_in"), F.bool_or(F.col("root").isNull()).alias("_cut"))
        both = sets.had(got).withColumn("roots", F.coalesce("_had.roots", F.array().cast(state))).withColumn("truncated", F.coalesce("_had.truncated", F.lit(False)))
        # exploded one by one, so that each array is worked out once and not wherever it is looked at
        both = both.select(*on, "roots", "truncated", "_cut", F.explode(F.array(F.sort_array(F.array_union("roots", "_in")))).alias("_union"))
        over = F.size("_union") > most
        kept = F.when(over, F.slice(F.array_distinct(F.concat(F.array(F.lit(_NONE)), "_union")), 1, most)).otherwise(F.col("_union"))
        both = both.select(*on, "roots", "truncated", (F.col("truncated") | F.col("_cut") | over).alias("_now"), F.explode(F.array(kept)).alias("_kept"))
        new = F.concat(F.array_except("_kept", "roots"), F.when(F.col("_now") & ~F.col("truncated"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast(state)))
        both = both.select(*on, "_kept", "_now", F.explode(F.array(new)).alias("fresh"))
        fresh = both.where(F.size("fresh") > 0).select(*on, F.col("_kept").alias("roots"), F.col("_now").alias("truncated"), "fresh", F.lit(step).alias("step"))
        delta = sorted_run(fresh, "points-delta", parts, *on, dealt_so=True)
        sets.add(delta)
        if delta.isEmpty():
            break
        arrive = delta.join(dealt(edge), on).select(*keys, F.col("_method").alias("method"), F.col("_token").alias("token"), F.explode("fresh").alias("root"))
    named = F.transform("roots", lambda r: F.when(r == _NONE, UNKNOWN).otherwise(r))
    out = stored(sets.last().select(*on, named.alias("roots"), "truncated").where(F.size("roots") > 0), "points-to")
    sets.forget()
    forget(edge)
    return out


class _Sets:
    """The set of each node (roots, truncated, step): runs sorted by node, one a round; what a later round says of a node counts."""

    def __init__(self, on: Sequence[str], parts: int, most: int = 6):
        self.on, self.parts, self.most, self.runs = on, parts, most, []

    def had(self, got: DataFrame) -> DataFrame:
        """`got`, dealt by node, with the set its node had before (`_had`, null for none)."""
        names = [f"_had{i}" for i in range(len(self.runs))]
        for run, c in zip(self.runs, names):
            got = got.join(dealt(run.select(*self.on, F.struct("roots", "truncated").alias(c))), self.on, "left")
        none = F.lit(None).cast("struct<roots: array<string>, truncated: boolean>")
        return got.withColumn("_had", F.coalesce(*reversed(names), none)).drop(*names)

    def last(self, runs: Sequence[DataFrame] | None = None) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [plain(r).select(*self.on, "roots", "truncated", "step") for r in runs or self.runs])
        return rows.groupBy(*self.on).agg(F.max_by(F.struct("roots", "truncated", "step"), "step").alias("s")).select(*self.on, "s.*")

    def add(self, run: DataFrame) -> None:
        self.runs.append(run)
        if len(self.runs) > self.most:
            old, newest = self.runs[:-1], self.runs[-1]  # the newest is what the loop goes on with
            self.runs = [sorted_run(self.last(old), "points-sets", self.parts, *self.on), newest]
            forget(*old)

    def forget(self) -> None:
        forget(*self.runs)


def points_to_index(copies: DataFrame, loads: DataFrame, stores: DataFrame, calls: DataFrame, targets: DataFrame | None = None, seeds: DataFrame | None = None, keys: Sequence[str] = (), most: int = 50, by_site: bool = False) -> DataFrame:
    """The index of method summaries: (keys..., method, token, roots, truncated). `seeds` are further roots, such as `injection_seeds`."""
    sites = stored(call_sites(calls, targets, keys), "points-sites")  # five kinds of edges come of them
    edges, own = constraints(copies, loads, stores, sites, keys, by_site)
    out = solve(edges, own if seeds is None else own.unionByName(seeds.select(*own.columns)), keys, most)
    forget(edges, sites)
    return out

"""Filters, joins, windows and set operations over column names: DataFrame in, DataFrame out.

Every order has a unique tiebreak, so results do not depend on how rows were read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.storage import dealt, stored

#: Characters by which packages without a colon are looked up in lines.
GRAM = 12
#: Rows that a task of `all_pairs` makes, about.
PAIRS = 1 << 21
#: Bits among which `gradle_matches` marks the groups there are; with more groups than bits no line is lost, but more of it shuffled.
SPOTS = 1 << 24


def active(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def equal_to(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality filters; those whose value is None are not applied."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def since(df: DataFrame, start, *cols: str) -> DataFrame:
    """Rows whose first non-null column of `cols` is at or after `start`."""
    return df.where(F.coalesce(*[F.col(c) for c in cols]) >= F.lit(start))


def stuck(df: DataFrame, now, seconds: int = 1800, status: str = "status", updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """PENDING or RUNNING and untouched for `seconds`, which is held between a minute and a week."""
    limit = F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(min(max(60, seconds), 7 * 86400))))
    return df.where(F.col(status).isin("PENDING", "RUNNING") & (F.coalesce(F.col(updated), F.col(created)) < limit))


def stale(df: DataFrame, deadline, status: str = "status", beat: str = "last_heartbeat") -> DataFrame:
    """READY, BUSY or DRAINING without a heartbeat since the deadline."""
    return df.where(F.col(status).isin("READY", "BUSY", "DRAINING") & (F.col(beat).isNull() | (F.col(beat) < F.lit(deadline))))


def tagged(df: DataFrame, tags: Sequence[str], col: str = "tags") -> DataFrame:
    """Rows that have all the tags; no tags match every row."""
    return df.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col(col))) == 0) if tags else df


def without_paths(df: DataFrame, pattern: str | None, col: str = "path") -> DataFrame:
    """Rows whose path does not match; an invalid pattern excludes nothing."""
    import re

    try:
        re.compile(pattern or "")
    except re.error:
        return df
    return df.where(~F.coalesce(F.col(col).rlike(pattern), F.lit(False))) if pattern else df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page; the limit is held between 1 and `most`. `order` ends with a unique column."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def with_total(df: DataFrame, paged: DataFrame, name: str = "total") -> DataFrame:
    """The page with the count of the whole set: one row joined to a bounded page."""
    return paged.join(F.broadcast(df.agg(F.count("*").alias(name))), F.lit(True))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return first_n(df, keys, order, 1)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in the order. Spark cuts to n per key before it shuffles."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", r).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def capped(df: DataFrame, group: Sequence[str], key: Sequence[str], order: Sequence[Column], per_key: int = 20, total: int = 2000) -> DataFrame:
    """At most `per_key` rows of a key and then `total` rows of a group, in the order."""
    return first_n(first_n(df, [*group, *key], order, per_key), group, order, total)


def top_and_rest(df: DataFrame, key: str, weight: str, n: int = 199, rest: str = "_OTHER") -> DataFrame:
    """(key, weight) of the n heaviest keys, all others summed under one name."""
    per = df.groupBy(key).agg(F.sum(weight).alias(weight))
    top = per.orderBy(F.desc(weight), key).limit(n)  # Spark broadcasts it while n is small
    name = F.when(F.col("_top").isNotNull(), F.col(key)).otherwise(F.lit(rest))
    return per.join(top.select(F.col(key).alias("_k"), F.lit(1).alias("_top")), F.col(key).eqNullSafe(F.col("_k")), "left").groupBy(name.alias(key)).agg(F.sum(weight).alias(weight))


def found_and_missing(asked: DataFrame, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that were asked for, and the asked keys no row has."""
    return df.join(asked, list(keys), "left_semi"), asked.join(df, list(keys), "left_anti")


def with_override(members: DataFrame, rules: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Members with rule defaults behind their overrides (name -> (override, default)), and members without a rule."""
    joined = members.join(rules, key)
    for name, (override, default) in pairs.items():
        joined = joined.withColumn(name, F.coalesce(F.col(override), F.col(default)))
    return joined, members.join(rules, key, "left_anti")


def matched_evidence(issues: DataFrame, entries: DataFrame, issue: str, group: str, keys: str, entry_key: str, pos: str, n: int = 80) -> DataFrame:
    """Entries listed under any key of an issue of their group, each once, in index order, at most n an issue.

    The first n of an issue are among the first n of its keys, so each key's entries are cut first. Issues with the same keys among those
    that have entries have the same evidence: it is found once for each such set, and only the result has a row for each issue.
    """
    asked = issues.select(issue, group, F.explode(F.array_distinct(keys)).alias("_key"))
    have = first_n(entries.withColumn("_key", F.lower(F.trim(F.col(entry_key)))).dropDuplicates([group, "_key", pos]), [group, "_key"], [F.col(pos)], n)
    sets = asked.join(have.select(group, "_key").distinct(), [group, "_key"], "left_semi").groupBy(issue, group).agg(F.array_sort(F.collect_set("_key")).alias("_keys"))
    one = sets.select(group, "_keys").distinct().withColumn("_key", F.explode("_keys"))
    hits = one.join(have, [group, "_key"]).dropDuplicates([group, "_keys", pos]).drop("_key")
    return sets.join(first_n(hits, [group, "_keys"], [F.col(pos)], n), [group, "_keys"]).drop("_keys")


def component_risk(issues: DataFrame, keys: str = "keys", version: str = "version", severity: str = "severity", status: str = "status") -> DataFrame:
    """(key, severity): the worst unresolved severity by package key and by key@@version. WONT_FIX is a risk."""
    open_ = issues.where(~F.col(status).isin("RESOLVED", "FALSE_POSITIVE"))
    each = open_.select(F.explode(keys).alias("key"), version, severity)
    both = each.select("key", severity).union(each.where(F.col(version).isNotNull()).select(F.concat_ws("@@", "key", version), severity))
    return both.groupBy("key").agg(F.max_by(severity, X.severity_rank(F.col(severity))).alias("severity"))


def risk_of(nodes: DataFrame, risk: DataFrame, node: str, keys: str, version: str) -> DataFrame:
    """Each node with the severity of the first of its keys that has one: with its version before without."""
    asked = nodes.select(node, version, F.posexplode(keys).alias("_pos", "_key"))
    exact = asked.select(node, "_pos", F.lit(0).alias("_tier"), F.concat_ws("@@", "_key", version).alias("key"))
    both = exact.union(asked.select(node, "_pos", F.lit(1), "_key"))
    best = both.join(risk, "key").groupBy(node).agg(F.min_by("severity", F.struct("_pos", "_tier")).alias("risk"))
    return nodes.join(best, node, "left")


def lines_with_tokens(lines: DataFrame, tokens: DataFrame, line: str = "line", token: str = "token", most: int = 400) -> DataFrame:
    """Lines that contain a token, a row for each token.

    Only the `most` longest tokens count, so they may come to the driver: packed into one pattern they sort out the lines
    without any, and only the others are held against each token, in the same stage as the scan.
    """
    picked = tokens.select(F.lower(F.trim(F.col(token))).alias("token")).where("token <> ''").distinct().orderBy(F.desc(F.length("token")), "token").limit(most)
    known = [r["token"] for r in picked.collect()]
    if not known:
        return lines.where("false").withColumn("token", F.lit("").cast("string"))
    low = F.lower(F.col(line))
    any_ = "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in known)
    held = F.filter(F.array(*map(F.lit, known)), lambda t: F.contains(low, t))
    return lines.where(low.rlike(any_)).withColumn("token", F.explode(held))


def longest_prefix(names: DataFrame, groups: DataFrame, name: str, group: str, sep: str = ".") -> DataFrame:
    """Each name with the longest group that equals it or that it continues after `sep`.

    A name is taken apart into its possible prefixes and joined by equality, so nothing meets everything.
    """
    parts = F.split(F.col(name), "[" + sep + "]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), sep))
    each = names.withColumn("_prefix", F.explode(prefixes)).join(groups.select(F.col(group).alias("_prefix")).distinct(), "_prefix")
    return each.groupBy(*names.columns).agg(F.max_by("_prefix", F.length("_prefix")).alias(group))


def preceding(edges: DataFrame, contexts: DataFrame, keys: Sequence[str], offset: str, at: str, context: Sequence[str], tie: str, n: int = 3) -> DataFrame:
    """The n nearest edges at or before each context (a null offset always passes, as does a null context), by key.

    Edges and contexts of a key go through one window in order of place, where a context looks back at n edges, so a
    key is sorted, not paired. Edges without an offset come after all others; n of a key suffice.
    """
    more = [c for c in edges.columns if c not in keys]
    edge = F.struct(*more)
    left = [c for c in contexts.columns if c not in keys]
    none = F.lit(None)
    rows = edges.where(F.col(offset).isNotNull()).select(*keys, F.col(offset).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), edge.alias("_edge"), none.cast(contexts.select(F.struct(*left)).schema[0].dataType).alias("_context"))
    rows = rows.unionByName(contexts.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), none.cast(edges.schema[tie].dataType).alias("_tie"), none.cast(edges.select(edge).schema[0].dataType).alias("_edge"), F.struct(*left).alias("_context")))
    # of edges at one place the smallest tie is the nearest, so it comes last
    back = ", ".join(f"lag(_edge, {k}) IGNORE NULLS OVER w" for k in range(1, n + 1))
    spec = f"PARTITION BY {', '.join(keys)} ORDER BY _at ASC NULLS LAST, _side, _tie DESC"
    seen = rows.select("*", F.expr(f"array({back.replace('OVER w', f'OVER ({spec})')})").alias("_found")).where("_side = 1")
    placed = seen.select(*keys, "_context.*", F.explode(F.filter("_found", lambda e: e.isNotNull())).alias("_e")).select(*keys, *left, "_e.*")
    loose = first_n(edges.where(F.col(offset).isNull()), keys, [F.col(tie)], n)
    both = placed.unionByName(contexts.join(loose, list(keys)).select(*placed.columns))
    return first_n(both, [*keys, *context], [F.col(offset).desc_nulls_last(), F.col(tie)], n)


def carried(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The last non-null value above each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def consecutive(df: DataFrame, node: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(keys..., source, target): each node with the one before it."""
    before = F.lag(node).over(W.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, before.alias("source"), F.col(node).alias("target")).where(F.col("source").isNotNull())


def merged_ranges(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Ranges that touch or overlap (start <= end so far + gap) as one."""
    w = W.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(F.col(start) <= far + gap, 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def log_chunks(texts: DataFrame, known: DataFrame, key: str, text: str, size: int = 1024) -> DataFrame:
    """(key, sequence, content, is_last): texts cut in pieces whose numbers continue each key's; a key without chunks marks its last piece."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    top = known.groupBy(key).agg((F.max("sequence") + 1).alias("_next"))
    rows = texts.where(F.length(text) > 0).join(top, key, "left").select(key, "_next", n.alias("_n"), F.posexplode(cut).alias("_pos", "content"))
    return rows.select(key, (F.coalesce("_next", F.lit(0)) + F.col("_pos")).alias("sequence"), "content", (F.col("_next").isNull() & (F.col("_pos") == F.col("_n") - 1)).alias("is_last"))


def typed_union(**parts: DataFrame) -> DataFrame:
    """The parts under one schema, each row with its part's name."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("item_type", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def all_pairs(many: DataFrame, few: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The inner join on `keys`, whose rows no task has many more of than `PAIRS`, however small both sides and however few the keys are.

    Of each key the rows of `many` are dealt by `by` to as many parts as its pairs need, and the rows of `few` go to all of them. Tasks are as many as the
    pairs need, not as many as the sides' bytes do. Both sides are read twice, so they should be stored.
    """
    on = list(keys)
    size = many.groupBy(*on).agg(F.count("*").alias("_many")).join(few.groupBy(*on).agg(F.count("*").alias("_few")), on)
    size = stored(size.withColumn("_parts", F.least("_many", F.ceil(F.col("_many") * F.col("_few") / PAIRS))), "pair-sizes")
    total = size.agg(F.sum(F.col("_many") * F.col("_few"))).first()[0] or 0
    tasks = min(total // PAIRS + 1, 1 << 15)
    size = size.select(*on, "_parts")
    dealt_ = many.join(size, on).withColumn("_part", F.pmod(F.xxhash64(by), "_parts")).drop("_parts").repartition(tasks, *on, "_part")
    every = few.join(size, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts").repartition(tasks, *on, "_part")
    return dealt(every).join(dealt(dealt_), [*on, "_part"]).drop("_part")  # the side that is dealt is the one a task keeps, a part at a time


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(tenant_id, user_id, permission) over roles of the same tenant, blanks dropped, no repeats.

    Repeats are dropped for each set of roles that users have, before its permissions meet the users, so pairs of users and permissions
    are neither shuffled nor compared; `all_pairs` makes them.
    """
    tenant = ["tenant_id", "_roles"]
    users = user_roles.dropna(subset=["tenant_id", "role_id"]).groupBy("tenant_id", "user_id").agg(F.array_sort(F.collect_set("role_id")).alias("_roles"))
    users = stored(users, "permission-users")
    each = users.select(*tenant).distinct().withColumn("role_id", F.explode("_roles"))
    granted = each.join(role_permissions.where(F.trim("permission") != ""), ["tenant_id", "role_id"]).select(*tenant, "permission").distinct()
    return all_pairs(users, stored(granted, "permissions-granted"), tenant, "user_id").select("tenant_id", "user_id", "permission")


def log_signals(lines: DataFrame, keys: Sequence[str], pos: str, line: str, words: dict[str, str], shown: int = 3) -> DataFrame:
    """(keys..., severity, summary, matches): lines with a keyword; a line counts once for each keyword in it. No match: no row."""
    hits = F.filter(F.array(*[F.when(F.contains(F.lower(F.col(line)), F.lit(w)), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"))) for i, (w, s) in enumerate(words.items())]), lambda x: x.isNotNull())
    each = lines.select(*keys, pos, line, F.explode(hits).alias("_h")).withColumn("_rank", X.severity_rank(F.col("_h.s")))
    first = first_n(each, keys, [F.col(pos), F.col("_h.i")], shown)
    summary = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_h.i", F.trim(line).alias("t")))), lambda x: x["t"]), " | ").alias("summary"))
    return each.groupBy(*keys).agg(F.max_by("_h.s", "_rank").alias("severity"), F.count("*").alias("matches")).join(summary, list(keys))


def line_context(points: DataFrame, lines: DataFrame, keys: Sequence[str], around: int, most: int = 400) -> DataFrame:
    """points: (keys..., at); lines: (keys..., line_no, content). The lines around each point, cut to `most` characters, the point's own marked."""
    near = points.withColumn("line_no", F.explode(F.sequence(F.col("at") - around, F.col("at") + around)))
    return near.join(lines, [*keys, "line_no"]).select(*keys, "line_no", F.substring("content", 1, most).alias("content"), (F.col("line_no") == F.col("at")).alias("highlight"))


def preferred_line(points: DataFrame, lines: DataFrame, keys: Sequence[str], ahead: int = 20) -> DataFrame:
    """(keys..., at, line_no): a point on a comment, annotation or blank line moves to the first other line within `ahead`."""
    note = F.col("content").rlike(r"^[ \t]*(//|#|\*|/\*|@)") | (F.trim("content") == "")
    near = points.withColumn("line_no", F.explode(F.sequence(F.col("at"), F.col("at") + ahead))).join(lines.withColumn("_note", note), [*keys, "line_no"])
    here = F.bool_or((F.col("line_no") == F.col("at")) & F.col("_note"))
    best = near.groupBy(*keys, "at").agg(here.alias("_move"), F.min(F.when(~F.col("_note") & (F.col("line_no") > F.col("at")), F.col("line_no"))).alias("_next"))
    moved = F.when(F.col("_move"), F.coalesce("_next", "at")).otherwise(F.col("at"))
    return points.join(best, [*keys, "at"], "left").select(*keys, "at", F.coalesce(moved, F.col("at")).alias("line_no"))


def maven_coordinates(lines: DataFrame, keys: Sequence[str], order: str, line: str) -> DataFrame:
    """(keys..., order, coordinate): group:artifact for each artifactId line, the group being the last one above or on it."""
    tag = lambda name: F.nullif(F.trim(F.regexp_extract(line, f"<{name}>([^<]*)</{name}>", 1)), F.lit(""))
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    named = lines.select(*keys, order, tag("groupId").alias("_group"), tag("artifactId").alias("_artifact")).where("_group is not null or _artifact is not null")  # other lines go no further
    seen = named.withColumn("_group", F.last("_group", ignorenulls=True).over(w))
    return seen.where("_artifact is not null and _group is not null").select(*keys, order, F.concat_ws(":", "_group", "_artifact").alias("coordinate"))


def manifest_matches(lines: DataFrame, packages: DataFrame, keys: Sequence[str], order: str, line: str, package: str) -> DataFrame:
    """(keys..., order, package, confidence): coordinates that a pom declares and that equal a package. Gradle: `gradle_matches`."""
    found = maven_coordinates(lines, keys, order, line)
    return found.join(dealt(packages.select(F.col(package).alias("coordinate")).distinct()), "coordinate").select(*keys, order, F.col("coordinate").alias(package), F.lit(0.7).alias("confidence"))


def gradle_matches(lines: DataFrame, packages: DataFrame, order: str, line: str, package: str) -> DataFrame:
    """(lines' columns, package, confidence): lines of Gradle files that contain a package's group:artifact, whatever the case.

    packages: (package), as many as there are. A line is cut at its colons: what ends before one, in the lengths that groups have, meets
    the groups, and only where a group stands there what follows is cut to the lengths of its own artifacts and meets the packages whole.
    Packages without a colon: `_held`. So neither lines nor packages are held against all others. What ends before a colon is looked up first in
    the bits that the groups set among `SPOTS`: of a line little more than its groups is shuffled.
    """
    token = F.lower(F.trim(F.col(package)))
    low = packages.groupBy(token.alias("_token")).agg(F.min(package).alias(package)).where("_token <> ''")
    # of the packages as they come, not of `low`: its shuffle is not needed for the few groups
    named = packages.select(token.alias("_token"), F.substring_index(token, ":", 1).alias("_group")).where(F.contains("_token", F.lit(":")))
    groups = stored(named.groupBy("_group").agg(F.collect_set(F.length("_token") - F.length("_group") - 1).alias("_sizes")), "gradle-groups")
    lengths = groups.agg(F.collect_set(F.length("_group")).alias("_lengths"))  # one row
    spot = F.pmod(F.xxhash64("_group"), F.lit(SPOTS))
    spotted = lambda df: df.withColumn("_word", F.shiftright(spot, 6)).withColumn("_bit", F.expr("shiftleft(1L, cast(_spot & 63 AS int))"))
    words = spotted(groups.withColumn("_spot", spot)).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # at most SPOTS / 64 rows
    parts = F.split(F.lower(F.col(line)), ":")
    with_parts = lambda df: df.withColumn("_parts", parts).withColumn("_before", F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda k: F.array_join(F.slice("_parts", 1, k), ":")))
    ends = F.flatten(F.transform(F.col("_before"), lambda b: F.transform(F.filter("_lengths", lambda n: n <= F.length(b)), lambda n: F.right(b, n))))
    cut = with_parts(lines.where(F.contains(line, F.lit(":")))).join(F.broadcast(lengths), F.lit(True)).select(*lines.columns, F.explode(F.array_distinct(ends)).alias("_group"))
    maybe = spotted(cut.withColumn("_spot", spot)).join(F.broadcast(words), "_word").where("(_bit & _bits) <> 0").select(*lines.columns, "_group")
    at = with_parts(maybe.join(groups, "_group"))
    places = F.filter(F.sequence(F.lit(1), F.size("_parts") - 1), lambda k: F.endswith(F.element_at("_before", k), F.col("_group")))
    after = F.transform(places, lambda k: F.array_join(F.slice("_parts", k + 1, F.size("_parts")), ":"))
    tokens = F.flatten(F.transform(after, lambda a: F.transform(F.filter("_sizes", lambda n: n <= F.length(a)), lambda n: F.concat(F.col("_group"), F.lit(":"), F.left(a, n)))))
    met = at.select(*lines.columns, F.explode(F.array_distinct(tokens)).alias("_token")).join(low, "_token").select(*lines.columns, package)
    return met.unionByName(_held(lines, low.where(~F.contains("_token", F.lit(":"))), line, package)).withColumn("confidence", F.lit(0.75))


def _held(lines: DataFrame, low: DataFrame, line: str, package: str) -> DataFrame:
    """(lines' columns, package): lines that contain a token. low: (_token, package).

    A token is met by its last `GRAM` characters: a line is cut into the pieces of that length at each place, which are joined with the
    tokens' ends, and what meets is compared whole; shorter tokens meet the pieces of their own length.
    """
    low = low.withColumn("_size", F.least(F.length("_token"), F.lit(GRAM))).withColumn("_piece", F.right("_token", F.lit(GRAM)))
    sizes = low.select("_size").distinct()  # at most GRAM rows
    numbered = lines.withColumn("_low", F.lower(F.col(line))).join(F.broadcast(sizes), F.length("_low") >= F.col("_size"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - F.col("_size") + 1), lambda i: F.substring(F.col("_low"), i, F.col("_size"))))
    met = numbered.withColumn("_piece", F.explode(pieces)).join(low, ["_piece", "_size"]).where(F.contains("_low", F.col("_token")))
    return met.select(*lines.columns, package)


def call_targets(calls: DataFrame, sites: DataFrame, most: int = 50) -> DataFrame:
    """(caller, offset, callee): what a call declares, and the callees recorded at the same offset, at most `most`.

    Both are dealt once, by caller and offset: a place's first row shows whether it has a call at all.
    """
    place = ["caller", "offset"]
    both = calls.select(*place, "callee", F.lit(0).alias("_o")).unionByName(sites.dropna(subset=place).select(*place, "callee", F.lit(1).alias("_o")))
    w = W.partitionBy(*place).orderBy("_o", "callee")
    each = both.repartition(*place).groupBy(*place, "callee").agg(F.min("_o").alias("_o"))
    ranked = each.withColumn("_rank", F.row_number().over(w)).withColumn("_first", F.first("_o").over(w))
    return ranked.where((F.col("_rank") <= most) & (F.col("_first") == 0)).select(*place, "callee")


def bean_candidates(targets: DataFrame, beans: DataFrame, above: DataFrame, most: int = 20) -> DataFrame:
    """(target, bean, fit): beans of the type (0), of a type below it (1), or of an unknown type (2), at most `most`.

    targets: (target); beans: (bean, type); above: (node, ancestor).
    """
    t = targets.select("target").distinct()
    exact = t.join(beans, F.col("target") == F.col("type")).select("target", "bean", F.lit(0).alias("fit"))
    sub = t.join(above, F.col("target") == F.col("ancestor")).join(beans, F.col("node") == F.col("type")).select("target", "bean", F.lit(1).alias("fit"))
    loose = first_n(beans.where("type is null").withColumn("_all", F.lit(1)), ["_all"], [F.col("bean")], most).select("bean")
    unknown = t.join(F.broadcast(loose), F.lit(True)).select("target", "bean", F.lit(2).alias("fit"))  # at most `most` rows
    both = exact.union(sub).union(unknown).groupBy("target", "bean").agg(F.min("fit").alias("fit"))
    return first_n(both, ["target"], [F.col("fit"), F.col("bean")], most)


def default_branches(repos: DataFrame, branches: DataFrame, repo: str = "repo") -> DataFrame:
    """repos: (repo, configured, detected); branches: (repo, name, commit), names as references have them. (repo, branch): the configured branch, else
    the detected one, else the first by name; null where there is none."""
    names = branch_names(branches, repo).groupBy(repo).agg(F.min("name").alias("_first"))
    detected = F.nullif(F.regexp_replace("detected", "^refs/heads/", ""), F.lit(""))
    both = repos.join(names, repo, "left")
    return both.select(repo, F.coalesce(F.when(F.trim("configured") != "", F.col("configured")), detected, F.col("_first")).alias("branch"))


def branch_names(branches: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, name, commit) without the prefixes of references; of a branch that is local and remote the local one counts."""
    short = F.regexp_replace(F.regexp_replace("name", "^refs/heads/", ""), "^refs/remotes/origin/", "")
    rows = branches.withColumn("_remote", F.startswith("name", F.lit("refs/remotes/"))).withColumn("name", short).where(F.trim("name") != "")
    return first_n(rows, [repo, "name"], [F.col("_remote"), F.col("commit")], 1).drop("_remote")


def recent_commits(repos: DataFrame, branches: DataFrame, commits: DataFrame, order: Sequence[Column], repo: str = "repo", most: int = 50) -> DataFrame:
    """The newest commits of each repository's default branch. commits: (repo, branch, ...); a repository whose default branch is not among its branches has none."""
    known_ = branch_names(branches, repo).select(repo, F.col("name").alias("branch"))
    chosen = default_branches(repos, branches, repo).join(known_, [repo, "branch"], "left_semi")
    return first_n(commits.join(chosen, [repo, "branch"]), [repo], order, most)

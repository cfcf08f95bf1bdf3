"""Graph queries: trees and graphs that Spark derives from the driver's tables.

part: key -> key div 3 is a tree over all parts. conversations: turns with edges to the next turn and, from even
turns, to the third next, a small graph for each conversation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import expr as X
from quarrystone.operators import frameworks as FW
from quarrystone.operators import graph as G
from quarrystone.operators import points_to as P
from quarrystone.operators import value_flow as V
from quarrystone.operators.components import connected_components
from quarrystone.plans.registry import query, table
from quarrystone.storage import dealt


DEEP = 64  # steps; a tree of 64-bit keys has at most 40 levels


def tree(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0")
    sev = X.mapped(F.col("p_size") % 5, {0: "CRITICAL", 1: "HIGH", 2: "MEDIUM", 3: "LOW"}, "INFO")
    nodes = p.select(F.col("p_partkey").alias("node"), sev.alias("severity"), "p_size", "p_brand")
    edges = p.where("p_partkey >= 3").select(F.expr("p_partkey div 3").alias("source"), F.col("p_partkey").alias("target"))
    return nodes, G.known_edges(edges, nodes, [])


TREE = """n AS (SELECT p_partkey AS node, 5 - least(p_size % 5, 4) AS rank, p_size, p_brand FROM part WHERE p_partkey > 0),
  e AS (SELECT p_partkey // 3 AS source, p_partkey AS target FROM part WHERE p_partkey >= 3 AND p_partkey // 3 IN (SELECT p_partkey FROM part))"""
ABOVE = "up AS (SELECT target AS node, source AS ancestor FROM e UNION ALL SELECT up.node, e.source FROM up JOIN e ON up.ancestor = e.target)"


def talk(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("node"), F.when(F.col("role") == "user", "STEP").otherwise("step").alias("role")).distinct()
    step = c.select("conv_id", F.col("node").alias("source"), (F.col("node") + 1).alias("target"))
    jump = c.where("node % 2 = 0").select("conv_id", F.col("node").alias("source"), (F.col("node") + 3).alias("target"))
    return c, step.union(jump)


TALK = """tn AS (SELECT DISTINCT conv_id, turn AS node FROM conversations),
  te AS (SELECT a.conv_id, a.node AS source, b.node AS target FROM tn a JOIN tn b ON a.conv_id = b.conv_id AND (b.node = a.node + 1 OR (a.node % 2 = 0 AND b.node = a.node + 3)))"""


@query("j1_dependency_graph", f"WITH {TREE} SELECT node, count(target) AS children FROM n LEFT JOIN e ON node = source GROUP BY node")
def j1(spark, d):
    nodes, edges = tree(spark, d)
    return G.degrees(nodes, edges).select("node", F.col("n_out").alias("children"))


@query("j2_roots", f"WITH {TREE} SELECT node, (SELECT count(*) FROM e WHERE source = node) AS n_out FROM n WHERE node NOT IN (SELECT target FROM e)")
def j2(spark, d):
    return G.roots(*tree(spark, d))


@query("j3_subtree_worst", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT n.node, greatest(n.rank, coalesce(max(b.rank), 0)) AS rank FROM n LEFT JOIN up ON up.ancestor = n.node LEFT JOIN n b ON b.node = up.node GROUP BY n.node, n.rank")
def j3(spark, d):
    return G.subtree_worst(*tree(spark, d))


@query("j4_call_chains", f"""WITH RECURSIVE {TALK}, s AS (SELECT conv_id, node FROM tn WHERE (conv_id, node) NOT IN (SELECT conv_id, target FROM te)),
  p AS (SELECT conv_id, node, [node] AS chain FROM s UNION ALL SELECT p.conv_id, target, list_append(chain, target) FROM p JOIN te ON p.conv_id = te.conv_id AND p.node = te.source),
  c AS (SELECT conv_id, chain, row_number() OVER (PARTITION BY conv_id ORDER BY chain) AS k FROM p WHERE (conv_id, node) NOT IN (SELECT conv_id, source FROM te))
  SELECT conv_id, array_to_string(chain, '>') AS chain FROM c WHERE k <= 20""")
def j4(spark, d):
    return G.chains(*talk(spark, d), ["conv_id"]).select("conv_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query("j4_cyclic_chains", f"""WITH RECURSIVE tn AS (SELECT DISTINCT conv_id, turn AS node FROM conversations), x AS (SELECT conv_id, node, max(node) OVER (PARTITION BY conv_id) AS top FROM tn),
  te AS (SELECT a.conv_id, a.node AS source, b.node AS target FROM x a JOIN x b ON a.conv_id = b.conv_id AND (b.node = a.node + 1 OR (a.node % 2 = 0 AND b.node = a.node + 3) OR (a.node % 3 = 2 AND a.node < a.top AND b.node = a.node - 1 AND b.node > 0))),
  s AS (SELECT conv_id, node FROM tn WHERE (conv_id, node) NOT IN (SELECT conv_id, target FROM te)),
  p AS (SELECT conv_id, node, [node] AS chain FROM s UNION ALL SELECT p.conv_id, target, list_append(chain, target) FROM p JOIN te ON p.conv_id = te.conv_id AND p.node = te.source WHERE NOT list_contains(chain, target)),
  c AS (SELECT conv_id, chain, row_number() OVER (PARTITION BY conv_id ORDER BY chain) AS k FROM p WHERE (conv_id, node) NOT IN (SELECT conv_id, source FROM te))
  SELECT conv_id, array_to_string(chain, '>') AS chain FROM c WHERE k <= 20""")
def j4_cyclic(spark, d):
    """Some turns also lead back to the one before, so paths run into cycles and only simple ones count."""
    nodes, edges = talk(spark, d)
    top = nodes.groupBy("conv_id").agg(F.max("node").alias("top"))
    back = nodes.join(top, "conv_id").where("node % 3 = 2 and node < top and node > 1").select("conv_id", F.col("node").alias("source"), (F.col("node") - 1).alias("target"))
    return G.chains(nodes, edges.union(back), ["conv_id"]).select("conv_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


@query("j5_caller_chains", f"""WITH RECURSIVE {TALK}, s AS (SELECT conv_id, max(node) AS target FROM tn GROUP BY conv_id),
  p AS (SELECT conv_id, target, target AS node, [target] AS chain FROM s UNION ALL SELECT p.conv_id, p.target, te.source, list_prepend(te.source, chain) FROM p JOIN te ON p.conv_id = te.conv_id AND p.node = te.target WHERE len(chain) <= 10),
  c AS (SELECT conv_id, target, chain, row_number() OVER (PARTITION BY conv_id, target ORDER BY list_reverse(chain)) AS k FROM p WHERE len(chain) = 11 OR (conv_id, node) NOT IN (SELECT conv_id, target FROM te))
  SELECT conv_id, count(*) AS chains, max(len(chain)) AS longest FROM c WHERE k <= 20 GROUP BY conv_id""")
def j5(spark, d):
    nodes, edges = talk(spark, d)
    last = nodes.groupBy("conv_id").agg(F.max("node").alias("node"))
    out = G.caller_chains(G.known_edges(edges, nodes, ["conv_id"]), last, ["conv_id"])
    return out.groupBy("conv_id").agg(F.count("*").alias("chains"), F.max(F.size("chain")).alias("longest"))


@query("j6_entries_reaching", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node AS target, ancestor AS entry FROM up WHERE ancestor IN (SELECT node FROM n WHERE p_size % 10 = 1)")
def j6(spark, d):
    nodes, edges = tree(spark, d)
    out = G.entry_points_reaching(edges, nodes, nodes.where("p_size % 10 = 1"))
    # the SQL asks for what lies above a target: neither itself nor targets that no entry point reaches
    return out.where("not any_entry and entry <> target").select("target", "entry")


@query("j6_entries_or_any", f"""WITH RECURSIVE {TREE}, {ABOVE}, ep AS (SELECT p_partkey AS entry FROM part WHERE p_partkey > 0 AND p_type LIKE 'STANDARD%'),
  r AS (SELECT node AS target, ancestor AS entry FROM up WHERE ancestor IN (SELECT entry FROM ep) UNION SELECT entry, entry FROM ep)
  SELECT target, entry, false AS any_entry FROM r UNION ALL SELECT node, NULL, true FROM n WHERE node NOT IN (SELECT target FROM r) AND EXISTS (SELECT 1 FROM ep)""")
def j6_or_any(spark, d):
    nodes, edges = tree(spark, d)
    marked = table(spark, d, "part").where("p_partkey > 0 and p_type like 'STANDARD%'").select(F.col("p_partkey").alias("node"))
    return G.entry_points_reaching(edges, nodes, marked)


@query("j7_first_edge_paths", f"""WITH RECURSIVE {TALK}, f AS (SELECT conv_id, source, min(target) AS target FROM te GROUP BY conv_id, source),
  p AS (SELECT conv_id, node AS start, node, 1 AS steps FROM tn WHERE (conv_id, node) NOT IN (SELECT conv_id, target FROM te) UNION ALL SELECT p.conv_id, start, target, steps + 1 FROM p JOIN f ON p.conv_id = f.conv_id AND p.node = f.source)
  SELECT conv_id, start, max(steps) AS steps FROM p GROUP BY conv_id, start""")
def j7(spark, d):
    return G.first_edge_paths(*talk(spark, d), ["conv_id"]).select("conv_id", "start", F.size("path").alias("steps"))


@query("j8_backward_traces", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node AS start, max(ancestor) AS root FROM up WHERE ancestor IN (SELECT node FROM n WHERE p_size % 4 = 0) GROUP BY node")
def j8(spark, d):
    return _backward(*tree(spark, d), "true")


def _backward(nodes, edges, which):
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    hit = nodes.where("p_size % 4 = 0").select("node", F.lit(1).alias("priority"))
    starts = nodes.where(which).select(F.col("node").alias("start"))
    own = nodes.where("p_size % 4 = 0").select("node").join(dealt(starts.withColumnRenamed("start", "node")), "node", "left_semi")
    lifted = own.join(dealt(back.withColumnRenamed("source", "node")), "node").select(F.col("node").alias("start"), "target")
    t = G.traces(back, starts.join(dealt(own.withColumnRenamed("node", "start")), "start", "left_anti"), hit, depth=DEEP)
    t2 = G.traces(back, lifted.select(F.col("target").alias("start")).distinct(), hit, depth=DEEP).withColumnRenamed("start", "target").join(dealt(lifted), "target")
    both = t.select("start", "path", "priority").union(t2.select("start", "path", "priority"))
    return both.where("priority = 1").select("start", F.element_at("path", -1).alias("root"))


@query("j9_forward_traces", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT ancestor AS start, count(*) AS leaves FROM up WHERE node NOT IN (SELECT source FROM e) GROUP BY ancestor")
def j9(spark, d):
    nodes, edges = tree(spark, d)
    return _forward(nodes.join(edges.select(F.col("source").alias("node")), "node", "left_semi"), edges, "true")


def _forward(nodes, edges, which):
    none = nodes.where("false").select("node", F.lit(1).alias("priority"))
    t = G.traces(edges, nodes.where(which).select(F.col("node").alias("start")), none, depth=DEEP, states=None, best=None)
    return t.groupBy("start").agg(F.count("*").alias("leaves"))


def _flow(spark, d):
    """A method for each part, called by the part above it: it copies its parameter to `a` and passes `a` on."""
    nodes, edges = tree(spark, d)
    name = lambda c: F.concat(F.lit("m"), c)
    copies = nodes.select(name("node").alias("method"), F.lit("a").alias("left"), F.lit("PARAM:0").alias("right"), F.col("p_size").alias("offset"))
    none = nodes.where("false")
    loads = none.select(F.lit("").alias("method"), F.lit("").alias("target"), F.lit("").alias("source_field"), "p_size").withColumnRenamed("p_size", "offset")
    stores = loads.withColumnRenamed("target", "target_field").withColumnRenamed("source_field", "value")
    calls = edges.select(name("source").alias("method"), name("target").alias("callee"), F.lit(99).alias("offset"), F.lit(None).cast("string").alias("receiver"), F.array(F.lit("a")).alias("args"), F.lit("r").alias("result"))
    methods = nodes.select(name("node").alias("method"), (F.col("p_size") % 10 == 1).alias("entry"), F.lit(1).alias("n_params")).join(calls.select(F.col("callee").alias("method"), F.lit(True).alias("called")), "method", "left").na.fill(False, ["called"])
    starts = nodes.select(F.col("node").alias("start"), name("node").alias("method"), F.lit("a").alias("token"), F.lit(100).alias("offset"))
    return V.flow_edges(copies, loads, stores, calls), starts, methods, calls


FLOW = """en AS (SELECT node FROM n WHERE p_size % 10 = 1),
  r AS (SELECT n.node AS start, CASE WHEN n.node IN (SELECT node FROM en) THEN n.node ELSE coalesce((SELECT max(ancestor) FROM up WHERE up.node = n.node AND ancestor IN (SELECT node FROM en)), least(n.node, coalesce((SELECT min(ancestor) FROM up WHERE up.node = n.node), n.node))) END AS root FROM n)"""


@query("j8_value_flow", f"WITH RECURSIVE {TREE}, {ABOVE}, {FLOW} SELECT start, 'm' || root AS root, CASE WHEN root IN (SELECT node FROM en) THEN 'entry' ELSE 'no_caller' END AS kind FROM r")
def j8_flow(spark, d):
    edges, starts, methods, _ = _flow(spark, d)
    t = V.traces_to_roots(edges, starts, methods, depth=2 * DEEP, best=1)
    return t.select("start", F.element_at("path", -1)["method"].alias("root"), F.col("root").alias("kind"))


@query("j9_round_trips", f"WITH RECURSIVE {TREE}, {ABOVE}, {FLOW} SELECT start, 'm' || root AS root, root <> start AS forward FROM r")
def j9_trips(spark, d):
    t = V.round_trips(*_flow(spark, d), depth=2 * DEEP, best=1, forward_depth=2 * DEEP)
    return t.select("start", F.element_at("path", -1)["method"].alias("root"), "forward")


@query("j8_field_flow", f"""WITH RECURSIVE {TREE}, {ABOVE}, h AS (SELECT node AS start, node AS anc FROM n UNION ALL SELECT node, ancestor FROM up), top AS (SELECT start, min(anc) AS top FROM h GROUP BY start),
  s AS (SELECT h.start, max(anc) AS anc FROM h JOIN n ON n.node = anc WHERE p_size % 4 = 1 GROUP BY h.start)
  SELECT top.start, CASE WHEN s.anc IS NULL OR top.start = top THEN 'm' || top ELSE 'm' || s.anc END AS root, CASE WHEN s.anc IS NULL OR top.start = top THEN 'no_caller' ELSE 'alloc' END AS kind FROM top LEFT JOIN s ON s.start = top.start""")
def j8_fields(spark, d):
    """A method for each part, called through an interface by the part above it: it reads a field of an alias of its parameter, and some put into that field what a
    library call makes of a new object."""
    nodes, edges = tree(spark, d)
    name = lambda c: F.concat(F.lit("m"), c)
    own = nodes.where("p_size % 4 = 1")
    copies = nodes.select(name("node").alias("method"), F.lit("b").alias("left"), F.lit("PARAM:0").alias("right"), F.lit(10).alias("offset"))
    loads = nodes.select(name("node").alias("method"), F.lit("x").alias("target"), F.lit("HEAP(b):f").alias("source_field"), F.lit(50).alias("offset"))
    stores = own.select(name("node").alias("method"), F.lit("HEAP(PARAM:0):f").alias("target_field"), F.lit("r").alias("value"), F.lit(5).alias("offset"))
    call = lambda df, caller, callee, offset, arg, result: df.select(name(caller).alias("method"), callee.alias("callee"), offset.alias("offset"), F.lit(None).cast("string").alias("receiver"), F.array(F.lit(arg)).alias("args"), F.lit(result).alias("result"))
    place = (60 + F.col("target") % 3).cast("int")
    calls = call(edges, "source", F.lit("Step#run"), place, "b", "done").unionByName(call(own, "node", F.lit("lib#wrap"), F.lit(4), "src", "r")).unionByName(call(own, "node", F.lit("K#<init>"), F.lit(3), "none", "src"))
    targets = edges.select(name("source").alias("method"), place.alias("offset"), name("target").alias("callee"))
    flow = V.flow_edges(copies, loads, stores, calls, targets=targets, modelled=copies.select("method"))
    methods = nodes.select(name("node").alias("method"), F.lit(False).alias("entry")).join(targets.select(F.col("callee").alias("method"), F.lit(True).alias("called")), "method", "left").na.fill(False, ["called"])
    starts = nodes.select(F.col("node").alias("start"), name("node").alias("method"), F.lit("x").alias("token"), F.lit(100).alias("offset"))
    t = V.traces_to_roots(flow, starts, methods, depth=2 * DEEP, best=1, copies=copies, sites=V.call_sites(calls, targets))
    return t.select("start", F.element_at("path", -1)["method"].alias("root"), F.col("root").alias("kind"))


@query("j10_value_chains", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT n.node AS start, 'm' || least(n.node, coalesce(min(ancestor), n.node)) AS root, 2 * count(ancestor) AS depth FROM n LEFT JOIN up ON up.node = n.node GROUP BY n.node")
def j10_chains(spark, d):
    """Inside the chain of calls from the top of the tree to each part."""
    edges, starts, _, _ = _flow(spark, d)
    nodes, tree_edges = tree(spark, d)
    above = G.closure(tree_edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    way = nodes.select("node", F.col("node").alias("ancestor")).union(above).groupBy("node").agg(F.array_sort(F.collect_list("ancestor")).alias("ids"))
    chains = starts.join(way, F.col("start") == F.col("node")).select("start", F.transform("ids", lambda i: F.concat(F.lit("m"), i)).alias("chain"), "token", "offset")
    t = V.chain_traces(edges, chains, depth=2 * DEEP)
    return t.select("start", F.element_at("path", -1)["method"].alias("root"), "depth")


@query("j11_points_to", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node, count(*) AS n_roots FROM (SELECT node, ancestor AS root FROM up WHERE ancestor IN (SELECT node FROM n WHERE p_size % 4 = 1) UNION SELECT node, node FROM n WHERE p_size % 4 = 1) GROUP BY node")
def j11(spark, d):
    nodes, edges = tree(spark, d)
    sets, _ = G.points_to(edges, nodes.where("p_size % 4 = 1").select("node", F.col("node").alias("root")))
    return sets.select("node", F.size("roots").alias("n_roots"))


@query("j11_points_to_index", f"""WITH RECURSIVE {TREE}, {ABOVE}, h AS (SELECT node, node AS root FROM n UNION ALL SELECT node, ancestor FROM up),
  r AS (SELECT h.node, list(DISTINCT 'ALLOC:K' || (root // 2) ORDER BY 'ALLOC:K' || (root // 2)) AS roots FROM h JOIN n ON n.node = root WHERE p_size % 4 = 1 GROUP BY h.node)
  SELECT 'm' || node AS method, array_to_string(CASE WHEN len(roots) > 3 THEN list_concat(['UNKNOWN'], roots[1:2]) ELSE roots END, ',') AS roots, len(roots) > 3 AS truncated FROM r""")
def j11_index(spark, d):
    """A method for each part: it is called by the part above it with that part's own parameter, may put a new object into a field of a field of it, and reads that field."""
    nodes, edges = tree(spark, d)
    name, field = lambda c: F.concat(F.lit("m"), c), F.lit("HEAP(HEAP(PARAM:0):box):item")
    own = nodes.where("p_size % 4 = 1")
    copies = own.select(name("node").alias("method"), F.lit("made").alias("left"), F.lit("fresh").alias("right"))
    loads = nodes.select(name("node").alias("method"), F.lit("x").alias("target"), field.alias("source_field"))
    stores = own.select(name("node").alias("method"), field.alias("target_field"), F.lit("made").alias("value"))
    call = lambda df, caller, callee, args, result: df.select(name(caller).alias("method"), callee.alias("callee"), F.lit(1).alias("offset"), F.lit(None).cast("string").alias("receiver"), args.alias("args"), result.alias("result"))
    made = call(own, "node", F.concat(F.lit("K"), F.expr("node div 2"), F.lit("#<init>")), F.array().cast("array<string>"), F.lit("fresh"))
    calls = call(edges, "source", name("target"), F.array(F.lit("PARAM:0")), F.lit(None).cast("string")).unionByName(made)
    out = P.points_to_index(copies, loads, stores, calls, most=3).where("token = 'x'")
    return out.select("method", F.array_join("roots", ",").alias("roots"), "truncated")


@query("j12_type_closure", f"WITH RECURSIVE {TREE}, {ABOVE} SELECT node, ancestor FROM up")
def j12(spark, d):
    _, edges = tree(spark, d)
    return G.closure(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


@query("j12_related_types", f"""WITH {TREE}, k AS (SELECT CAST(target AS VARCHAR) AS c, CAST(source AS VARCHAR) AS p, CASE WHEN p_size % 2 = 0 THEN 'IMPL' ELSE 'EXTE' END AS kind FROM e JOIN n ON node = target)
  SELECT c AS type, p AS other, 'parent' AS relation, kind FROM k UNION ALL SELECT p, c, 'child', kind FROM k""")
def j12_related(spark, d):
    nodes, edges = tree(spark, d)
    kind = nodes.select(F.col("node").alias("target"), F.when(F.col("p_size") % 2 == 0, "IMPL").otherwise("EXTE").alias("kind"))
    return G.related_types(edges.join(kind, "target").select(F.col("target").cast("string").alias("source"), F.col("source").cast("string").alias("target"), "kind"))


@query("j13_alias_classes", f"""WITH RECURSIVE {TREE}, g AS (SELECT source, target FROM e WHERE target % 4 <> 0),
  up AS (SELECT target AS node, source AS ancestor FROM g UNION ALL SELECT up.node, g.source FROM up JOIN g ON up.ancestor = g.target)
  SELECT node, min(ancestor) AS component FROM (SELECT node, ancestor FROM up UNION ALL SELECT DISTINCT source, source FROM g) GROUP BY node""")
def j13(spark, d):
    _, edges = tree(spark, d)
    return connected_components(edges.where("target % 4 <> 0"), "source", "target")


@query("j14_neighbours", f"WITH {TREE} SELECT source AS node, target AS other, 'dependency' AS direction FROM e UNION SELECT target, source, 'dependent' FROM e")
def j14(spark, d):
    return G.neighbours(tree(spark, d)[1])


@query("j15_chain_rows", f"""SELECT conv_id, turn AS node, CASE WHEN turn = min(turn) OVER w THEN 'SOURCE' WHEN turn = max(turn) OVER w THEN 'SINK' ELSE 'PROPAGATOR' END AS role FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def j15(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("chain"))
    return G.chain_rows(c, ["conv_id"])[0].select("conv_id", "node", "role")


@query("j16_dispatch_edges", """WITH c AS (SELECT l_orderkey AS caller, l_partkey AS callee FROM lineitem),
  v AS (SELECT a.p_partkey AS callee, b.p_partkey AS override FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0)
  SELECT caller, callee FROM c UNION SELECT caller, override FROM c JOIN v USING (callee)""")
def j16(spark, d):
    return _dispatch(spark, d, table(spark, d, "lineitem"))


def _dispatch(spark, d, lines):
    calls = lines.select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("callee"), F.lit("CALL").alias("kind")).distinct()
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "I").otherwise("C"), "p_brand").alias("cls"),
                                       F.lit("run").alias("name"), F.col("p_size").alias("arity"), (F.col("p_partkey") % 3 == 0).alias("abstract"), F.lit(True).alias("virtual"))
    above = m.select(F.concat(F.lit("C"), F.substring("cls", 2, 99)).alias("node"), F.concat(F.lit("I"), F.substring("cls", 2, 99)).alias("ancestor")).distinct()
    return G.dispatch_edges(calls, m, above).select("caller", "callee")


@query("j17_entry_points", "SELECT p_partkey AS method, CASE WHEN p_type LIKE 'STANDARD%' THEN 'standard' END AS rule FROM part WHERE p_type LIKE 'STANDARD%' UNION ALL SELECT p_partkey, 'size7' FROM part WHERE p_size = 7")
def j17(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), F.col("p_brand").alias("cls"), F.col("p_size").cast("string").alias("name"), F.array(F.substring_index("p_type", " ", 1)).alias("cls_annotations"), F.array("p_brand").alias("annotations"))
    rules = table(spark, d, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "standard").otherwise("size7").alias("rule"), F.when(F.col("r_regionkey") == 0, "STANDARD").alias("cls_annotation"),
        F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("string").alias("ancestor"), F.when(F.col("r_regionkey") == 1, "7").alias("name"))
    above = m.select(F.col("cls").alias("node"), F.col("cls").alias("ancestor")).distinct()
    return G.entry_points(m, rules, above)


@query("j17_framework_entries", """SELECT p_partkey AS method, 'spring' AS framework FROM part WHERE p_size % 5 = 0 AND p_type LIKE '%STEEL' UNION ALL SELECT p_partkey, 'jaxrs' FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 'servlet' FROM part WHERE p_brand LIKE '%1' AND p_size % 2 = 1 UNION ALL SELECT p_partkey, 'main' FROM part WHERE p_brand LIKE '%2' AND p_size < 2""")
def j17_frameworks(spark, d):
    """Brands are classes: some are controllers, some servlets; a method's name and annotations follow from its size and type."""
    size, brand = F.col("p_size"), F.col("p_brand")
    servlet, main = brand.endswith("1"), brand.endswith("2")
    name = F.when(servlet & (size % 2 == 1), "doGet").when(main, "main").otherwise("run")
    on = F.array_compact(F.array(F.when(F.col("p_type").endswith("STEEL"), FW.SPRING_MAPPINGS[1]), F.when(size % 7 == 0, FW.PATH[0])))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), brand.alias("cls"), name.alias("name"), size.cast("int").alias("n_params"), on.alias("annotations"), F.lit(None).cast("array<string>").alias("meta"),
                                       F.array_compact(F.array(F.when(size % 5 == 0, FW.SPRING_CONTROLLERS[1]))).alias("cls_annotations"), F.lit(True).alias("public"), main.alias("static"), F.lit(None).cast("array<string>").alias("types"), F.lit(False).alias("overrides"))
    above = m.where(F.col("cls").endswith("1")).select(F.col("cls").alias("node"), F.lit(FW.HTTP_SERVLETS[0]).alias("ancestor")).distinct()
    return FW.framework_entry_points(m, above)

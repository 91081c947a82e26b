"""Taint and data flow as relations over what parsing tells of each file (`syntax.facts`).

Taint is reachability over assignments, arguments and results, level by level from the sources; a node keeps the node before it on the first of its
shortest ways, so that a finding has its flow. Data flow is the least fixpoint of states in a lattice of four values: a fact (node,
variable) goes on to the next nodes unless the node assigns the variable, and an assignment passes on what its expression uses. Ways that meet take
the maximum, so what holds at least a value is what the assignments of that value reach: a loop for each value. An expression's value is the
maximum of a constant and of variables', so rows express it.

Only files, and functions, that have both a source and a sink take part in findings. Neither leaves its graph: one shuffle makes each file's graph (taint) or
each function's (data flow, what execution can reach) a row, with the next nodes of each, and a round is an expression on that row. Reachability ends within
one expression, as it has at most as many rounds as nodes with a next one. Data flow has `STEPS` rounds in a pass, and functions that are done leave, so neither
rounds nor what is known is shuffled. A row is as large as its file's facts.
Nulls do not occur in facts; a file that does not parse has none of these; equal rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint

CLEAN, SANITIZED, UNKNOWN, TAINTED = range(4)  # a join is the maximum
ARROW = " -> "
RESULT = ":<return>"
#: Values that an assignment's constant part can have, above CLEAN.
FLOORS = (SANITIZED, TAINTED)
FUNCTION = ["path", "scope"]
#: Rounds of data flow in a pass over the functions.
STEPS = 16


def bare(name: Column) -> Column:
    """A scope's name as the file has it."""
    return F.substring_index(name, "#", 1)


# Reachability -----------------------------------------------------------------------------------------------------------------


def _ahead(graph: DataFrame, on: list[str], kept: tuple[str, ...]) -> DataFrame:
    """A row for each value of `on`: `ahead`, the sorted next nodes (`dst`) of each node (`src`) of rows of kind `edge`, and for each other kind in `kept`
    its distinct rows (src, dst, row), sorted, as an array of that name."""
    of_src = graph.repartition(*on).groupBy(*on, "kind", "src").agg(F.collect_list(F.struct("dst", "row")).alias("rows"))
    each = of_src.select(*on, F.struct("kind", "src", F.array_sort(F.array_distinct("rows")).alias("rows")).alias("x"))
    packed = each.groupBy(*on).agg(F.collect_list("x").alias("all"))
    ahead = F.expr("map_from_entries(transform(filter(all, x -> x.kind = 'edge'), x -> struct(x.src, array_distinct(x.rows.dst))))")
    other = [F.expr(f"array_sort(flatten(transform(filter(all, x -> x.kind = '{k}'), x -> transform(x.rows, r -> struct(x.src AS src, r.dst AS dst, r.row AS row)))))").alias(k) for k in kept]
    return packed.select(*on, ahead.alias("ahead"), *other)


def _reach(start: str) -> Column:
    """nodes, befores: what `ahead` reaches from the nodes `start`, themselves first, and the place of the node before each (-1 for a start). A level's nodes
    come in the order of the ways to them, so the first way to a node is the least of its shortest."""
    found = "flatten(transform(sequence(acc.low, size(acc.nodes) - 1), j -> transform(coalesce(try_element_at(ahead, acc.nodes[j]), slice(acc.nodes, 1, 0)), d -> struct(d AS node, j AS before))))"
    fresh = f"filter({found}, c -> NOT array_contains(acc.nodes, c.node))"
    first = f"transform(array({fresh}), all -> transform(array(all.node), names -> filter(all, (c, k) -> array_position(names, c.node) = k + 1))[0])[0]"
    step = f"transform(array({first}), x -> struct(concat(acc.nodes, x.node) AS nodes, concat(acc.befores, x.before) AS befores, size(acc.nodes) AS low))[0]"
    return F.expr(f"aggregate(sequence(0, size(ahead)), struct({start} AS nodes, transform({start}, x -> -1) AS befores, 0 AS low), (acc, i) -> if(acc.low = size(acc.nodes), acc, {step}))")


def reachable(facts: DataFrame) -> DataFrame:
    """path, scope, node: the nodes of each function's control-flow graph that execution can reach from its first one."""
    graph = facts.where("kind = 'cfg'").select(*FUNCTION, F.lit("edge").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("row"))
    own = _ahead(graph, FUNCTION, ()).withColumn("start", F.array(F.lit(0).cast("long"))).withColumn("reach", _reach("start"))
    return own.select(*FUNCTION, F.explode("reach.nodes").alias("node"))


# Taint ------------------------------------------------------------------------------------------------------------------------


def _files(facts: DataFrame, *kinds: str) -> DataFrame:
    """A row for each file: `ahead` of its edges, and `seed` (src: the node, dst: the source), `sinkarg`, `param` (src: the scope), as far as asked for."""
    is_k = lambda k: F.col("kind") == k
    src = F.when(is_k("edge") | is_k("param"), F.col("scope")).when(is_k("seed"), F.col("name")).otherwise(F.col("text"))
    dst = F.when(is_k("seed"), F.col("text")).otherwise(F.col("name"))
    row = F.when(is_k("sinkarg") | is_k("param"), F.struct("scope", "line", "a", "b"))
    own = facts.where(F.col("kind").isin("edge", *kinds)).select("path", "kind", src.alias("src"), dst.alias("dst"), row.alias("row"))
    return _ahead(own, ["path"], kinds)


def _from_seeds(files: DataFrame) -> DataFrame:
    """The files with `reach`, what their sources reach, and `sources`, the first source of each node that has some."""
    first = F.expr("filter(seed, (x, i) -> i = 0 OR seed[i - 1].src <> x.src)")
    own = files.withColumn("seed", first).withColumn("start", F.col("seed.src")).withColumn("sources", F.col("seed.dst"))
    return own.withColumn("reach", _reach("start"))


def tainted(facts: DataFrame) -> DataFrame:
    """path, node (scope:name) of everything that data from a source may reach."""
    own = _from_seeds(_files(facts, "seed").where(F.size("seed") > 0))
    return own.select("path", F.explode("reach.nodes").alias("node"))


def taints(facts: DataFrame) -> DataFrame:
    """path, scope, name, line, a, b, c, text: each argument of a sink that tainted data reaches; b is 1 for a source itself, text the flow, c its length."""
    own = _from_seeds(_files(facts, "seed", "sinkarg").where(F.size("sinkarg") > 0))
    aims = own.select("path", "reach.nodes", "reach.befores", "sources", F.explode("sinkarg").alias("x"))
    aims = aims.withColumn("at", F.expr("int(array_position(nodes, x.src)) - 1")).where("x.row.b <> 0 OR at >= 0")
    back = "aggregate(sequence(0, size(nodes)), struct(array(nodes[at]) AS way, at AS first), (acc, i) -> if(befores[acc.first] < 0, acc, struct(concat(array(nodes[befores[acc.first]]), acc.way) AS way, befores[acc.first] AS first)))"
    shown = lambda x: F.when(x.endswith(RESULT), F.concat(bare(F.substring_index(x, ":", 1)), F.lit("()"))).otherwise(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)))
    aims = aims.withColumn("far", F.when(F.col("x.row.b") == 0, F.expr(back)))
    call = F.array(F.concat("x.dst", F.lit("()")))
    flow = F.when(F.col("x.row.b") != 0, F.concat(F.array("x.src"), call)).otherwise(F.concat(F.expr("array(sources[far.first])"), F.transform("far.way", shown), call))
    own = aims.withColumn("flow", flow)
    return own.select("path", "x.row.scope", F.col("x.dst").alias("name"), "x.row.line", "x.row.a", "x.row.b", F.size("flow").cast("long").alias("c"), F.array_join("flow", ARROW).alias("text"))


def summaries(facts: DataFrame) -> DataFrame:
    """path, scope, a: the parameters that a function's result may carry, by place; -1 for a result that comes from a source."""
    turned = facts.withColumn("_to", F.col("scope"))
    turned = turned.withColumn("scope", F.when(F.col("kind") == "edge", F.col("name")).otherwise(F.col("scope"))).withColumn("name", F.when(F.col("kind") == "edge", F.col("_to")).otherwise(F.col("name"))).drop("_to")
    # One row more for each file, of no scope, has its results that come from sources: facts are read once.
    always = F.expr(f"array_distinct(transform(filter(seed, x -> endswith(x.src, '{RESULT}')), x -> struct(substring_index(x.src, ':', 1) AS scope, -1L AS a)))")
    own = _files(turned, "param", "seed").select("path", "ahead", "param", always.alias("always"), F.explode(F.expr("array_append(array_distinct(param.src), '')")).alias("scope"))
    own = own.withColumn("start", F.expr(f"filter(array(concat(scope, '{RESULT}')), x -> map_contains_key(ahead, x))")).withColumn("reach", _reach("start"))
    carried = "transform(filter(param, p -> p.src = scope AND array_contains(reach.nodes, concat(scope, ':', p.dst))), p -> struct(scope AS scope, p.row.a AS a))"
    return own.select("path", F.explode(F.expr(f"if(scope = '', always, {carried})")).alias("x")).select("path", "x.scope", "x.a")


# Data flow --------------------------------------------------------------------------------------------------------------------

def _functions(facts: DataFrame, floors: tuple[int, ...], aims: bool) -> DataFrame:
    """A row for each function: its nodes by number with next nodes, names defined and (used, name), where each floor starts from, the sinks' variables and sources."""
    # One list a group is much cheaper than a set for each kind. An edge's end has a row too, so nodes are numbered without gaps.
    ends = F.when(F.col("kind") == "cfg", F.array("a", "b")).otherwise(F.array("a"))
    own = facts.where(F.col("kind").isin("cfg", "def", "use", *["flowarg"] * aims)).select(*FUNCTION, "kind", "name", "line", "end_line", "b", "c", "text", F.posexplode(ends).alias("_end", "node"))
    row = F.struct(F.when(F.col("_end") == 0, F.col("kind")).alias("kind"), "name", "line", "end_line", "b", "c", "text")
    nodes = own.repartition(*FUNCTION).groupBy(*FUNCTION, "node").agg(F.collect_list(row).alias("rows"))
    of = lambda cond, x: f"array_distinct(transform(filter(rows, r -> {cond}), r -> {x}))"
    sink = "r.name AS name, r.line AS line, r.c AS place, substring_index(r.text, '\t', 1) AS text"
    parts = {"dsts": of("r.kind = 'cfg'", "r.b"), "names": of("r.kind = 'def'", "r.name"), "uses": of("r.kind = 'use'", "struct(r.text AS used, r.name AS name)")}
    parts |= {"_aims": of("r.kind = 'flowarg' AND r.end_line = 1", f"struct(concat(node, ':', substring_index(r.text, '\t', -1)) AS state, {sink})")}
    parts |= {"_near": of(f"r.kind = 'flowarg' AND r.end_line = 0 AND r.b = {TAINTED}", f"struct({sink})")}
    parts |= {f"_from{v}": of(f"r.kind = 'def' AND r.b >= {v}", "r.name") for v in floors}
    packed = nodes.select(*FUNCTION, F.struct("node", *[F.expr(x).alias(k) for k, x in parts.items()]).alias("x")).groupBy(*FUNCTION).agg(F.array_sort(F.collect_list("x")).alias("all"))
    all_of = lambda k: F.expr(f"flatten(transform(all, x -> x.{k}))").alias(k[1:])
    starts = [F.expr(f"array_distinct(flatten(transform(all, x -> flatten(transform(x._from{v}, n -> transform(x.dsts, d -> concat(d, ':', n)))))))").alias(f"from{v}") for v in floors]
    return packed.select(*FUNCTION, F.expr("transform(all, x -> struct(x.node, x.dsts, x.names, x.uses))").alias("at"), all_of("_aims"), all_of("_near"), *starts)


def _reached(functions: DataFrame) -> DataFrame:
    """The functions with the states (`node:name`) that hold, as the array `known`; `fresh` is where they start."""
    spark = functions.sparkSession
    step = f"""aggregate(sequence(1, {STEPS}), struct(known, fresh), (acc, i) -> if(size(acc.fresh) = 0, acc, struct(concat(acc.known, acc.fresh) AS known, array_except(
        flatten(transform(transform(acc.fresh, s -> struct(at[int(substring_index(s, ':', 1))] AS x, substring_index(s, ':', -1) AS name)), y ->
            flatten(transform(concat(filter(array(y.name), n -> NOT array_contains(y.x.names, n)), transform(filter(y.x.uses, u -> u.used = y.name), u -> u.name)),
                n -> transform(y.x.dsts, d -> concat(string(d), ':', n)))))), concat(acc.known, acc.fresh)) AS fresh)))"""
    todo, parts = functions.withColumn("known", F.array().cast("array<string>")), []
    while True:
        own = todo.withColumn("_s", F.expr(step)).withColumn("known", F.col("_s.known")).withColumn("fresh", F.col("_s.fresh")).drop("_s").withColumn("done", F.size("fresh") == 0)
        own = fixpoint.kept(own.withColumn("at", F.when(~F.col("done"), F.col("at"))), "states", "done")
        parts.append(own.where("done").drop("done", "at", "fresh"))
        todo = own.where("not done").drop("done")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def states(facts: DataFrame) -> DataFrame:
    """path, scope, node, name, value of all functions: what a variable may hold before a node, above CLEAN."""
    own = _functions(facts, FLOORS, aims=False)
    starts = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"from{v}").alias("fresh")) for v in FLOORS])).alias("x")
    reached = _reached(own.select(*FUNCTION, "at", starts).select(*FUNCTION, "at", "x.value", "x.fresh").where(F.size("fresh") > 0))
    each = reached.select(*FUNCTION, "value", F.explode("known").alias("s")).select(*FUNCTION, F.substring_index("s", ":", 1).cast("long").alias("node"), F.substring_index("s", ":", -1).alias("name"), "value")
    return each.groupBy(*FUNCTION, "node", "name").agg(F.max("value").alias("value"))


def sinks(facts: DataFrame) -> DataFrame:
    """path, scope, name, line, text: a sink with a tainted argument, one for each line and weakness (`text`) of a function, by its first such call."""
    own = _functions(facts, (TAINTED,), aims=True).withColumnRenamed(f"from{TAINTED}", "fresh").where((F.size("near") > 0) | ((F.size("aims") > 0) & (F.size("fresh") > 0)))
    hit = F.expr("concat(near, transform(filter(aims, a -> array_contains(known, a.state)), a -> struct(a.name, a.line, a.place, a.text)))")
    found = _reached(own).select(*FUNCTION, F.explode(hit).alias("x")).select(*FUNCTION, "x.name", "x.line", "x.place", "x.text")
    return found.groupBy(*FUNCTION, "line", "text").agg(F.min_by("name", "place").alias("name"))

"""Graph and fixpoint operators (OP-G*). Edges are (src, dst) with optional kind and weight; nodes are (id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import grow, relax
from graphloom.plans.ordered import RANGE, running_sum
from graphloom.store import drop_table, materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions (OP-G1)."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), zero where there is no edge (OP-A3). One pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    return nodes.select("id").join(sums, "id", "left").na.fill(0, ["out_degree", "in_degree"])


def csr(nodes: DataFrame, edges: DataFrame, per_range: int = RANGE) -> DataFrame:
    """(id, row_ptr, degree, neighbours): adjacency in the order of ids, neighbours sorted, repeats kept (OP-G2, OP-W9).

    row_ptr is a prefix sum in two levels: within ranges of ids, and over the ranges' sums.
    """
    adjacency = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
    rows = nodes.select("id").join(adjacency, "id", "left").withColumn("degree", F.size(F.coalesce("neighbours", F.array())).cast("long"))
    out = running_sum(rows, "id", "degree", "row_ptr", rows=max(1, per_range))
    return out.select("id", "row_ptr", "degree", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))


def neighbours(edges: DataFrame, node: object) -> DataFrame:
    """Targets of one node's edges (OP-G3); the filter reaches the scan."""
    return edges.where(F.col("src") == F.lit(node)).select("dst")


def reach(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id) of what the roots (id) lead to, roots included; roots that are no node are ignored (OP-G4, OP-G6, OP-G19)."""
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    start = roots.select("id")
    if nodes is not None:
        start = start.join(nodes.select("id"), "id", "left_semi")
    return grow(start, lambda f: f.join(edges, f["id"] == edges["src"]).select(F.col("dst").alias("id")), ["id"])


def levels(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level): fewest edges from a root, -1 if there is no way (OP-G5, OP-D2)."""
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    start = roots.select("id", F.lit(0).alias("level"))
    found = grow(start, lambda f: f.join(edges, f["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("level") + 1).alias("level")), ["id"])
    return nodes.select("id").join(found, "id", "left").na.fill(-1, ["level"])


def closure(edges: DataFrame, starts: DataFrame | None = None, reflexive: bool = False) -> DataFrame:
    """(src, dst) for which there is a way, of one edge at least unless reflexive (OP-G21). `starts` bounds the sources.

    As large as the answer: sources times what each reaches; give starts where not every source is asked for.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    first = edges if starts is None else edges.join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    out = grow(first, lambda f: f.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")), ["src", "dst"])
    if not reflexive:
        return out
    own = nodes_of(edges) if starts is None else starts.select("id")
    return out.unionByName(own.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def peel(nodes: DataFrame, edges: DataFrame, longest: bool = True) -> DataFrame:
    """(id, level): longest way from a node without incoming edges; null on and behind cycles (OP-G8, OP-G9, OP-Y14).

    Rounds remove the nodes whose predecessors are all gone, so as many rounds as the longest way. Edges whose source
    or target is no node are ignored; a self-loop is a cycle.
    """
    nodes = materialize(nodes.select("id").distinct(), "nodes")
    edges = edges.select("src", "dst").distinct().join(nodes, F.col("src") == nodes["id"], "left_semi").join(nodes, F.col("dst") == nodes["id"], "left_semi")
    left, done, level = materialize(edges, "edges"), [], 0
    rest = nodes
    while True:
        free = materialize(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"), "free")
        if free.isEmpty():
            break
        done.append(free.select("id", F.lit(level).alias("level")))
        rest = materialize(rest.join(free, "id", "left_anti"), "rest")
        left = materialize(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
        level += 1
    out = rest.select("id", F.lit(None).cast("int").alias("level"))
    for part in done:
        out = out.unionByName(part)
    return out


def is_acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: acyclic, on_cycle, the nodes on or behind a cycle (OP-G7)."""
    left = F.coalesce(F.sum(F.col("level").isNull().cast("long")), F.lit(0))
    return peel(nodes, edges).agg((left == 0).alias("acyclic"), left.alias("on_cycle"))


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components by their least id, singletons included (OP-G10, OP-G11).

    Rounds of colouring: a node takes the least id that reaches it; those that also reach that id, within its colour, are
    its component. Components go, and colours are drawn anew on what is left.
    """
    nodes = materialize(nodes.select("id").distinct(), "nodes")
    edges = materialize(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    parts = []
    while not nodes.isEmpty():
        start = nodes.select("id", F.col("id").alias("colour"))
        e = edges
        colours = materialize(relax(start, lambda f, e=e: f.join(e, f["id"] == e["src"]).select(F.col("dst").alias("id"), "colour"), ["id"], "colour"), "colours")
        inside = e.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inside = materialize(inside, "inside")
        roots = colours.where("id = colour").select("id", F.col("id").alias("component"))
        back = grow(roots, lambda f, i=inside: f.join(i, f["id"] == i["dst"]).select(F.col("src").alias("id"), "component"), ["id"])
        back = materialize(back, "component")
        parts.append(back)
        nodes = materialize(nodes.join(back, "id", "left_anti"), "nodes")
        gone = back.select("id")
        edges = materialize(edges.join(gone, edges["src"] == gone["id"], "left_anti").join(gone, edges["dst"] == gone["id"], "left_anti"), "edges")
    out = parts[0] if parts else nodes.select("id", F.col("id").alias("component"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def condense(edges: DataFrame, components: DataFrame, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Components (component, members, label) and the distinct edges between different ones (OP-G12, OP-V13).

    label: the member's name, or `[cycle: a, b]` in the order of names. A component's members are one list, as its
    label needs them.
    """
    label = name if name is not None else F.col("id").cast("string")
    groups = components.withColumn("__n", label).groupBy("component").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("__n")).alias("names"))
    groups = groups.select("component", "members", F.when(F.col("members") == 1, F.col("names")[0]).otherwise(F.concat(F.lit("[cycle: "), F.array_join("names", ", "), F.lit("]"))).alias("label"))
    a = components.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return groups, edges.join(a, "src").join(b, "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def shortest(nodes: DataFrame, edges: DataFrame, source: object) -> DataFrame:
    """(id, distance) of the least sum of weights from source, null if there is no way (OP-G13, OP-G14, OP-G15).

    Weights may be negative; a negative cycle raises after as many rounds as there are nodes.
    """
    n = nodes.count()
    edges = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")
    start = nodes.where(F.col("id") == F.lit(source)).select("id", F.lit(0).cast("long").alias("distance"))
    found = relax(start, lambda f: f.join(edges, f["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance")), ["id"], "distance", n + 1)
    return nodes.select("id").join(found, "id", "left")


def dominators(edges: DataFrame, entry: object) -> DataFrame:
    """(node, dominator) for nodes that the entry reaches, themselves included (OP-G16, OP-D5, OP-U7).

    A node's dominators are itself and what dominates all of its predecessors. Rounds take that from the predecessors that
    are reached so far, until nothing changes: a dominator stays if as many predecessors have it as there are. The rows
    of a round are the dominators of all edges' sources, so they follow the answer and the edges, not the square of the nodes.
    """
    inner = materialize(edges.select("src", "dst").distinct().where(F.col("dst") != F.lit(entry)), "edges")
    start = edges.sparkSession.createDataFrame([(entry, entry)], edges.select(F.col("src").alias("node"), F.col("src").alias("dominator")).schema)
    doms, seen = materialize(start, "doms"), None
    while True:
        known = doms.where("node = dominator").select(F.col("node").alias("src"))
        ways = inner.join(known, "src").groupBy("dst").agg(F.count("*").alias("ways"))
        had = inner.join(doms, F.col("src") == F.col("node")).groupBy("dst", "dominator").agg(F.count("*").alias("n"))
        kept = had.join(ways, "dst").where("n = ways and dominator != dst").select(F.col("dst").alias("node"), "dominator")
        own = ways.select(F.col("dst").alias("node"), F.col("dst").alias("dominator"))
        new = materialize(kept.unionByName(own).unionByName(start), "doms")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("node", "dominator").cast("decimal(38,0)"))).first())
        drop_table(doms)
        doms = new
        if now == seen:
            return doms
        seen = now


def immediate_dominators(doms: DataFrame) -> DataFrame:
    """(node, idom): the strict dominator that has most dominators itself; none for the entry (OP-G17)."""
    depth = doms.groupBy("node").count().select(F.col("node").alias("dominator"), F.col("count").alias("depth"))
    return doms.where("node != dominator").join(depth, "dominator").groupBy("node").agg(F.max_by("dominator", "depth").alias("idom"))


def reaching_definitions(preds: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    """(block, def) that hold at a block's end: what it makes, and what reaches it and is not killed (OP-G18, OP-U6).

    preds: (block, pred); gen and kill: (block, def).
    """
    preds, kill = materialize(preds.select("block", "pred").distinct(), "preds"), materialize(kill.select("block", "def").distinct(), "kill")
    step = lambda f: f.join(preds.select("pred", F.col("block").alias("to")), f["block"] == F.col("pred")).select(F.col("to").alias("block"), "def").join(kill, ["block", "def"], "left_anti")
    return grow(gen.select("block", "def"), step, ["block", "def"])


def sweep(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that roots reach, and the edges between them (OP-G19)."""
    live = materialize(reach(edges, roots, nodes), "live")
    kept = edges.join(live, edges["src"] == live["id"], "left_semi").join(live, edges["dst"] == live["id"], "left_semi")
    return nodes.join(live, "id", "left_semi"), kept


def chain_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth): edges on the longest way out of a node, null where a cycle can be reached (OP-G20)."""
    return peel(nodes, reverse(edges)).withColumnRenamed("level", "depth")


def trust(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): one for roots, else the mean of the predecessors' scores weighted by the edges (OP-G23); acyclic graphs.

    Levels are worked through in order; nodes on a cycle get no score.
    """
    order = materialize(peel(nodes, edges), "order")
    top = order.agg(F.max("level")).first()[0]
    scores = order.where("level = 0").select("id", F.lit(1.0).alias("score"))
    for level in range(1, (top or 0) + 1):
        at = order.where(F.col("level") == level).select(F.col("id").alias("dst"))
        into = edges.join(at, "dst").join(scores, F.col("src") == scores["id"])
        mean = into.groupBy("dst").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))
        scores = materialize(scores.unionByName(mean.select(F.col("dst").alias("id"), F.coalesce("score", F.lit(0.0)).alias("score"))), "scores")
    return scores


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an end of which is no node (OP-G24, OP-J2 the other way round)."""
    known = nodes.select("id").distinct()
    far = edges.join(known, edges["dst"] == known["id"], "left_anti")
    return edges.join(known, edges["src"] == known["id"], "left_anti").unionByName(far).distinct()


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes (OP-J2)."""
    known = nodes.select("id").distinct()
    return edges.join(known, edges["src"] == known["id"], "left_semi").join(known, edges["dst"] == known["id"], "left_semi")


def containing(nodes: DataFrame, contains: DataFrame, kind: str = "Module") -> DataFrame:
    """(id, owner): the nearest node of a kind on the way up, itself included; ties by the least id (OP-G32)."""
    own = nodes.where(F.col("kind") == kind).select("id", F.struct(F.lit(0).alias("depth"), F.col("id").alias("owner")).alias("at"))
    edges = materialize(contains.select("src", "dst"), "contains")
    found = relax(own, lambda f: f.join(edges, f["id"] == edges["src"]).select(F.col("dst").alias("id"), F.struct((F.col("at.depth") + 1).alias("depth"), F.col("at.owner").alias("owner")).alias("at")), ["id"], "at")
    return nodes.select("id").join(found, "id", "left").select("id", F.col("at.owner").alias("owner"))


def chase(pointers: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, last, hops): where following (src, dst), one for each src, ends; at the first repeat or after max_hops
    (OP-G29, OP-Y1). Rows whose way ends leave the loop."""
    pointers = materialize(pointers.select("src", "dst"), "pointers")
    live = materialize(starts.select("id", F.col("id").alias("last"), F.array("id").alias("seen")), "chase")
    done, hops = [], 0
    while not live.isEmpty() and (max_hops is None or hops < max_hops):
        step = live.join(pointers, live["last"] == pointers["src"], "left").withColumn("stop", F.col("dst").isNull() | F.array_contains("seen", F.col("dst")))
        step = materialize(step, "chase")
        done.append(step.where("stop").select("id", "last", (F.size("seen") - 1).alias("hops")))
        live = step.where("not stop").select("id", F.col("dst").alias("last"), F.concat("seen", F.array("dst")).alias("seen"))
        hops += 1
    out = live.select("id", "last", (F.size("seen") - 1).alias("hops"))
    for d in done:
        out = out.unionByName(d)
    return out


def witness_cycle(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, path) with a shortest cycle through the least node of each component of several nodes (OP-G22).

    Paths are grown from that node inside its component, one to each node, so they are as many as nodes.
    """
    several = components.groupBy("component").count().where("count > 1").select("component")
    inside = components.join(several, "component")
    e = edges.join(inside.select(F.col("id").alias("src"), "component"), "src").join(inside.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2 and src != dst").select("src", "dst").distinct()
    e = materialize(e, "edges")
    first = several.select("component", F.col("component").alias("id"), F.array("component").alias("path"))
    ways = grow(first, lambda f: f.join(e, f["id"] == e["src"]).groupBy("component", F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")), ["component", "id"])
    back = ways.join(e, ways["id"] == e["src"]).where("dst = component").select("component", F.concat("path", F.array("dst")).alias("path"))
    return back.groupBy("component").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b")).select("component", F.col("b.path").alias("path"))


def reexport_chains(uses: DataFrame) -> DataFrame:
    """(src, path) of all ways along re-exports without a repeat that end where no re-export goes on (OP-G30).

    A round for each hop of the longest way; no way is left open, as none repeats a node.
    """
    edges = materialize(uses.select("src", "dst").distinct(), "uses")
    live = materialize(edges.select("src", F.array("src", "dst").alias("path")), "paths")
    done = []
    while True:
        ext = live.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")), F.element_at("path", -1) == F.col("at"), "left").withColumn("stop", F.col("next").isNull() | F.array_contains("path", F.col("next")))
        ext = materialize(ext, "paths")
        done.append(ext.where("stop").select("src", "path").distinct())
        live = ext.where("not stop").select("src", F.concat("path", F.array("next")).alias("path"))
        if live.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


#: Rows of a plan that a fold over it takes to the driver at most.
PLAN = 1_000_000


def batches(order: DataFrame, edges: DataFrame, shared: bool = False) -> DataFrame:
    """(id, batch): independent batches of an order (pos, id) with dependencies (src before dst) (OP-G25).

    By default, a batch is a level. If shared, nodes that share a dependency do not share a batch either: a batch ends at a
    node that is, or depends on, what the batch has or depends on. That is a fold over the order, for plans, not data:
    a plan of over PLAN nodes or dependencies is an error.
    """
    if not shared:
        return peel(order.select("id"), edges).select("id", F.col("level").alias("batch"))
    if (rows := max(order.count(), edges.count())) > PLAN:
        raise ValueError(f"a plan of {rows} rows; a fold takes {PLAN}")
    deps: dict = {}
    for src, dst in edges.select("src", "dst").toLocalIterator():
        deps.setdefault(dst, set()).add(src)
    out, taken, batch = [], set(), 0
    for node in (r["id"] for r in order.orderBy("pos").toLocalIterator()):
        own = {node} | deps.get(node, set())
        if taken & own:
            batch, taken = batch + 1, set()
        taken |= own
        out.append((node, batch))
    return order.sparkSession.createDataFrame(out, order.select("id", F.lit(0).alias("batch")).schema)

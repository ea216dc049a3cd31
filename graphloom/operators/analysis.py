"""Static-analysis domains over call, alias, flow and effect tables (OP-D*, OP-J9, OP-G34)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import graph as G
from graphloom.store import materialize

#: Interval ends that stand for no bound.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def call_edges(edges: DataFrame, kind: str = "Calls") -> DataFrame:
    """Edges of one kind, each with weight one (OP-D1)."""
    return edges.where(F.col("kind") == kind).select("src", "dst", F.lit(1).cast("long").alias("weight"))


def is_entry(name: Column, public: Column) -> Column:
    """A node the outside calls: named like an entry point, or public (OP-F7, OP-D3)."""
    return name.endswith("::main") | name.endswith("::run") | name.endswith("::execute") | public


def dead_symbols(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entry reaches (OP-D3)."""
    return nodes.select("id").join(G.reach(edges, entries, nodes), "id", "left_anti")


def may_alias(points_to: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p, q, alias): whether both can point to one thing; a variable that points nowhere aliases nothing (OP-D4)."""
    asked = pairs.select(F.col("p").alias("id")).union(pairs.select("q")).distinct()
    far = materialize(G.closure(points_to, asked), "points")
    met = pairs.join(far.withColumnsRenamed({"src": "p", "dst": "o"}), "p").join(far.withColumnsRenamed({"src": "q", "dst": "o"}), ["q", "o"]).select("p", "q").distinct()
    return pairs.join(met.withColumn("alias", F.lit(True)), ["p", "q"], "left").na.fill(False, ["alias"])


def tainted_sinks(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(sink, label) where a source with a label (id, label) reaches a sink (id, label) that forbids it (OP-D6)."""
    ways = G.closure(flows, sources.select("id").distinct(), reflexive=True)
    return ways.join(sources.withColumnRenamed("id", "src"), "src").join(sinks.withColumnRenamed("id", "dst"), ["dst", "label"]).select(F.col("dst").alias("sink"), "label").distinct()


def propagate_regions(outlives: DataFrame, live: DataFrame, along: bool = True) -> DataFrame:
    """(region, point): each region's points pushed into the regions that its edges lead to, or against them (OP-D7)."""
    edges = outlives if along else G.reverse(outlives)
    ways = G.closure(edges, live.select(F.col("region").alias("id")).distinct())
    moved = ways.join(live.withColumnRenamed("region", "src"), "src").select(F.col("dst").alias("region"), "point")
    return live.unionByName(moved).distinct()


def subtypes(extends: DataFrame) -> DataFrame:
    """(src, dst) if src is dst or extends it over any number of steps (OP-D8)."""
    return G.closure(extends, reflexive=True)


#: Accesses that a stretch of a trace has on average.
STRETCH = 64


def held_locks(trace: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(thread, seq, target, held) of each access: the locks whose last action before it was to acquire (OP-D9).

    A thread holds a lock from an acquisition to the next action on it. Such spans are cut at stretches of the trace and
    meet the accesses of their own stretches alone, so a thread with most of the rows is many keys. The rows of the
    join follow the locks that are held, which is the answer's size.
    """
    accesses = trace.where("action = 'access'").select("thread", F.col("seq").alias("at"), F.col("target").alias("object"))
    low, high, n = accesses.agg(F.min("at"), F.max("at"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) * stretch // max(n, 1))
    place = lambda c: F.floor((c - F.lit(low or 0)) / F.lit(width))
    following = F.lead("seq").over(Window.partitionBy("thread", "target").orderBy("seq"))
    spans = trace.where("action != 'access'").withColumn("until", F.coalesce(following, F.lit((high or 0) + 1))).where("action = 'acquire'")
    spans = spans.select("thread", F.col("target").alias("lock"), "seq", "until").where((F.col("until") > (low or 0)) & (F.col("seq") < (high or 0)))
    spans = spans.withColumn("stretch", F.explode(F.sequence(place(F.greatest("seq", F.lit(low or 0))), place(F.least("until", F.lit(high or 0))))))
    met = accesses.withColumn("stretch", place(F.col("at"))).join(spans, ["thread", "stretch"]).where("seq < at and at < until")
    held = met.groupBy("thread", "at").agg(F.sort_array(F.collect_set("lock")).alias("held"))
    return accesses.join(held, ["thread", "at"], "left").select("thread", F.col("at").alias("seq"), F.col("object").alias("target"), F.coalesce("held", F.array().cast("array<string>")).alias("held"))


def races(accesses: DataFrame) -> DataFrame:
    """(target, a, b): accesses of one target by different threads with no lock in common (OP-J9, OP-D9).

    Accesses alike in thread and locks race alike, so they are joined as classes; a and b are their first accesses.
    """
    classes = accesses.groupBy("target", "thread", "held").agg(F.min("seq").alias("seq"))
    a, b = (classes.select("target", F.col("thread").alias(f"t{x}"), F.col("held").alias(f"h{x}"), F.col("seq").alias(x)) for x in "ab")
    return a.join(b, "target").where((F.col("a") < F.col("b")) & (F.col("ta") != F.col("tb")) & ~F.arrays_overlap("ha", "hb")).select("target", "a", "b")


def effects(facts: DataFrame) -> DataFrame:
    """(function, effects) in order, from (function, effect) rows (OP-D10, OP-A13)."""
    return facts.groupBy("function").agg(F.sort_array(F.collect_set("effect")).alias("effects"))


def pure(functions: DataFrame, facts: DataFrame) -> DataFrame:
    """Functions without an effect (OP-D10)."""
    return functions.join(facts.select("function").distinct(), "function", "left_anti")


def used_before_defined(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Uses (var, at) of a variable without an earlier definition (var, at) (OP-D12)."""
    first = defs.groupBy("var").agg(F.min("at").alias("defined"))
    return uses.join(first, "var", "left").where("defined is null or defined > at").select("var", "at")


def bottom_up(nodes: DataFrame, edges: DataFrame, own: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """(id, summary): a node's own value, combined with its callees' summaries from the deepest level up (OP-D13).

    combine takes the column of a group's values, own and callees', to an aggregate. Nodes on a cycle have no summary.
    """
    order = materialize(G.chain_depth(nodes, edges).join(nodes.select("id", own.alias("own")), "id"), "order")
    top = order.agg(F.max("depth")).first()[0]
    done = order.where("depth = 0").select("id", F.col("own").alias("summary"))
    for depth in range(1, (top or 0) + 1):
        at = order.where(F.col("depth") == depth)
        parts = at.select("id", F.col("own").alias("summary")).unionByName(edges.join(at.select(F.col("id").alias("src")), "src").join(done, F.col("dst") == done["id"]).select(F.col("src").alias("id"), "summary"))
        done = materialize(done.unionByName(parts.groupBy("id").agg(combine(F.col("summary")).alias("summary"))), "summaries")
    return done


def join_interval(a: Column, b: Column) -> Column:
    """The least interval over both; null is the empty one (OP-X23)."""
    both = F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def widen_interval(a: Column, b: Column) -> Column:
    """a, but without a bound where b goes beyond it (OP-X23, OP-D14)."""
    lo = F.when(b["lo"] < a["lo"], F.lit(LOW)).otherwise(a["lo"])
    hi = F.when(b["hi"] > a["hi"], F.lit(HIGH)).otherwise(a["hi"])
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): sizes, edges by kind, and flags, in one pass over each table (OP-D15, OP-A1)."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("unsafe")).alias("unsafe"), F.count_if(F.col("visibility") == "pub").alias("public"))
    kinds = edges.groupBy(F.concat(F.lit("edges."), "kind").alias("metric")).agg(F.count("*").alias("value"))
    return kinds.unionByName(n.unpivot([], ["nodes", "unsafe", "public"], "metric", "value"))


def guarded_removals(edges: DataFrame, candidates: DataFrame, limit: float = 0.5, least_nodes: int = 3) -> DataFrame:
    """(src, dst, taken) for candidate removals in the order of (src, dst) (OP-G34).

    A removal is taken if the sum of ln(out-degree) moves by `limit` at most and neither end is left alone. Each is judged
    after those before, a fold over the candidates, which are a plan; only degrees of their ends are gathered. A plan of over
    `graph.PLAN` candidates is an error.
    """
    spark = edges.sparkSession
    asked = materialize(candidates.select("src", "dst").distinct(), "asked")
    if (rows := asked.count()) > G.PLAN:
        raise ValueError(f"{rows} candidates; a fold takes {G.PLAN}")
    ends = asked.select(F.col("src").alias("id")).union(asked.select("dst")).distinct()
    of = {r["id"]: [r["out_degree"], r["in_degree"]] for r in G.degrees(ends, edges).toLocalIterator()}
    enough = G.nodes_of(edges).limit(least_nodes).count() >= least_nodes
    out = []
    for src, dst in sorted(tuple(r) for r in asked.toLocalIterator()):
        k = of[src][0]
        moved = math.log(k) - math.log(max(k - 1, 1)) if k > 0 else 0.0
        taken = enough and moved <= limit and sum(of[src]) > 1 and sum(of[dst]) > 1
        if taken:
            of[src][0] -= 1
            of[dst][1] -= 1
        out.append((src, dst, taken))
    return spark.createDataFrame(out, "src long, dst long, taken boolean")


def ordered_effects(trace: DataFrame, window: int = 2) -> DataFrame:
    """Each thread's actions with the ones before, for reading a trace."""
    before = Window.partitionBy("thread").orderBy("seq")
    return trace.withColumn("before", F.lag("action", window - 1).over(before))

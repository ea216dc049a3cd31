"""Solvers over a program model: nodes (id, kind, name, visibility, unsafe) and typed edges (OP-V*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import graph as G
from graphloom.store import materialize

#: The graph that each kind of edge belongs to.
GRAPH_OF = {
    "Renames": "name", "Resolves": "name", "TypeOf": "type", "TypeUnifies": "type", "Calls": "call", "Contains": "module",
    "ImplFor": "module", "CfgEdge": "cfg", "CfgBranch": "cfg", "Outlives": "region", "ConstDep": "value", "Expands": "macro",
}
#: The kinds' places in the order of emission, which compare as text.
BUCKETS = {
    "Crate": "0_crate", "Module": "1_module", "Use": "2_use", "Struct": "3_struct", "Enum": "3_enum", "Trait": "4_trait", "TypeAlias": "5_tyalias",
    "Const": "5b_const", "Static": "5c_static", "Impl": "6_impl", "Function": "7_fn", "Method": "8_method", "TypeRef": "9_tyref", "MacroCall": "9b_macro",
}


def route(edges: DataFrame) -> DataFrame:
    """Edges with the graph they belong to; the kind stays, so kinds that share a graph can be told apart (OP-F3, OP-V22)."""
    pairs = [F.lit(x) for kv in GRAPH_OF.items() for x in kv]
    return edges.withColumn("graph", F.create_map(*pairs)[F.col("kind")])


def cfg_edges(blocks: DataFrame) -> DataFrame:
    """(function, src, dst) from (function, block, targets): one row for each target of a block's end (OP-V22)."""
    return blocks.select("function", F.col("block").alias("src"), F.explode("targets").alias("dst"))


def emit_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of containers in the module graph; null on cycles (OP-V1)."""
    return G.peel(nodes, edges)


def renamed(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Nodes with the names that renames (src, dst) give: the target takes the source's original name, of several the
    source with the largest id (OP-V2)."""
    given = renames.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("given")), "src").groupBy(F.col("dst").alias("id")).agg(F.max_by("given", "src").alias("given"))
    return nodes.join(given, "id", "left").withColumn("name", F.coalesce("given", "name")).drop("given")


def call_roots(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that nothing calls (OP-V4)."""
    return nodes.select("id").join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def dead_functions(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that no root reaches: those on and behind cycles alone (OP-V4)."""
    return nodes.select("id").join(G.reach(calls, call_roots(nodes, calls)), "id", "left_anti")


def owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return materialize(G.containing(nodes, edges.where("kind = 'Contains'")), "owners")


def needed_uses(nodes: DataFrame, edges: DataFrame, resolves: str = "Resolves") -> DataFrame:
    """(module, target): what a module must import: resolved nodes that another module owns, each once (OP-V6)."""
    own = owners(nodes, edges)
    sites = edges.where(F.col("kind") == resolves).join(own.select(F.col("id").alias("src"), F.col("owner").alias("module")), "src").join(own.select(F.col("id").alias("dst"), F.col("owner").alias("home")), "dst")
    return sites.where("module is not null and not (module <=> home)").select("module", F.col("dst").alias("target")).distinct()


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, broken): edges of each kind with an end that is no node (OP-V7)."""
    return G.broken_edges(nodes, edges.select("src", "dst", "kind")).groupBy("kind").agg(F.count("*").alias("broken"))


def private_uses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): resolutions of private nodes from another module than their own (OP-V8)."""
    own = owners(nodes, edges)
    hidden = nodes.where("visibility = 'private'").select(F.col("id").alias("dst"))
    sites = edges.where("kind = 'Resolves'").join(hidden, "dst", "left_semi")
    both = sites.join(own.select(F.col("id").alias("src"), F.col("owner").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("owner").alias("b")), "dst")
    return both.where("not (a <=> b)").select("src", "dst").distinct()


def impl_defects(nodes: DataFrame, impls: DataFrame) -> DataFrame:
    """(defect, subject): impls (id, struct, trait) of unknown structs, and pairs of struct and trait with several
    impls; a null trait is a value (OP-V9)."""
    known = nodes.where("kind = 'Struct'").select(F.col("id").alias("struct"))
    unknown = impls.join(known, "struct", "left_anti").select(F.lit("unknown struct").alias("defect"), F.col("id").cast("string").alias("subject"))
    twice = impls.groupBy("struct", "trait").count().where("count > 1")
    return unknown.unionByName(twice.select(F.lit("duplicate impl").alias("defect"), F.concat_ws("/", F.col("struct").cast("string"), F.coalesce("trait", F.lit(""))).alias("subject")))


def missing_methods(required: DataFrame, impls: DataFrame, implemented: DataFrame) -> DataFrame:
    """(impl, method) that an impl's trait requires (trait, method) and the impl lacks (impl, method) (OP-V10, OP-J8)."""
    return impls.join(required, "trait").select("impl", "method").distinct().join(implemented, ["impl", "method"], "left_anti")


def type_conflicts(components: DataFrame, concrete: DataFrame) -> DataFrame:
    """(component, id): nodes whose concrete type (id, type) is not that of their component's least node (OP-V11)."""
    typed = components.join(concrete, "id")
    first = typed.groupBy("component").agg(F.min_by("type", "id").alias("first"))
    return typed.join(first, "component").where("type != first").select("component", "id")


def shadowed(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(module, name, n): names that a module has more than once (OP-V12, OP-A5)."""
    return nodes.join(own, "id").where("owner is not null").groupBy(F.col("owner").alias("module"), "name").agg(F.count("*").alias("n")).where("n > 1")


def live_order(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Nodes that stay in the order: all but functions that are neither public nor reached from a public one (OP-V14, OP-J6)."""
    public = nodes.where("kind = 'Function' and visibility = 'pub'").select("id")
    live = G.reach(calls, public)
    return nodes.where("kind != 'Function' or visibility = 'pub'").unionByName(nodes.where("kind = 'Function' and visibility != 'pub'").join(live, "id", "left_semi"))


def emission_name(nodes: DataFrame) -> Column:
    """What a node is sorted by within its bucket: impls by struct and trait, what has a path by that, others by name."""
    col = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    impl = F.concat(F.coalesce(col("struct"), F.lit("")), F.lit("__"), F.coalesce(col("trait"), F.lit("")))
    return F.when(F.col("kind") == "Impl", impl).when(F.col("kind").isin("Module", "Use", "MacroCall"), F.coalesce(col("path"), F.col("name"))).otherwise(F.col("name"))


def stable_order(nodes: DataFrame) -> DataFrame:
    """(id, bucket, pos): the order is by bucket, then place within it: by name, ties by id (OP-V15, OP-T3)."""
    pairs = [F.lit(x) for kv in BUCKETS.items() for x in kv]
    ranked = nodes.withColumn("bucket", F.create_map(*pairs)[F.col("kind")]).withColumn("__name", emission_name(nodes))
    return ranked.select("id", "bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("__name", "id")).alias("pos"))


def unmentioned(variants: DataFrame, bodies: DataFrame) -> DataFrame:
    """Variants (variant) that no body (text) mentions; a body with a catch-all `_ =>` waives all (OP-V19).

    Bodies are cut into words, which variants are looked up among.
    """
    words = bodies.select(F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("variant")).distinct()
    caught = bodies.where(F.col("text").contains("_ =>")).limit(1).count() > 0
    return variants.where(F.lit(not caught)).join(words, "variant", "left_anti")


def unsafe_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst): calls from safe nodes to unsafe ones (OP-V21, OP-J16)."""
    a = nodes.where("not unsafe").select(F.col("id").alias("src"))
    b = nodes.where("unsafe").select(F.col("id").alias("dst"))
    return calls.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")

"""Name resolution, dependency discovery and proposals (OP-Y*, OP-G28 to OP-G31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graph import chase


def normalized_path(path: Column, module: Column) -> Column:
    """A path with `self`, `super` and `crate` resolved from a module (OP-Y1)."""
    parent = F.regexp_replace(module, "::[^:]+$", "")
    return (
        F.when(path.startswith("crate::"), path)
        .when(path.startswith("self::"), F.concat(module, F.lit("::"), F.regexp_replace(path, "^self::", "")))
        .when(path.startswith("super::"), F.concat(parent, F.lit("::"), F.regexp_replace(path, "^super::", "")))
        .otherwise(F.concat(module, F.lit("::"), path))
    )


def resolve_paths(sites: DataFrame, symbols: DataFrame, aliases: DataFrame, max_hops: int = 8) -> DataFrame:
    """(id, symbol, hops) for sites (id, path, module): normalised, followed through aliases (src, dst) for at most eight
    hops, and looked up among symbols (path) (OP-Y1, OP-G29)."""
    at = sites.select("id", normalized_path(F.col("path"), F.col("module")).alias("path"))
    ends = chase(aliases, at.select(F.col("path").alias("id")).distinct(), max_hops).withColumnRenamed("id", "path")
    known = symbols.select(F.col("path").alias("last"), F.lit(True).alias("known"))
    out = at.join(ends, "path").join(known, "last", "left")
    return out.select("id", F.when(F.col("known"), F.col("last")).alias("symbol"), "hops")


def innermost(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, binding): for uses (id, name, scopes), the binding (name, scope, binding) of the innermost scope (OP-Y2).

    scopes: from the outermost to the innermost.
    """
    opened = uses.select("id", "name", F.posexplode("scopes").alias("depth", "scope"))
    return opened.join(bindings, ["name", "scope"]).groupBy("id").agg(F.max_by("binding", "depth").alias("binding"))


def call_edges(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee): sites (caller, module, name) matched to public functions (id, module, name, public) of their own
    module, else to those of that name anywhere, if there is one only; no self-calls, each once (OP-Y3)."""
    public = functions.where("public")
    own = sites.join(public.select(F.col("id").alias("near"), "module", "name"), ["module", "name"], "left")
    single = public.groupBy("name").agg(F.min("id").alias("far"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = own.join(single, "name", "left").select("caller", F.coalesce("near", "far").alias("callee"))
    return out.where("callee is not null and caller != callee").distinct()


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df with (n): places from 1 within groups."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def module_edges(uses: DataFrame) -> DataFrame:
    """(src, dst, names) from uses (src, dst, name): no self-edges, none from a module to its ancestor; names in order
    (OP-Y4, OP-G26)."""
    rows = uses.where((F.col("src") != F.col("dst")) & ~F.col("src").startswith(F.concat("dst", F.lit("::"))))
    return rows.groupBy("src", "dst").agg(F.sort_array(F.collect_set("name")).alias("names"))


def file_dependencies(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, target) from (path, dep) and modules (module, path) (OP-Y5)."""
    return deps.join(modules.select(F.col("module").alias("dep"), F.col("path").alias("target")), "dep").where("path != target").select("path", "target").distinct()


def proposal_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id, name) with ids made from names where they lack one, and (kind, id, n) of duplicates (OP-Y9)."""
    named = nodes.withColumn("id", F.coalesce("id", F.concat_ws(".", F.lower("kind"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "_"))))
    return named, named.groupBy("kind", "id").agg(F.count("*").alias("n")).where("n > 1")


def accept(items: DataFrame, proposal: str) -> DataFrame:
    """(delta, proposal, kind, id, stage, order): a delta for each node, API and edge of a proposal, in the order of kinds and
    ids within a bounded proposal (OP-Y10)."""
    ranked = items.withColumn("order", F.row_number().over(Window.orderBy("kind", "id")))
    return ranked.select(F.concat_ws(".", F.lit("delta"), F.lit(proposal), F.col("order").cast("string")).alias("delta"), F.lit(proposal).alias("proposal"), "kind", "id", F.lit("Decide").alias("stage"), "order")


def version_fits(current: Column, version: Column, compatible: Column) -> Column:
    """Whether a document's version, or one it is compatible with, is the current one (OP-Y12)."""
    return (current == version) | F.coalesce(F.array_contains(compatible, current), F.lit(False))


def dispatchable(nodes: DataFrame, edges: DataFrame, completed: DataFrame, threshold: Column) -> DataFrame:
    """Nodes (id, trust) that are trusted enough and whose predecessors are all completed (OP-Y13)."""
    waiting = edges.join(completed.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    return nodes.where(F.col("trust") >= threshold).join(completed, "id", "left_anti").join(waiting, "id", "left_anti")


def propagate_edits(ops: DataFrame, occurrences: DataFrame, imports: DataFrame) -> DataFrame:
    """(op, symbol, file, action): what edits (op, symbol, arg) ask of files that use (symbol, file) or import (symbol, file)
    a symbol (OP-Y15)."""
    action = lambda use: F.when(F.col("op") == "rename", f"replace {use}").when(F.col("op") == "delete", f"remove {use}").when(F.col("op") == "move", f"repath {use}").otherwise(f"review {use}")
    used = ops.join(occurrences, "symbol").select("op", "symbol", "file", action("use").alias("action"))
    return used.unionByName(ops.join(imports, "symbol").select("op", "symbol", "file", action("import").alias("action"))).distinct()


def rename_preview(files: DataFrame, names: dict[str, str], text: str = "text") -> DataFrame:
    """(path, line, before, after) of lines that renaming identifiers would change (OP-M26)."""
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("i", "before"))
    after = F.col("before")
    for old, new in names.items():
        after = F.regexp_replace(after, rf"\b{old}\b", new)
    return lines.select("path", (F.col("i") + 1).alias("line"), "before", after.alias("after")).where("before != after")

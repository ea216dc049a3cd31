"""Layouts: which file each node of a program goes to (OP-M30)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of node that are laid out.
ROUTED = ("Struct", "Enum", "Trait", "Impl", "Function")


def _plain(text: Column) -> Column:
    """ASCII letters and digits in lower case, whatever else as an underscore."""
    return F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]", "_")


def _root(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"file": F.concat(F.lit("file."), _plain(F.col("module")), F.lit(".mod")), "path": F.lit("mod.rs")})


def single_file(nodes: DataFrame) -> DataFrame:
    """All of a module in its root file."""
    return _root(nodes)


def per_type(nodes: DataFrame) -> DataFrame:
    """A file for each name of a struct, enum or trait; impls, and the functions in them, go with their struct.

    Impls and functions whose struct is not one of their own module's stay in the root file.
    """
    slug = _plain(F.col("name"))
    types = nodes.where(F.col("kind").isin("Struct", "Enum", "Trait")).withColumns({"file": F.concat_ws(".", F.lit("file"), _plain(F.col("module")), slug), "path": F.concat(slug, F.lit(".rs"))})
    homes = types.where("kind = 'Struct'").groupBy(F.col("id").alias("__struct"), F.col("module").alias("__module")).agg(F.min("file").alias("__file"), F.min("path").alias("__path"))
    impls = nodes.where("kind = 'Impl'").select(F.col("id").alias("__impl"), F.col("struct").alias("__of"))
    rest = nodes.where(F.col("kind").isin("Impl", "Function")).join(impls, F.expr("kind = 'Function' and impl = __impl"), "left")
    rest = rest.withColumn("__struct", F.when(F.col("kind") == "Impl", F.col("struct")).otherwise(F.col("__of"))).withColumn("__module", F.col("module"))
    rest = _root(rest.join(homes, ["__struct", "__module"], "left"))
    rest = rest.withColumns({"file": F.coalesce("__file", "file"), "path": F.coalesce("__path", "path")})
    return types.unionByName(rest.select(*types.columns))


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """A file for each node, named by kind and name, impls by their ids."""
    word = F.when(F.col("kind") == "Function", "fn").otherwise(F.lower("kind"))
    slug = _plain(F.when(F.col("kind") == "Impl", F.col("id").cast("string")).otherwise(F.col("name")))
    return nodes.withColumns({"file": F.concat_ws(".", F.lit("file"), _plain(F.col("module")), word, slug), "path": F.concat(word, F.lit("_"), slug, F.lit(".rs"))})


#: By the strategies' names; `original` takes a layout as it is.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"single_file": single_file, "per_type": per_type, "flat_nodes": flat_nodes, "canonical_normalized": flat_nodes}


def layout(nodes: DataFrame, strategy: str, base: DataFrame | None = None) -> DataFrame:
    """(node, module, file, path) for nodes (id, kind, name, module, struct, impl) of the kinds that are laid out.

    struct: an impl's struct; impl: a function's impl. `original` gives back the base, (node, module, file, path). The
    canonical layout is the flat one in the order of its nodes, which a table does not have, so its rows are the same.
    """
    if strategy == "original":
        return base.select("node", "module", "file", "path")
    laid = STRATEGIES[strategy](nodes.where(F.col("kind").isin(*ROUTED)))
    return laid.select(F.col("id").alias("node"), "module", "file", "path")

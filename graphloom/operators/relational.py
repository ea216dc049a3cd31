"""Filters, joins, aggregates, windows, top-k and set operations (OP-F*, OP-J*, OP-A*, OP-W*, OP-T*, OP-U*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which kinds of delta a stage may make, and which scopes of proof a kind may have.
STAGE_KINDS = {
    "Observe": ("State", "Io", "Structure", "History"),
    "Learn": ("State", "Structure", "History"),
    "Decide": ("Structure", "History"),
    "Plan": ("Structure", "History"),
    "Act": ("State", "Io", "History"),
}
KIND_SCOPES = {"State": ("Execution",), "Io": ("Execution",), "Structure": ("Structure", "Law"), "History": ("Structure", "Execution")}


def symbol_query(symbols: DataFrame, kinds: Sequence[str] | None = None, module_prefix: str | None = None, name_contains: str | None = None) -> DataFrame:
    """Symbols of some kinds, in modules with a prefix, whose name holds a text in any case; what is not given holds
    for all (OP-F1, OP-F2)."""
    tests = []
    if kinds:
        tests.append(F.col("kind").isin(list(kinds)))
    if module_prefix is not None:
        tests.append(F.col("module").startswith(module_prefix))
    if name_contains is not None:
        tests.append(F.lower("name").contains(name_contains.lower()))
    return symbols.where(reduce(lambda a, b: a & b, tests)) if tests else symbols


def query_request(symbols: DataFrame, request: Mapping[str, object]) -> DataFrame:
    """`symbol_query` from a decoded JSON request; unknown keys are an error."""
    if extra := set(request) - {"kinds", "module_prefix", "name_contains"}:
        raise ValueError(f"unknown keys {sorted(extra)}")
    return symbol_query(symbols, **request)


def truncated(items: Column, most: int = 30) -> Column:
    """The first items of a list, and a note of how many were left out (OP-F4)."""
    note = F.concat(F.lit("... ("), (F.size(items) - most).cast("string"), F.lit(" more items truncated)"))  # a fixed value
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), F.array(note))).otherwise(items)


#: Ends of names of types, and parts of paths of definitions, that say nothing about a program's domain.
NOISE_TYPES = ("String", "&str", "bool", "u64", "usize", "f64", "f32", "i32", "()", "std::string::String")
NOISE_DEFINITIONS = ("as std::clone", "as std::fmt", "as std::error", "as std::convert", "as std::default", "as std::ops")
#: Kinds of content that are context rather than conversation.
CONTEXT = ("user_editable_context", "model_editable_context")


def is_noise_type(name: Column) -> Column:
    """Whether a type's name ends like one of the noise types (OP-F11)."""
    return reduce(Column.__or__, [name.endswith(x) for x in NOISE_TYPES])


def is_noise_definition(path: Column) -> Column:
    """Whether a definition is one of a standard trait (OP-F11)."""
    return reduce(Column.__or__, [path.contains(x) for x in NOISE_DEFINITIONS])


def is_message(role: Column, content_type: Column, parts: Column) -> Column:
    """Whether an event is part of a conversation: neither editable context nor a system text of blank parts (OP-F12).

    Null parts of a list are blank; a message without a list is kept.
    """
    blank = F.forall(parts, lambda p: F.coalesce(p, F.lit("")).rlike(r"^\s*$"))
    empty = (role == "system") & (content_type == "text") & blank
    return ~F.coalesce(content_type.isin(*CONTEXT), F.lit(False)) & ~F.coalesce(empty, F.lit(False))


def reconnect(dead: DataFrame, live: DataFrame) -> DataFrame:
    """(id, best, score) of dead items (id, inputs): the live item (id, module, inputs) that shares most of their input types.

    The score is the number of the dead item's inputs that the live one has too, over the dead one's inputs and one
    (OP-G33). Of equal scores the shorter module is best, then the lesser id; without a shared type there is none,
    and the score is zero. Items meet by shared types alone.
    """
    asked = dead.select("id", F.explode(F.array_distinct("inputs")).alias("type"))
    offered = live.select(F.col("id").alias("best"), F.length("module").alias("__length"), F.explode(F.array_distinct("inputs")).alias("type"))
    shared = asked.join(offered, "type").groupBy("id", "best", "__length").agg(F.count("*").alias("n"))
    top = shared.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "__length", "best")).alias("t"))
    joined = dead.select("id", F.size(F.array_distinct("inputs")).alias("__size")).join(top, "id", "left")
    return joined.select("id", F.col("t.best").alias("best"), F.coalesce(-F.col("t.n") / (F.col("__size") + 1), F.lit(0.0)).alias("score"))


def is_visible(symbol_module: Column, from_module: Column, scope: Column, path: Column) -> Column:
    """Whether a symbol can be used from a module, by its scope (OP-F6)."""
    crate = lambda m: F.split(m, "::")[0]
    return (
        F.when(scope == "public", F.lit(True))
        .when(scope == "crate", crate(symbol_module) == crate(from_module))
        .when(scope == "super", from_module.startswith(symbol_module))
        .when(scope == "private", symbol_module == from_module)
        .when(scope == "restricted", from_module.startswith(path))
    )


def allowed(spark, pairs: Mapping[str, Sequence[str]], a: str, b: str) -> DataFrame:
    """A table of legal pairs, to be joined with (OP-F10)."""
    return spark.createDataFrame([(k, v) for k, vs in pairs.items() for v in vs], f"{a} string, {b} string")


def compatible(value_kind: Column, type_kind: Column, value_name: Column, type_name: Column) -> Column:
    """Whether a value fits a declared type: scalars and structs by name, all others by kind (OP-F9)."""
    return (value_kind == type_kind) & F.when(value_kind.isin("Scalar", "Struct"), value_name == type_name).otherwise(F.lit(True))


def rename_ids(df: DataFrame, old: object, new: object, columns: Sequence[str]) -> DataFrame:
    """One id replaced in every column that refers to it (OP-F13)."""
    return df.withColumns({c: F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(F.col(c)) for c in columns})


def first_match(df: DataFrame, test: Column, order: str) -> DataFrame:
    """The first row in an order that passes a test, or none (OP-F14)."""
    return df.where(test).orderBy(order).limit(1)


def differences(before: DataFrame, after: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """(key..., change) with added, removed or changed for each key that differs (OP-J11, OP-J12). Keys are unique."""
    a = before.select(*key, F.struct(*value).alias("__a"))
    b = after.select(*key, F.struct(*value).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, list(key), "full_outer").select(*key, change.alias("change")).where("change is not null")


def not_contained(part: DataFrame, whole: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of part that whole lacks (OP-J7, OP-J13)."""
    return part.select(*key).distinct().join(whole.select(*key), list(key), "left_anti")


def nearest_ancestors(nodes: DataFrame, separator: str = "::") -> DataFrame:
    """(key, parent): for each key, the longest key that is a proper prefix of it by whole parts, if there is one (OP-J10).

    A key meets its own prefixes only, as many as it has parts.
    """
    parts = F.split("key", F.lit("\\Q" + separator + "\\E"))
    prefixes = nodes.select("key").distinct().withColumn("__parts", parts).where(F.size("__parts") > 1)
    prefixes = prefixes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("__parts") - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("__parts", F.lit(1), n), separator).alias("parent")))).alias("p"))
    known = nodes.select(F.col("key").alias("parent")).distinct()
    met = prefixes.select("key", "p.n", "p.parent").join(known, "parent")
    return met.groupBy("key").agg(F.max_by("parent", "n").alias("parent"))


def postconditions(rows: DataFrame, outputs: Mapping[str, Sequence[str]]) -> DataFrame:
    """(function, condition, holds, counterexample): whether the outputs that functions name are never negative in rows (OP-M24).

    A condition over no value holds; the counterexample is the least value. This judges the data that are there; what holds
    for all data takes a solver.
    """
    named = [(f, o) for f, found in outputs.items() for o in found]
    least = rows.agg(*[F.min(o).cast("double").alias(f"m{i}") for i, (_, o) in enumerate(named)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("function"), F.lit(f"non_negative({o})").alias("condition"), F.col(f"m{i}").alias("least")) for i, (f, o) in enumerate(named)]))
    found = least.select(each.alias("c")).select("c.*")
    return found.select("function", "condition", F.coalesce(F.col("least") >= 0, F.lit(True)).alias("holds"), F.when(F.col("least") < 0, F.col("least")).alias("counterexample"))


def best_match(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, best): the candidate of the best tier (same module, parent module, any of the kind), then the highest score,
    the shortest module and the least id (OP-J15, OP-T5).

    items: (id, kind, module, parent); candidates: (cid, kind, cmodule, score). Each tier only needs the best candidate of a kind
    and module, or of a kind, so an item meets one candidate a tier.
    """
    order = F.struct((-F.col("score")).alias("s"), F.length("cmodule").alias("l"), "cid")
    best = candidates.groupBy("kind", "cmodule").agg(F.min(order).alias("b"))
    kinds = candidates.groupBy("kind").agg(F.min(order).alias("b"))
    tier = lambda n, rows: rows.select("id", F.struct(F.lit(n).alias("tier"), "b").alias("t"))
    met = [tier(n, items.join(best.withColumnRenamed("cmodule", c), ["kind", c])) for n, c in ((1, "module"), (2, "parent"))]
    met.append(tier(3, items.join(kinds, "kind")))
    return reduce(DataFrame.unionByName, met).groupBy("id").agg(F.min("t").alias("t")).select("id", F.col("t.b.cid").alias("best"), F.col("t.tier").alias("tier"))


def fusion_pairs(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(producer, consumer): calls between pure units whose only callee and only caller they are (OP-J18)."""
    calls = edges.select("src", "dst").distinct()
    out = calls.groupBy("src").count().where("count = 1").select("src")
    into = calls.groupBy("dst").count().where("count = 1").select("dst")
    pure = units.where("pure and no_io and no_alloc and no_branch").select("function")
    return calls.join(out, "src", "left_semi").join(into, "dst", "left_semi").join(pure, calls["src"] == pure["function"], "left_semi").join(pure, calls["dst"] == pure["function"], "left_semi").select(F.col("src").alias("producer"), F.col("dst").alias("consumer"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """(key..., n) of keys that occur more than once (OP-A5); null is a value."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two lists taken as sets; one if both are empty (OP-A7)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ema(order: Column, value: Column, alpha: float) -> Column:
    """The running mean e = alpha v + (1 - alpha) e over a group's values in order, from the first value (OP-A10).

    An aggregate: it gathers a group's (order, value) pairs, sorts and folds them.
    """
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.cast("double").alias("v"))))
    return F.aggregate(pairs, F.element_at(pairs, 1)["v"], lambda e, x: alpha * x["v"] + (1 - alpha) * e)


def trust_threshold(reward: Column, base: float = 0.5) -> Column:
    """base - 0.05 reward, between 0.1 and 0.95 (OP-X27)."""
    return F.least(F.greatest(F.lit(base) - F.lit(0.05) * F.coalesce(reward, F.lit(0.0)), F.lit(0.1)), F.lit(0.95))


def updated_policy(reward: Column, rate: str, baseline: str, others: Sequence[str]) -> dict[str, Column]:
    """Parameters moved by rate (reward - baseline), all by the same step; an error row if the rate is not positive (OP-X26)."""
    step = F.col(rate) * (reward - F.col(baseline))
    valid = F.col(rate) > 0
    return {c: F.when(valid, F.col(c) + step) for c in (rate, baseline, *others)}


def meta_interval(weight: Column) -> Column:
    """round(10 / (weight + 0.1)) between 2 and 50 (OP-X26)."""
    return F.least(F.greatest(F.round(F.lit(10.0) / (weight + F.lit(0.1))), F.lit(2.0)), F.lit(50.0)).cast("long")


def state_hash(ids: Column, order: Column) -> Column:
    """SHA-256 of a group's ids in order, joined by commas (OP-A16). An aggregate over what is hashed as one."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), ids.cast("string").alias("i")))), lambda x: x["i"]), ",").cast("binary"), 256)


def not_rising(df: DataFrame, group: str, order: str, value: str, strict: bool = True) -> DataFrame:
    """Rows whose value is not above the one before in their group (strict), or is below it (OP-W2, OP-W4)."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("before", before).where(F.col(value) <= F.col("before") if strict else F.col(value) < F.col("before"))


def collapsed(df: DataFrame, group: str, order: str, value: str, epsilon: float = 0.05) -> DataFrame:
    """Rows whose value is more than epsilon below the last one before that is not null (OP-W3)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.last(value, ignorenulls=True).over(w)).where(F.col(value) < F.col("before") - epsilon)


def is_prefix(before: DataFrame, after: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group) whose earlier list is no prefix of the later one (OP-W5)."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    a, b = (d.select(group, rank.alias("r"), F.col(value).alias(n)) for d, n in ((before, "a"), (after, "b")))
    return a.join(b, [group, "r"], "left").where(~F.col("a").eqNullSafe(F.col("b"))).select(group).distinct()


def branch_label(index: Column) -> Column:
    """A, B, ..., Z, AA, AB, ... for 0, 1, ... (OP-W7, OP-X25), up to seven letters."""
    letter = lambda n: F.char(F.pmod(n, F.lit(26)) + 65)
    out, rest = letter(index), F.floor(index / 26)
    for _ in range(6):
        out = F.when(rest > 0, F.concat(letter(rest - 1), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def first_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the first in an order (OP-U4). Pre-aggregates, so a frequent key is no hot partition."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("__r")).select(*key, "__r.*")


def latest_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the last in an order (OP-U5)."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("__r")).select(*key, "__r.*")


def diff_lines(before: DataFrame, after: DataFrame, line: str) -> DataFrame:
    """`+ x` and `- x` for lines that only one side has (OP-U1)."""
    a, b = before.select(line), after.select(line)
    return b.subtract(a).select(F.concat(F.lit("+ "), line).alias("line")).unionByName(a.subtract(b).select(F.concat(F.lit("- "), line).alias("line")))


def removed_rows(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of before, repeats included, whose key after lacks (OP-U2)."""
    return before.join(after.select(*key).distinct(), list(key), "left_anti")


def subsets(items: Column, most: int = 20) -> Column:
    """All subsets of a list, without its first item first (OP-U8); a list of over `most` items, a million subsets, is an error."""
    n = F.size(items)
    bit = lambda m, i: F.floor(m / F.pow(F.lit(2.0), n - 1 - i)).cast("long") % 2
    masks = F.when(n > most, F.raise_error(F.concat(F.lit("a list of "), n.cast("string"), F.lit(" items has too many subsets"))).cast("array<long>"))
    masks = masks.otherwise(F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2.0), n) - 1).cast("long")))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: bit(m, i) == 1))

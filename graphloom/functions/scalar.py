"""Scalar functions (OP-X*): built-in expressions, so they stay in generated code or in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.store import materialize


def occurrences(text: Column, pattern: str) -> Column:
    """Byte offsets of all occurrences of a pattern, overlapping ones too (OP-X1, OP-X2).

    The text is split before each occurrence by a look-ahead, so the work is linear but for the pattern's length.
    """
    if not pattern:
        return F.array().cast("array<int>")
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c for c in pattern)
    parts = F.split(text, f"(?s)(?={quoted})")
    lengths = F.transform(parts, F.octet_length)
    folded = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["ends"], acc["at"] + n).alias("ends")))
    cuts = F.slice(folded["ends"], 1, F.greatest(F.size(folded["ends"]) - 1, F.lit(0)))
    # Java's split leaves no empty part before a match at the start.
    return F.when(text.startswith(pattern), F.concat(F.array(F.lit(0)), F.filter(cuts, lambda x: x > 0))).otherwise(cuts)


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Greatest common divisor of longs: as many steps of Euclid as the largest need (OP-X3)."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"]).otherwise(1)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def power(base: Column, exponent: Column) -> Column:
    """base to a whole exponent as a decimal, exact to 38 digits; null beyond (OP-X3)."""
    times = F.when(exponent > 0, F.sequence(F.lit(1), exponent.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(times, F.lit(1).cast("decimal(38,0)"), lambda acc, _: F.try_multiply(acc, base.cast("decimal(10,0)")).cast("decimal(38,0)"))


def primes(spark, n: int) -> DataFrame:
    """(p): primes up to n (OP-X3). Multiples of the primes up to the root of n are struck out by an anti join."""
    root = int(n**0.5) + 1
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    numbers = spark.range(2, n + 1).withColumnRenamed("id", "p")
    if not small:
        return numbers
    struck = spark.createDataFrame([(p,) for p in small], "f long").select(F.explode(F.expr(f"if(f * f <= {n}, sequence(f * f, {n}L, f), array())")).alias("p"))
    return numbers.join(struck, "p", "left_anti")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of sparse matrices (i, j, v) (OP-X4). Partial sums are taken before the shuffle."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def fibonacci(n: Column) -> Column:
    """The n-th Fibonacci number as a decimal (OP-X5)."""
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    zero, one = (F.lit(x).cast("decimal(38,0)") for x in (0, 1))
    return F.aggregate(steps, F.struct(zero.alias("a"), one.alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).cast("decimal(38,0)").alias("b")), lambda s: s["a"])


def accepts(symbols: Column, transitions: Mapping[tuple[int, str], int], final: set[int], start: int = 0) -> Column:
    """Whether a list of symbols leads from the start to a final state; a missing transition rejects (OP-X8)."""
    table = F.create_map(*[F.lit(x) for (s, c), to in transitions.items() for x in (f"{s} {c}", to)])
    end = F.aggregate(symbols, F.lit(start), lambda s, c: F.coalesce(table[F.concat_ws(" ", s.cast("string"), c)], F.lit(-1)))
    return end.isin(*final)


def three_tokens(text: Column) -> Column:
    """The value of `a op b` for whole numbers, null for anything else (OP-X8)."""
    part = lambda g: F.regexp_extract(text, r"^\s*(-?\d+)\s+([+\-*])\s+(-?\d+)\s*$", g)
    a, op, b = F.try_to_number(part(1), F.lit("S999999999")).cast("long"), part(2), F.try_to_number(part(3), F.lit("S999999999")).cast("long")
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b)


def leaf_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """(level, idx, hash) of the tree over leaves (idx, hash), idx from 0, their number a power of two (OP-X9, OP-X10).

    A level pairs neighbours by idx div 2, pre-aggregated; there are as many rounds as levels.
    """
    n = leaves.count()
    if n & (n - 1) or not n:
        raise ValueError("a power of two of leaves")
    level = materialize(leaves.select(F.lit(0).alias("level"), "idx", "hash"), "merkle")
    out = level
    for k in range(1, n.bit_length()):
        pair = level.groupBy(F.expr("idx div 2").alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r"))
        level = materialize(pair.select(F.lit(k).alias("level"), "idx", F.sha2(F.concat(F.unhex("l"), F.unhex("r")), 256).alias("hash")), "merkle")
        out = out.unionByName(level)
    return out


def merkle_proof(levels: DataFrame, idx: int) -> DataFrame:
    """(level, hash, left): siblings on the way up from a leaf (OP-X9)."""
    top = levels.agg(F.max("level")).first()[0]
    at = F.call_function("shiftright", F.lit(idx), F.col("level"))
    return levels.where((F.col("level") < top) & (F.col("idx") == at.bitwiseXOR(F.lit(1)))).select("level", "hash", (F.col("idx") < at).alias("left"))


def verify_proof(leaf: Column, siblings: Column, root: Column) -> Column:
    """Whether siblings (structs of hash and left, from the leaf up) lead from a leaf's hash to the root (OP-X9)."""
    up = lambda h, s: F.sha2(F.when(s["left"], F.concat(F.unhex(s["hash"]), F.unhex(h))).otherwise(F.concat(F.unhex(h), F.unhex(s["hash"]))), 256)
    return F.aggregate(siblings, leaf, up) == root


def event_hash(tag: str, *parts: Column) -> Column:
    """SHA-256 of a tag and length-prefixed parts, so that no two lists of parts run together (OP-X11)."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(F.lit(tag), *[x for p in texts for x in (F.lit(":"), F.octet_length(p).cast("string"), F.lit(":"), p)]).cast("binary"), 256)


def merge_masked(old: Column, new: Column, mask: Column) -> Column:
    """Bytes of new where the mask holds, of old elsewhere (OP-X22)."""
    return F.zip_with(F.arrays_zip(old.alias("o"), new.alias("n")), mask, lambda p, m: F.when(m, p["n"]).otherwise(p["o"]))


def to_dense(values: Column, mask: Column) -> Column:
    """Sparse values put where the mask holds, zero elsewhere (OP-X22)."""
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("out"))
    step = lambda s, m: F.struct((s["k"] + m.cast("int")).alias("k"), F.array_append(s["out"], F.when(m, F.coalesce(F.get(values, s["k"]).cast("int"), F.lit(0))).otherwise(0)).alias("out"))
    return F.aggregate(mask, start, step, lambda s: s["out"])


def merge_metadata(old: Column, new: Column) -> Column:
    """Both maps; where both have a key, the new value, unless it is empty (OP-X24)."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    value = lambda k: F.coalesce(F.nullif(F.element_at(new, k), F.lit("")), F.element_at(old, k), F.lit(""))
    return F.map_from_arrays(keys, F.transform(keys, value))


def only_keys(meta: Column, *keys: str) -> Column:
    return F.map_filter(meta, lambda k, _: k.isin(*keys))


def from_millis(ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Milliseconds since the epoch as text in the session's zone, which is UTC (OP-X25)."""
    return F.date_format(F.timestamp_millis(ms), pattern)


def rotate_left(items: Column, n: Column) -> Column:
    k = F.pmod(n, F.greatest(F.size(items), F.lit(1))).cast("int")
    return F.concat(F.slice(items, k + 1, F.size(items)), F.slice(items, F.lit(1), k))


def best_subset_sum(weights: Column, capacity: int) -> Column:
    """The largest sum of some weights that is within a capacity (OP-X29): a fold over the sums that can be reached."""
    start = F.array(F.lit(0))
    step = lambda sums, w: F.array_distinct(F.concat(sums, F.filter(F.transform(sums, lambda s: s + w), lambda s: s <= capacity)))
    return F.aggregate(weights.cast("array<int>"), start, step, lambda sums: F.array_max(sums))


def lanes(a: Column, b: Column, op: str) -> Column:
    """An operation of two lists lane by lane, in single precision (OP-M29)."""
    do = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}[op]
    return F.zip_with(a, b, lambda x, y: do(x.cast("float"), y.cast("float")).cast("float"))


#: Size that a population is refilled to, and multiplier and increment of the generator of pairs.
POPULATION, MULTIPLIER, INCREMENT = 100, 6364136223846793005, 1


def genetic(population: Column, generations: int, fitness: Callable[[int], int] = int) -> Column:
    """The best of a population, a list of non-negative longs, after some generations (OP-X30).

    A generation keeps the half of the least fitness and refills to POPULATION with means, rounded down, of two members,
    children among them, which the generator picks; each list starts it at one. The result is the largest by fitness, of
    equals the last. A list of under two members leaves nothing to keep: null. Each row is a search of its own, so rows
    are all there is to distribute.
    """

    @F.pandas_udf("long")
    def search(lists: pd.Series) -> pd.Series:
        return pd.Series([_searched(list(map(int, x)), generations, fitness) if x is not None else None for x in lists], dtype="Int64")

    return search(population)


def _searched(members: list[int], generations: int, fitness: Callable[[int], int]) -> int | None:
    state = 1

    def pick() -> int:
        nonlocal state
        state = (state * MULTIPLIER + INCREMENT) & 0xFFFFFFFFFFFFFFFF
        return members[state % len(members)]

    for _ in range(generations):
        members = sorted(members, key=fitness)
        del members[len(members) // 2 :]
        if not members:
            return None
        while len(members) < POPULATION:
            a, b = pick(), pick()
            members.append((a + b) // 2)
    return max(reversed(members), key=fitness) if members else None

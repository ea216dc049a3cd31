"""Graphs of functions over columns, compiled to one plan (OP-M14 to OP-M17, OP-X7)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Function = Callable[[Mapping[str, Column]], Mapping[str, Column]]


def dependency_order(nodes: Sequence[str], edges: Sequence[tuple[str, str]]) -> list[list[str]]:
    """Levels of nodes such that edges (from, to) lead to a later level; within one, in the order of names.

    Nodes are those of a user's plan, not data. Raises on a cycle (OP-G9, OP-Y14).
    """
    waits = {n: {a for a, b in edges if b == n} for n in nodes}
    levels: list[list[str]] = []
    while waits:
        ready = sorted(n for n, w in waits.items() if not w)
        if not ready:
            raise ValueError(f"cycle among {sorted(waits)}")
        levels.append(ready)
        waits = {n: w - set(ready) for n, w in waits.items() if n not in ready}
    return levels


def execute_graph(df: DataFrame, functions: Mapping[str, Function], edges: Sequence[tuple[str, str]], inputs: Mapping[str, str]) -> DataFrame:
    """Run a graph of functions on each row (OP-M14).

    Each function maps named columns to named columns. A node sees the inputs and its predecessors' outputs, later
    predecessors (by name) first to be heard. Outputs are columns `node.output`. Each level is one projection.
    """
    made: dict[str, list[str]] = {}
    base = {name: column for name, column in inputs.items()}
    for level in dependency_order(list(functions), edges):
        new: dict[str, Column] = {}
        for node in level:
            seen = {name: F.col(f"`{c}`") for name, c in base.items()}
            for before in sorted(a for a, b in edges if b == node):
                seen |= {c.partition(".")[2]: F.col(f"`{c}`") for c in made[before]}
            out = functions[node](seen)
            made[node] = [f"{node}.{name}" for name in out]
            new |= {f"{node}.{name}": c for name, c in out.items()}
        df = df.withColumns(new)
    return df


def compose(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A pipeline of table functions (OP-M16)."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def verify_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs gave, with the side (OP-M15); empty if the runs agree, repeats included."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def gated(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows with the name of the first gate that they fail, null if they pass all (OP-M17)."""
    gate = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]) if checks else F.lit(None).cast("string")
    return df.withColumn("gate", gate)


_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}


def expression(tree: object) -> Column:
    """A column from an expression tree: a number or text, {"col": name}, {"op": op, "args": [a, b]} or
    {"if": [condition, then, else]} (OP-X6, OP-X7). Everything runs in generated code."""
    if not isinstance(tree, Mapping):
        return F.lit(tree)
    if "col" in tree:
        return F.col(tree["col"])
    if "if" in tree:
        test, yes, no = map(expression, tree["if"])
        return F.when(test, yes).otherwise(no)
    if tree["op"] not in _BINARY:
        raise ValueError(f"unknown operation {tree['op']}")
    return reduce(_BINARY[tree["op"]], map(expression, tree["args"]))


def stack_program(code: Sequence[tuple]) -> Column:
    """A column from a stack program: ("push", value), ("load", column) or (operation,), which takes the two on top."""
    stack: list[Column] = []
    for op, *args in code:
        if op == "push":
            stack.append(F.lit(args[0]))
        elif op == "load":
            stack.append(F.col(args[0]))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(_BINARY[op](a, b))
    if len(stack) != 1:
        raise ValueError("a program leaves one value")
    return stack[0]

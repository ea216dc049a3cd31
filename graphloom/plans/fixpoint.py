"""Semi-naive fixpoints: each round joins only what the round before found."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.store import drop_table, materialize

Step = Callable[[DataFrame], DataFrame]

#: Rounds after which what was found so far is written as one table.
COMPACT = 8


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def grow(start: DataFrame, step: Step, keys: Sequence[str], max_rounds: int = 10_000) -> DataFrame:
    """All rows that `step` derives from `start`, again and again, the first by `keys` counting.

    step(frontier) gives candidates; those whose keys are known are dropped by an anti join; the loop ends when none is
    left. Each round's rows are a table of their own; known rows are only read. The driver sees whether a round is empty.
    """
    keys = list(keys)
    frontier = materialize(start.dropDuplicates(keys), "found")
    found = [frontier]
    for _ in range(max_rounds):
        known = _union(found).select(keys)
        frontier = materialize(step(frontier).dropDuplicates(keys).join(known, keys, "left_anti").select(start.columns), "found")
        if frontier.isEmpty():
            return _union(found)
        found.append(frontier)
        if len(found) > COMPACT:
            old, found = found[:-1], [materialize(_union(found[:-1]), "found"), frontier]
            for t in old:
                drop_table(t)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def relax(start: DataFrame, step: Step, keys: Sequence[str], value: str, max_rounds: int = 10_000) -> DataFrame:
    """The least `value` for each key that `step` derives from `start`: rows (keys..., value).

    A round's frontier holds the keys whose value fell. Partial aggregation takes the least candidate before the
    shuffle. Raises if it does not settle in `max_rounds`, as with a negative cycle.
    """
    keys = list(keys)
    least = lambda df: df.groupBy(*keys).agg(F.min(value).alias(value))
    state = frontier = materialize(least(start), "state")
    for _ in range(max_rounds):
        better = least(step(frontier)).withColumnRenamed(value, "__new")
        joined = better.join(state, keys, "left").where(F.col(value).isNull() | (F.col("__new") < F.col(value)))
        fallen = materialize(joined.select(*keys, F.col("__new").alias(value)), "state")
        if fallen.isEmpty():
            return state
        old = state
        state = materialize(least(state.unionByName(fallen)), "state")
        if old is not frontier:
            drop_table(old)
        frontier = fallen
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")

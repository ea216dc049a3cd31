"""Queries over the star-schema tables, one or more for each operator."""

from graphloom.queries import analysis, graphs, inout, relations, rules, scalars, versions  # noqa: F401
from graphloom.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

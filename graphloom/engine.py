"""One object for a session: named tables, graphs, rules, requests in JSON, and Spark SQL over all of them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import rules as R
from graphloom.operators.relational import query_request


class Graph:
    """Nodes (id, ...) and edges (src, dst, ...) with the graph operators as methods."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    def of_kind(self, *kinds: str) -> Graph:
        """The same nodes with the edges of some kinds; the filter reaches the scan."""
        return Graph(self.nodes, self.edges.where(F.col("kind").isin(*kinds)))

    def reverse(self) -> Graph:
        return Graph(self.nodes, G.reverse(self.edges))

    def reach(self, roots: DataFrame) -> DataFrame:
        return G.reach(self.edges, roots, self.nodes)

    def levels(self, roots: DataFrame) -> DataFrame:
        return G.levels(self.nodes, self.edges, roots)

    def closure(self, starts: DataFrame | None = None) -> DataFrame:
        return G.closure(self.edges, starts)

    def order(self) -> DataFrame:
        return G.peel(self.nodes, self.edges)

    def components(self) -> DataFrame:
        return G.scc(self.nodes, self.edges)

    def shortest(self, source: object) -> DataFrame:
        return G.shortest(self.nodes, self.edges, source)

    def dominators(self, entry: object) -> DataFrame:
        return G.dominators(self.edges, entry)

    def degrees(self) -> DataFrame:
        return G.degrees(self.nodes, self.edges)

    def csr(self) -> DataFrame:
        return G.csr(self.nodes, self.edges)


class Engine:
    """Tables by name; every one is a view, so results of operators can be asked for in Spark SQL."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        return df

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def graph(self, nodes: str, edges: str) -> Graph:
        return Graph(self.table(nodes), self.table(edges))

    def validate(self, names: Sequence[str], rules: Sequence = R.STANDARD_RULES) -> DataFrame:
        """Violations of the rules over registered tables of these names."""
        return R.validate({n: self.table(n) for n in names}, rules)

    def symbols(self, table: str, request: str | Mapping[str, object]) -> DataFrame:
        """Symbols that a request, as a mapping or JSON text, asks for (OP-F1, OP-F2)."""
        return query_request(self.table(table), json.loads(request) if isinstance(request, str) else request)

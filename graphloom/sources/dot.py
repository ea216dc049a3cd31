"""DOT graphs in and out (OP-S13, OP-K6, OP-U3, OP-Y11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ID = r'"?([A-Za-z0-9_.:]+)"?'


def parse_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, cluster) and edges (src, dst, label) of DOT text, one row a line: (graph, pos, line) (OP-S13).

    A line `subgraph cluster_x {` opens a cluster, `}` closes it; which one a line is in is the last open one before it.
    """
    w = Window.partitionBy("graph").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("line", r"^\s*subgraph\s+" + r'"?cluster_([A-Za-z0-9_.:]+)"?', 1)
    mark = F.when(name != "", name).when(F.trim("line") == "}", F.lit(""))
    rows = lines.withColumn("cluster", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))
    edge = r"^\s*" + _ID + r"\s*->\s*" + _ID
    label = F.nullif(F.regexp_extract("line", r'label\s*=\s*"([^"]*)"', 1), F.lit(""))
    edges = rows.where(F.col("line").rlike(edge)).select("graph", F.regexp_extract("line", edge, 1).alias("src"), F.regexp_extract("line", edge, 2).alias("dst"), label.alias("label"))
    node = r"^\s*" + _ID + r"\s*(\[.*\])?\s*;?\s*$"
    plain = F.col("line").rlike(node) & ~F.col("line").rlike(r"^\s*(digraph|graph|node|edge|subgraph|rankdir|label)\b") & ~F.col("line").contains("->")
    nodes = rows.where(plain & F.col("line").rlike(r"[A-Za-z0-9]")).select("graph", F.regexp_extract("line", node, 1).alias("id"), label.alias("label"), "cluster")
    return nodes, edges


def dot_lines(nodes: DataFrame, edges: DataFrame, cluster: Column | None = None) -> DataFrame:
    """(pos, line) of a DOT text of nodes (id, label) and edges (src, dst), in the order of ids, by cluster if one is given
    (OP-K6). Rows, so that a large graph is written by many tasks; sort by pos to read it."""
    group = F.coalesce(cluster.cast("string"), F.lit("")) if cluster is not None else F.lit("")
    n = nodes.select(group.alias("c"), F.col("id").cast("string").alias("i"), F.coalesce("label", F.col("id").cast("string")).alias("l"))
    own = n.select(F.concat_ws("|", F.lit("1"), "c", F.lit("1"), "i").alias("pos"), F.concat(F.lit('  "'), "i", F.lit('" [label="'), "l", F.lit('"];')).alias("line"))
    heads = n.where("c != ''").select("c").distinct()
    opened = heads.select(F.concat_ws("|", F.lit("1"), "c", F.lit("0")).alias("pos"), F.concat(F.lit('subgraph "cluster_'), "c", F.lit('" {')).alias("line"))
    closed = heads.select(F.concat_ws("|", F.lit("1"), "c", F.lit("2")).alias("pos"), F.lit("}").alias("line"))
    arrows = edges.select(F.concat_ws("|", F.lit("2"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("pos"), F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("line"))
    ends = nodes.sparkSession.createDataFrame([("0", "digraph {"), ("3", "}")], "pos string, line string")
    return ends.unionByName(opened).unionByName(own).unionByName(closed).unionByName(arrows)


def flat_dependencies(edges: DataFrame) -> DataFrame:
    """(src, line): `a: b, c` for each source (OP-K6)."""
    targets = F.array_join(F.sort_array(F.collect_set(F.col("dst").cast("string"))), ", ")
    return edges.groupBy("src").agg(targets.alias("t")).select("src", F.concat(F.col("src").cast("string"), F.lit(": "), "t").alias("line"))


def topology(nodes: DataFrame) -> DataFrame:
    """(cluster, members) in order: the files that a graph's clusters stand for (OP-Y11)."""
    return nodes.where("cluster is not null").groupBy("cluster").agg(F.sort_array(F.collect_set("id")).alias("members"))

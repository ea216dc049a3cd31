"""Graphs, logs and artifact tables derived from the star-schema tables, as DataFrames and as SQL with the same rows.

Node ids of `model`: region r, nation 100 + n, supplier 1000 + s, customer 1,000,000 + c, part 2,000,000 + p (times ten
thousand more where tables grow, so ids of different kinds never meet).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First ids of the kinds.
NATION, SUPPLIER, CUSTOMER, PART = 100, 1_000, 10_000_000_000, 20_000_000_000


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def flow(t: Tables) -> DataFrame:
    """(src, dst, weight): the two nations that each customer nation buys most lines from, its own left out."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = lines.where("c_nationkey != s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("weight"))
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return counts.withColumn("r", best).where("r <= 2").drop("r")


FLOW = """pairs_of_nations AS (
    SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY ALL),
    flow AS (SELECT * FROM pairs_of_nations QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2)"""


def nations(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


NATIONS = "nodes AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation)"


def dag(t: Tables) -> DataFrame:
    """(src, dst, weight): the edges of flow turned towards the larger key, and a chain 0, 4, 8, ..."""
    f = flow(t)
    turned = f.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    chain = t.nation.where("n_nationkey % 4 = 0 and n_nationkey < 24").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") + 4).cast("long").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return turned.unionByName(chain).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


DAG = FLOW + """, dag AS (
    SELECT src, dst, sum(weight)::BIGINT AS weight FROM (
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM flow
        UNION ALL SELECT n_nationkey::BIGINT, n_nationkey::BIGINT + 4, 1 FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey < 24)
    GROUP BY 1, 2)"""


def model_nodes(t: Tables) -> DataFrame:
    """(id, kind, name, visibility, unsafe, struct, trait) of a program-like model."""

    def part(df: DataFrame, first: int, key: str, kind: str, name: str, visibility: str = "'pub'", unsafe: str = "false") -> DataFrame:
        return df.select((F.col(key).cast("long") + first).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.expr(visibility).alias("visibility"), F.expr(unsafe).alias("unsafe"))

    out = part(t.region, 0, "r_regionkey", "Crate", "r_name").unionByName(part(t.nation, NATION, "n_nationkey", "Module", "n_name"))
    out = out.unionByName(part(t.supplier, SUPPLIER, "s_suppkey", "Struct", "s_name", "if(s_acctbal < 0, 'private', 'pub')"))
    out = out.unionByName(part(t.customer, CUSTOMER, "c_custkey", "Function", "c_mktsegment", "case when c_acctbal < 0 then 'private' when c_custkey % 5 = 0 then 'crate' else 'pub' end", "c_custkey % 11 = 0"))
    return out.unionByName(part(t.part, PART, "p_partkey", "Impl", "p_brand"))


MODEL_NODES = f"""model AS (
    SELECT r_regionkey::BIGINT AS id, 'Crate' AS kind, r_name AS name, 'pub' AS visibility, false AS unsafe FROM region
    UNION ALL SELECT n_nationkey::BIGINT + {NATION}, 'Module', n_name, 'pub', false FROM nation
    UNION ALL SELECT s_suppkey + {SUPPLIER}, 'Struct', s_name, CASE WHEN s_acctbal < 0 THEN 'private' ELSE 'pub' END, false FROM supplier
    UNION ALL SELECT c_custkey + {CUSTOMER}, 'Function', c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'private' WHEN c_custkey % 5 = 0 THEN 'crate' ELSE 'pub' END, c_custkey % 11 = 0 FROM customer
    UNION ALL SELECT p_partkey + {PART}, 'Impl', p_brand, 'pub', false FROM part)"""


def model_edges(t: Tables) -> DataFrame:
    """(src, dst, kind): Contains down to functions and structs, Calls halving keys with a few cycles, Resolves from
    functions and ImplFor from impls to structs."""
    e = lambda df, src, dst, kind: df.select(F.expr(f"cast({src} as bigint)").alias("src"), F.expr(f"cast({dst} as bigint)").alias("dst"), F.lit(kind).alias("kind"))
    out = e(t.nation, "n_regionkey", f"n_nationkey + {NATION}", "Contains")
    out = out.unionByName(e(t.supplier, f"s_nationkey + {NATION}", f"s_suppkey + {SUPPLIER}", "Contains"))
    out = out.unionByName(e(t.customer, f"c_nationkey + {NATION}", f"c_custkey + {CUSTOMER}", "Contains"))
    out = out.unionByName(e(t.customer.where("c_custkey >= 2"), f"c_custkey + {CUSTOMER}", f"c_custkey div 2 + {CUSTOMER}", "Calls"))
    out = out.unionByName(e(t.customer.where("c_custkey < 700 and c_custkey % 97 = 0"), f"c_custkey + {CUSTOMER}", f"c_custkey * 2 + 1 + {CUSTOMER}", "Calls"))
    out = out.unionByName(e(t.customer, f"c_custkey + {CUSTOMER}", f"c_custkey % 97 + 1 + {SUPPLIER}", "Resolves"))
    return out.unionByName(e(t.part, f"p_partkey + {PART}", f"p_partkey % 113 + 1 + {SUPPLIER}", "ImplFor"))


MODEL_EDGES = f"""hints AS (
    SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT + {NATION} AS dst, 'Contains' AS kind FROM nation
    UNION ALL SELECT s_nationkey + {NATION}, s_suppkey + {SUPPLIER}, 'Contains' FROM supplier
    UNION ALL SELECT c_nationkey + {NATION}, c_custkey + {CUSTOMER}, 'Contains' FROM customer
    UNION ALL SELECT c_custkey + {CUSTOMER}, c_custkey // 2 + {CUSTOMER}, 'Calls' FROM customer WHERE c_custkey >= 2
    UNION ALL SELECT c_custkey + {CUSTOMER}, c_custkey * 2 + 1 + {CUSTOMER}, 'Calls' FROM customer WHERE c_custkey < 700 AND c_custkey % 97 = 0
    UNION ALL SELECT c_custkey + {CUSTOMER}, c_custkey % 97 + 1 + {SUPPLIER}, 'Resolves' FROM customer
    UNION ALL SELECT p_partkey + {PART}, p_partkey % 113 + 1 + {SUPPLIER}, 'ImplFor' FROM part)"""


def log(t: Tables) -> DataFrame:
    """(seq, op, key, payload): events as a change log of users; an error removes its user."""
    rows = t.events.select((F.col("event_id")).alias("seq"), F.expr("if(event_type = 'error', 'RemoveNode', 'UpdateNode')").alias("op"), F.col("user_id").alias("key"), F.concat_ws(":", "event_type", "event_id").alias("payload"), "ts", "value")
    return rows


LOG = """log AS (
    SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'RemoveNode' ELSE 'UpdateNode' END AS op, user_id AS key,
           event_type || ':' || event_id AS payload, ts, value FROM events)"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text")


def closure_sql(edges: str, extra: str = "") -> str:
    """A recursive CTE `closure(src, dst)` over a CTE of edges."""
    return f"closure AS (SELECT src, dst FROM {edges} {extra} UNION SELECT c.src, e.dst FROM closure c JOIN {edges} e ON c.dst = e.src)"

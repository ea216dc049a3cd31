"""Graph and fixpoint operators (OP-G*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators.relational import reconnect
from graphloom.queries.registry import query
from graphloom.recipes import DAG, FLOW, NATIONS, Tables, closure_sql, dag, flow, nations

CLOSURE = closure_sql("flow")
REACH = "reach AS (SELECT id FROM roots UNION SELECT dst FROM reach JOIN flow ON src = id)"
ROOTS = "roots AS (SELECT id FROM nodes WHERE id IN (0, 1))"
#: Mutual reach, by least id.
SCC = f"""{CLOSURE}, comp AS (SELECT id, least(id, coalesce(min(other), id)) AS component FROM nodes LEFT JOIN
    (SELECT a.src, a.dst AS other FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src) ON src = id GROUP BY id)"""


def roots(t: Tables) -> DataFrame:
    return nations(t).where("id in (0, 1)").select("id")


@query(f"WITH {FLOW} SELECT src, dst FROM flow UNION ALL SELECT dst, src FROM flow")
def g1_undirected(t: Tables) -> DataFrame:
    return G.undirected(flow(t)).select("src", "dst")


@query(f"""WITH {FLOW}, {NATIONS}, d AS (SELECT id, count(src) AS degree, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbours FROM nodes LEFT JOIN flow ON src = id GROUP BY id)
    SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr, degree, coalesce(neighbours, '') AS neighbours FROM d""")
def g2_csr(t: Tables) -> DataFrame:
    return G.csr(nations(t), flow(t), per_range=6).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query(f"WITH {FLOW} SELECT dst FROM flow WHERE src = 3")
def g3_neighbours(t: Tables) -> DataFrame:
    return G.neighbours(flow(t), 3)


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, roots AS (SELECT 5::BIGINT AS id), {REACH} SELECT id FROM reach")
def g4_dfs_set(t: Tables) -> DataFrame:
    return G.reach(flow(t), nations(t).where("id = 5"))


LEVELS = f"""WITH RECURSIVE {FLOW}, {NATIONS}, {ROOTS}, walk AS (SELECT id, 0 AS level FROM roots UNION SELECT dst, level + 1 FROM walk JOIN flow ON src = id WHERE level < 30)
    SELECT nodes.id, coalesce(min(level), -1)::INT AS level FROM nodes LEFT JOIN walk USING (id) GROUP BY 1"""


@query(LEVELS)
def g5_bfs_levels(t: Tables) -> DataFrame:
    return G.levels(nations(t), flow(t), roots(t))


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {ROOTS}, {REACH} SELECT id FROM reach")
def g6_reachability(t: Tables) -> DataFrame:
    missing = t.spark.range(9_000, 9_001)
    return G.reach(flow(t), roots(t).unionByName(missing), nations(t))


@query(f"WITH RECURSIVE {FLOW}, {CLOSURE}, cyclic AS (SELECT src AS id FROM closure WHERE src = dst) SELECT count(*) = 0 AS acyclic FROM cyclic")
def g7_is_acyclic(t: Tables) -> DataFrame:
    return G.is_acyclic(nations(t), flow(t)).select("acyclic")


PEEL = f"""WITH RECURSIVE {DAG}, {NATIONS}, walk AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT dst FROM dag) UNION SELECT dst, level + 1 FROM walk JOIN dag ON src = id)
    SELECT id, max(level)::INT AS level FROM walk GROUP BY id"""


@query(PEEL)
def g8_topological_levels(t: Tables) -> DataFrame:
    return G.peel(nations(t), dag(t))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {CLOSURE}, bad AS (SELECT id FROM nodes JOIN closure ON id = dst JOIN (SELECT src AS c FROM closure WHERE src = dst) ON src = c)
    SELECT id, id IN (SELECT id FROM bad) AS cyclic FROM nodes""")
def g9_order_or_cycle(t: Tables) -> DataFrame:
    return G.peel(nations(t), flow(t)).select("id", F.col("level").isNull().alias("cyclic"))


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {SCC} SELECT id, component FROM comp")
def g10_scc(t: Tables) -> DataFrame:
    return G.scc(nations(t), flow(t))


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {SCC} SELECT component, count(*) AS members FROM comp GROUP BY 1")
def g11_scc_sizes(t: Tables) -> DataFrame:
    return G.scc(nations(t), flow(t)).groupBy("component").agg(F.count("*").alias("members"))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {SCC}, groups AS (
        SELECT component, CASE WHEN count(*) = 1 THEN min(name) ELSE '[cycle: ' || string_agg(name, ', ' ORDER BY name) || ']' END AS label FROM comp JOIN nodes USING (id) GROUP BY 1),
    e AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM flow JOIN comp a ON flow.src = a.id JOIN comp b ON flow.dst = b.id WHERE a.component <> b.component)
    SELECT a.label AS from_label, b.label AS to_label FROM e JOIN groups a ON src = a.component JOIN groups b ON dst = b.component""")
def g12_condensation(t: Tables) -> DataFrame:
    comps = G.scc(nations(t), flow(t)).join(nations(t), "id")
    groups, edges = G.condense(flow(t), comps, F.col("name"))
    a = groups.select(F.col("component").alias("src"), F.col("label").alias("from_label"))
    b = groups.select(F.col("component").alias("dst"), F.col("label").alias("to_label"))
    return edges.join(a, "src").join(b, "dst").select("from_label", "to_label")


def _shortest_sql(weight: str) -> str:
    return f"""WITH RECURSIVE {FLOW}, {NATIONS}, e AS (SELECT src, dst, {weight} AS weight FROM flow), walk AS (SELECT 0::BIGINT AS id, 0::BIGINT AS distance, 0 AS n
        UNION SELECT dst, distance + weight, n + 1 FROM walk JOIN e ON src = id WHERE n < 10)
        SELECT nodes.id, min(distance) AS distance FROM nodes LEFT JOIN walk USING (id) GROUP BY 1"""


@query(_shortest_sql("(weight % 7 + 1)::BIGINT"))
def g13_dijkstra(t: Tables) -> DataFrame:
    return G.shortest(nations(t), flow(t).withColumn("weight", F.expr("weight % 7 + 1")), 0)


@query(f"""WITH RECURSIVE {DAG}, {NATIONS}, e AS (SELECT src, dst, (weight % 7 - 2)::BIGINT AS weight FROM dag), walk AS (SELECT 0::BIGINT AS id, 0::BIGINT AS distance
        UNION SELECT dst, distance + weight FROM walk JOIN e ON src = id)
    SELECT nodes.id, min(distance) AS distance FROM nodes LEFT JOIN walk USING (id) GROUP BY 1""")
def g14_bellman_ford(t: Tables) -> DataFrame:
    return G.shortest(nations(t), dag(t).withColumn("weight", F.expr("weight % 7 - 2")), 0)


@query("SELECT distance FROM (" + _shortest_sql("(weight % 5 + 2)::BIGINT") + ") WHERE id = 12")
def g15_a_star_cost(t: Tables) -> DataFrame:
    return G.shortest(nations(t), flow(t).withColumn("weight", F.expr("weight % 5 + 2")), 0).where("id = 12").select("distance")


DOMINATORS = f"""{DAG}, live AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM live JOIN dag ON src = id),
    ways AS (SELECT id AS without, 0::BIGINT AS node FROM live WHERE id <> 0 UNION SELECT without, dst FROM ways JOIN dag ON src = node WHERE dst <> without),
    doms AS (SELECT v.id AS node, d.id AS dominator FROM live v, live d WHERE NOT EXISTS (FROM ways WHERE without = d.id AND node = v.id))"""


@query(f"WITH RECURSIVE {DOMINATORS} SELECT node, dominator FROM doms")
def g16_dominators(t: Tables) -> DataFrame:
    return G.dominators(dag(t), 0)


@query(f"""WITH RECURSIVE {DOMINATORS} SELECT node, arg_max(dominator, depth) AS idom FROM doms JOIN (SELECT node AS d, count(*) AS depth FROM doms GROUP BY 1) ON d = dominator
    WHERE node <> dominator GROUP BY 1""")
def g17_immediate_dominators(t: Tables) -> DataFrame:
    return G.immediate_dominators(G.dominators(dag(t), 0))


FACTS = "facts AS (SELECT id AS block, 'd' || id AS def FROM nodes WHERE id % 3 = 0), kills AS (SELECT id AS block, 'd' || (id - id % 6) AS def FROM nodes WHERE id % 6 <> 0 AND id % 5 = 0)"


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {FACTS}, outs AS (SELECT block, def FROM facts UNION SELECT dst, o.def FROM outs o JOIN flow ON src = o.block
    WHERE NOT EXISTS (FROM kills k WHERE k.block = dst AND k.def = o.def)) SELECT block, def FROM outs""")
def g18_reaching_definitions(t: Tables) -> DataFrame:
    n = nations(t)
    gen = n.where("id % 3 = 0").select(F.col("id").alias("block"), F.concat(F.lit("d"), "id").alias("def"))
    kill = n.where("id % 6 != 0 and id % 5 = 0").select(F.col("id").alias("block"), F.concat(F.lit("d"), F.expr("id - id % 6")).alias("def"))
    return G.reaching_definitions(flow(t).select(F.col("dst").alias("block"), F.col("src").alias("pred")), gen, kill)


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {ROOTS}, {REACH} SELECT src, dst FROM flow WHERE src IN (FROM reach) AND dst IN (FROM reach)")
def g19_mark_sweep(t: Tables) -> DataFrame:
    return G.sweep(nations(t), flow(t), roots(t))[1].select("src", "dst")


@query(f"""WITH RECURSIVE {DAG}, {NATIONS}, walk AS (SELECT id, 0 AS depth FROM nodes WHERE id NOT IN (SELECT src FROM dag) UNION SELECT src, depth + 1 FROM walk JOIN dag ON dst = id)
    SELECT id, max(depth)::INT AS depth FROM walk GROUP BY id""")
def g20_chain_depth(t: Tables) -> DataFrame:
    return G.chain_depth(nations(t), dag(t))


@query(f"WITH RECURSIVE {FLOW}, {CLOSURE}, asked AS (SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey) SELECT a, b FROM asked WHERE a <> b AND NOT EXISTS (FROM closure WHERE src = a AND dst = b)")
def g21_closure_permission(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("a"), "n_regionkey")
    asked = n.join(n.withColumnRenamed("a", "b"), "n_regionkey").where("a != b").select("a", "b")
    return asked.join(G.closure(flow(t)).select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {SCC}, several AS (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1),
    walk AS (SELECT component, dst AS id, 1 AS n FROM several JOIN flow ON src = component UNION SELECT w.component, f.dst, n + 1 FROM walk w JOIN flow f ON f.src = w.id WHERE n < 25)
    SELECT component, min(n)::INT AS length, true AS holds FROM walk WHERE id = component GROUP BY 1""")
def g22_witness_cycle(t: Tables) -> DataFrame:
    """The length of each component's cycle, and whether it begins and ends at its least node and goes along edges."""
    edges = flow(t)
    cycles = G.witness_cycle(edges, G.scc(nations(t), edges)).select("component", "path", (F.size("path") - 1).alias("length"))
    steps = cycles.select("component", F.explode(F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("s")).select("component", "s.*")
    broken = steps.join(edges, ["src", "dst"], "left_anti").select("component").distinct().withColumn("broken", F.lit(True))
    ends = (F.element_at("path", 1) == F.col("component")) & (F.element_at("path", -1) == F.col("component"))
    return cycles.join(broken, "component", "left").select("component", "length", (ends & F.col("broken").isNull()).alias("holds"))


@query(f"""WITH RECURSIVE {DAG}, {NATIONS}, total AS (SELECT dst, sum(weight) AS w FROM dag GROUP BY 1),
    walk AS (SELECT id, 1.0::DOUBLE AS part FROM nodes WHERE id NOT IN (SELECT dst FROM dag) UNION ALL SELECT dag.dst, part * weight / w FROM walk JOIN dag ON src = id JOIN total ON total.dst = dag.dst)
    SELECT id, round(sum(part), 9) AS score FROM walk GROUP BY 1""")
def g23_trust(t: Tables) -> DataFrame:
    return G.trust(nations(t), dag(t)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {FLOW} SELECT src, dst FROM flow WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) OR dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4)")
def g24_broken_edges(t: Tables) -> DataFrame:
    known = t.nation.where("n_regionkey != 4").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.broken_edges(known, flow(t)).select("src", "dst")


@query(PEEL.replace("AS level FROM walk GROUP", "AS batch FROM walk GROUP"))
def g25_batches(t: Tables) -> DataFrame:
    return G.batches(nations(t), dag(t))


@query(f"""WITH RECURSIVE {DAG}, {NATIONS}, own AS (SELECT id, list_append(coalesce((SELECT list(src) FROM dag WHERE dst = id), []), id) AS own FROM nodes),
    fold AS (SELECT id, own AS taken, 0 AS batch FROM own WHERE id = 0 UNION ALL SELECT o.id, CASE WHEN list_has_any(taken, o.own) THEN o.own ELSE list_concat(taken, o.own) END, batch + CASE WHEN list_has_any(taken, o.own) THEN 1 ELSE 0 END FROM fold f JOIN own o ON o.id = f.id + 1)
    SELECT id, batch FROM fold""")
def g25_shared_batches(t: Tables) -> DataFrame:
    return G.batches(nations(t).withColumn("pos", F.col("id")), dag(t), shared=True)


@query("""SELECT DISTINCT a.n_name AS src, b.r_name AS dst FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN region b ON (s_suppkey % 5) = b.r_regionkey
    WHERE NOT starts_with(a.n_name, b.r_name)""")
def g26_module_graph(t: Tables) -> DataFrame:
    files = t.supplier.select("s_nationkey", F.expr("cast(s_suppkey % 5 as int)").alias("dep"))
    edges = files.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), "s_nationkey").join(t.region.select(F.col("r_regionkey").alias("dep"), F.col("r_name").alias("dst")), "dep")
    return edges.where(~F.col("src").startswith(F.col("dst"))).select("src", "dst").distinct()


@query(f"WITH {DAG} SELECT src, dst FROM flow UNION SELECT src, dst FROM dag")
def g27_workspace(t: Tables) -> DataFrame:
    return flow(t).select("src", "dst").union(dag(t).select("src", "dst")).distinct()


USES = "uses AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'reexport' ELSE 'glob' END AS kind, p_brand AS module, p_type AS path FROM part)"


@query(f"WITH {USES} SELECT id, module AS src, CASE WHEN kind = 'glob' THEN regexp_replace(path, ' [^ ]*$', '') ELSE path END AS dst, kind FROM uses")
def g28_import_graph(t: Tables) -> DataFrame:
    kind = F.expr("case p_size % 3 when 0 then 'simple' when 1 then 'reexport' else 'glob' end")
    uses = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("src"), "p_type", kind.alias("kind"))
    return uses.select("id", "src", F.when(F.col("kind") == "glob", F.regexp_replace("p_type", " [^ ]*$", "")).otherwise(F.col("p_type")).alias("dst"), "kind")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey >= 3 AND p_partkey % 10 <> 0),
    walk AS (SELECT p_partkey AS id, p_partkey AS last, 0 AS hops FROM part UNION ALL SELECT id, dst, hops + 1 FROM walk JOIN p ON last = src)
    SELECT id, arg_max(last, hops) AS last, max(hops)::INT AS hops FROM walk GROUP BY id""")
def g29_alias_chains(t: Tables) -> DataFrame:
    pointers = t.part.where("p_partkey >= 3 and p_partkey % 10 != 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"))
    return G.chase(pointers, t.part.select(F.col("p_partkey").alias("id")))


@query(f"""WITH RECURSIVE {DAG}, u AS (SELECT src, dst FROM dag WHERE src % 4 = 0),
    walk AS (SELECT src AS first, [src, dst] AS path FROM u UNION ALL SELECT first, list_append(path, u.dst) FROM walk JOIN u ON u.src = path[-1] WHERE NOT list_contains(path, u.dst))
    SELECT DISTINCT first AS src, array_to_string(path, '>') AS path FROM walk WHERE path[-1] NOT IN (SELECT src FROM u) OR EXISTS (FROM u WHERE u.src = path[-1] AND list_contains(path, u.dst))""")
def g30_reexport_chains(t: Tables) -> DataFrame:
    return G.reexport_chains(dag(t).where("src % 4 = 0")).select("src", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, private AS (SELECT id FROM nodes WHERE id % 3 = 0), {CLOSURE}
    SELECT DISTINCT src AS leaked, dst AS seen_in FROM closure JOIN private ON src = id JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey""")
def g31_visibility_leaks(t: Tables) -> DataFrame:
    region = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    pairs = G.closure(flow(t), nations(t).where("id % 3 = 0"))
    out = pairs.join(region.withColumnsRenamed({"id": "src", "n_regionkey": "a"}), "src").join(region.withColumnsRenamed({"id": "dst", "n_regionkey": "b"}), "dst")
    return out.where("a != b").select(F.col("src").alias("leaked"), F.col("dst").alias("seen_in"))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {ROOTS}, {REACH}, dead AS (SELECT id FROM nodes WHERE id NOT IN (FROM reach)),
    takes AS (SELECT DISTINCT s_nationkey::BIGINT AS id, p_brand AS type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity = 1),
    shared AS (SELECT a.id, b.id AS best, count(*) AS n FROM takes a JOIN takes b USING (type) WHERE a.id IN (FROM dead) AND b.id IN (FROM reach) GROUP BY ALL),
    top AS (SELECT shared.id, best, n FROM shared JOIN nodes ON nodes.id = best QUALIFY row_number() OVER (PARTITION BY shared.id ORDER BY n DESC, length(name), best) = 1)
    SELECT dead.id, best, round(coalesce(n, 0) / ((SELECT count(*) FROM takes WHERE takes.id = dead.id) + 1.0), 9) AS score FROM dead LEFT JOIN top USING (id)""")
def g33_dead_items(t: Tables) -> DataFrame:
    """Nations that the roots do not reach, and the live one that shares most of the brands that either sells one by one."""
    live = G.reach(flow(t), roots(t))
    sold = t.lineitem.where("l_quantity = 1").select("l_suppkey", "l_partkey").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    takes = sold.groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.collect_set("p_brand").alias("inputs"))
    items = nations(t).withColumnRenamed("name", "module").join(takes, "id", "left").withColumn("inputs", F.coalesce("inputs", F.expr("cast(array() as array<string>)")))
    found = reconnect(items.join(live, "id", "left_anti"), items.join(live, "id", "left_semi"))
    return found.withColumn("score", F.round("score", 9))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, c AS (SELECT row_number() OVER (ORDER BY src, dst) AS i, src, dst FROM flow WHERE (src + dst) % 5 = 0),
    d AS (SELECT list((SELECT count(*) FROM flow WHERE src = id) ORDER BY id) AS o, list((SELECT count(*) FROM flow WHERE dst = id) ORDER BY id) AS n FROM nodes),
    fold AS (SELECT 0::BIGINT AS i, o, n, NULL::BIGINT AS src, NULL::BIGINT AS dst, false AS taken FROM d UNION ALL
        SELECT i, CASE WHEN ok THEN list_transform(o, lambda x, j: CASE WHEN j = src + 1 THEN x - 1 ELSE x END) ELSE o END, CASE WHEN ok THEN list_transform(n, lambda x, j: CASE WHEN j = dst + 1 THEN x - 1 ELSE x END) ELSE n END, src, dst, ok
        FROM (SELECT c.i, o, n, c.src, c.dst, CASE WHEN o[c.src + 1] > 0 THEN ln(o[c.src + 1]) - ln(greatest(o[c.src + 1] - 1, 1)) ELSE 0 END <= 0.5 AND o[c.src + 1] + n[c.src + 1] > 1 AND o[c.dst + 1] + n[c.dst + 1] > 1 AS ok FROM fold JOIN c ON c.i = fold.i + 1))
    SELECT src, dst, taken FROM fold WHERE i > 0""")
def g34_guarded_mutations(t: Tables) -> DataFrame:
    """Candidate edge removals in order; each is taken if the entropy of out-degrees moves by 0.5 at most, three nodes stay
    and none is left without an edge. A removal is judged against the graph that the ones before left."""
    from graphloom.operators.analysis import guarded_removals

    return guarded_removals(flow(t), flow(t).where("(src + dst) % 5 = 0"))

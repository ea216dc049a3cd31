"""Analysis domains (OP-D*) and solvers (OP-V*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import analysis as A
from graphloom.operators import graph as G
from graphloom.operators import solvers as S
from graphloom.queries.graphs import CLOSURE, SCC
from graphloom.queries.registry import query
from graphloom.recipes import CUSTOMER, DAG, FLOW, MODEL_EDGES, MODEL_NODES, NATIONS, Tables, dag, flow, model_edges, model_nodes, nations

CALLS = "calls AS (SELECT src, dst FROM hints WHERE kind = 'Calls')"
OWNERS = """up AS (SELECT id, id AS owner, 0 AS depth FROM model WHERE kind = 'Module' UNION SELECT dst, owner, depth + 1 FROM up JOIN hints ON src = id AND hints.kind = 'Contains'),
    owners AS (SELECT model.id, arg_min(owner, (depth, owner)) AS owner FROM model LEFT JOIN up ON up.id = model.id GROUP BY 1)"""


def functions(t: Tables) -> DataFrame:
    return model_nodes(t).where("kind = 'Function'")


def calls(t: Tables) -> DataFrame:
    return model_edges(t).where("kind = 'Calls'").select("src", "dst")


@query(f"WITH RECURSIVE {MODEL_EDGES}, {CALLS}, r AS (SELECT {CUSTOMER + 400}::BIGINT AS id UNION SELECT dst FROM r JOIN calls ON src = id) SELECT id FROM r")
def d1_call_reachability(t: Tables) -> DataFrame:
    return G.reach(A.call_edges(model_edges(t)), t.spark.range(CUSTOMER + 400, CUSTOMER + 401))


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {CALLS}, walk AS (SELECT {CUSTOMER + 400}::BIGINT AS id, 0 AS level UNION SELECT dst, level + 1 FROM walk JOIN calls ON src = id WHERE level < 40)
    SELECT model.id, coalesce(min(level), -1)::INT AS level FROM model LEFT JOIN walk USING (id) WHERE kind = 'Function' GROUP BY 1""")
def d2_call_depth(t: Tables) -> DataFrame:
    return G.levels(functions(t), calls(t), t.spark.range(CUSTOMER + 400, CUSTOMER + 401))


ENTRIES = "entries AS (SELECT id FROM model WHERE kind = 'Function' AND visibility = 'crate')"


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {CALLS}, {ENTRIES}, r AS (SELECT id FROM entries UNION SELECT dst FROM r JOIN calls ON src = id)
    SELECT id FROM model WHERE kind = 'Function' AND id NOT IN (FROM r)""")
def d3_dead_symbols(t: Tables) -> DataFrame:
    entries = functions(t).where(A.is_entry(F.col("name"), F.col("visibility") == "crate")).select("id")
    return A.dead_symbols(functions(t), calls(t), entries)


PAIRS = "pairs AS (SELECT n_nationkey::BIGINT AS p, (n_nationkey * 7 + 3)::BIGINT % 25 AS q FROM nation)"


@query(f"WITH RECURSIVE {FLOW}, {CLOSURE}, {PAIRS} SELECT p, q, EXISTS (FROM closure a JOIN closure b ON a.dst = b.dst WHERE a.src = p AND b.src = q) AS alias FROM pairs")
def d4_may_alias(t: Tables) -> DataFrame:
    pairs = t.nation.select(F.col("n_nationkey").cast("long").alias("p"), F.expr("cast((n_nationkey * 7 + 3) % 25 as bigint)").alias("q"))
    return A.may_alias(flow(t), pairs)


@query(f"""WITH RECURSIVE {DAG}, live AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM live JOIN dag ON src = id),
    ways AS (SELECT id AS without, 0::BIGINT AS node FROM live WHERE id <> 0 UNION SELECT without, dst FROM ways JOIN dag ON src = node WHERE dst <> without),
    doms AS (SELECT v.id AS node, d.id AS dominator FROM live v, live d WHERE NOT EXISTS (FROM ways WHERE without = d.id AND node = v.id))
    SELECT count(*) AS dominated FROM (SELECT node FROM doms GROUP BY 1 HAVING count(*) > 1)""")
def d5_dominated_blocks(t: Tables) -> DataFrame:
    return G.dominators(dag(t), 0).groupBy("node").count().where("count > 1").agg(F.count("*").alias("dominated"))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {CLOSURE}, sources AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'user' ELSE 'net' END AS label FROM nodes WHERE id % 4 < 2),
    sinks AS (SELECT id, 'net' AS label FROM nodes WHERE id % 3 = 1), ways AS (SELECT src, dst FROM closure UNION SELECT id, id FROM sources)
    SELECT DISTINCT dst AS sink, sinks.label FROM ways JOIN sources ON src = sources.id JOIN sinks ON dst = sinks.id AND sources.label = sinks.label""")
def d6_taint(t: Tables) -> DataFrame:
    n = nations(t)
    sources = n.where("id % 4 < 2").select("id", F.expr("if(id % 2 = 0, 'user', 'net')").alias("label"))
    return A.tainted_sinks(flow(t), sources, n.where("id % 3 = 1").select("id", F.lit("net").alias("label")))


LIVE = "live AS (SELECT id AS region, id * 10 AS point FROM nodes WHERE id % 6 = 0)"


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {CLOSURE}, {LIVE} SELECT region, point FROM live UNION SELECT dst, point FROM closure JOIN live ON src = region")
def d7_lifetimes(t: Tables) -> DataFrame:
    return A.propagate_regions(flow(t), nations(t).where("id % 6 = 0").select(F.col("id").alias("region"), (F.col("id") * 10).alias("point")))


@query(f"WITH RECURSIVE {DAG}, closure AS (SELECT src, dst FROM dag UNION SELECT c.src, e.dst FROM closure c JOIN dag e ON c.dst = e.src) SELECT src, dst FROM closure UNION SELECT src, src FROM dag UNION SELECT dst, dst FROM dag")
def d8_subtypes(t: Tables) -> DataFrame:
    return A.subtypes(dag(t))


TRACE = """trace AS (SELECT event_id AS seq, 't' || (user_id % 3) AS thread, CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'release' ELSE 'access' END AS action,
    CASE WHEN event_type IN ('view', 'click') THEN 'l' || (user_id % 2) ELSE 'o' || (event_id % 40) END AS target FROM events)"""


def trace(t: Tables) -> DataFrame:
    action = F.expr("case event_type when 'view' then 'acquire' when 'click' then 'release' else 'access' end")
    target = F.expr("if(event_type in ('view', 'click'), concat('l', user_id % 2), concat('o', event_id % 40))")
    return t.events.select(F.col("event_id").alias("seq"), F.expr("concat('t', user_id % 3)").alias("thread"), action.alias("action"), target.alias("target"))


HELD = f"""{TRACE}, last AS (SELECT a.thread, a.seq AS acc, l.target AS lock, arg_max(l.action, l.seq) AS action FROM trace a JOIN trace l ON a.thread = l.thread AND l.seq < a.seq
        WHERE a.action = 'access' AND l.action <> 'access' GROUP BY ALL),
    accesses AS (SELECT thread, seq, target, coalesce((SELECT string_agg(lock, ',' ORDER BY lock) FROM last WHERE last.thread = trace.thread AND acc = seq AND last.action = 'acquire'), '') AS held
        FROM trace WHERE action = 'access')"""


@query(f"WITH {HELD} SELECT thread, seq, target, held FROM accesses")
def d9_locksets(t: Tables) -> DataFrame:
    return A.held_locks(trace(t)).withColumn("held", F.array_join("held", ","))


@query(f"""WITH {HELD}, classes AS (SELECT target, thread, held, min(seq) AS seq FROM accesses GROUP BY ALL)
    SELECT a.target, a.seq AS a, b.seq AS b FROM classes a JOIN classes b ON a.target = b.target AND a.seq < b.seq AND a.thread <> b.thread
    WHERE a.held = '' OR b.held = '' OR NOT list_has_any(string_split(a.held, ','), string_split(b.held, ','))""")
def j9_races(t: Tables) -> DataFrame:
    return A.races(A.held_locks(trace(t)))


FACTS = "facts AS (SELECT DISTINCT o_custkey AS function, o_orderpriority AS effect FROM orders)"


@query(f"WITH {FACTS} SELECT function, string_agg(effect, ',' ORDER BY effect) AS effects FROM facts GROUP BY 1")
def d10_effects(t: Tables) -> DataFrame:
    facts = t.orders.select(F.col("o_custkey").alias("function"), F.col("o_orderpriority").alias("effect"))
    return A.effects(facts).withColumn("effects", F.array_join("effects", ","))


@query("SELECT c_custkey AS function FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def d10_pure(t: Tables) -> DataFrame:
    facts = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("function"))
    return A.pure(t.customer.select(F.col("c_custkey").alias("function")), facts)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'")
def d11_escapes(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()


@query("""SELECT l_partkey AS var, l_orderkey AS at FROM lineitem JOIN (SELECT l_partkey AS p, min(l_orderkey) FILTER (l_linenumber = 1) AS defined FROM lineitem GROUP BY 1) ON p = l_partkey
    WHERE l_linenumber <> 1 AND (defined IS NULL OR defined > l_orderkey)""")
def d12_used_before_defined(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("var"), F.col("l_orderkey").alias("at"), "l_linenumber")
    return A.used_before_defined(rows.where("l_linenumber != 1"), rows.where("l_linenumber = 1"))


@query(f"""WITH RECURSIVE {DAG}, {NATIONS}, closure AS (SELECT id AS src, id AS dst FROM nodes UNION SELECT c.src, e.dst FROM closure c JOIN dag e ON c.dst = e.src)
    SELECT src AS id, max(dst * 7 % 25)::BIGINT AS summary FROM closure GROUP BY 1""")
def d13_bottom_up(t: Tables) -> DataFrame:
    return A.bottom_up(nations(t), dag(t), F.expr("id * 7 % 25"), F.max)


@query("""WITH w AS (SELECT s_nationkey AS id, min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS id, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1)
    SELECT id, least(w.lo, c.lo) AS join_lo, greatest(w.hi, c.hi) AS join_hi, CASE WHEN c.lo < w.lo THEN -9223372036854775808 ELSE w.lo END AS widen_lo,
           CASE WHEN c.hi > w.hi THEN 9223372036854775807 ELSE w.hi END AS widen_hi FROM w JOIN c USING (id)""")
def d14_intervals(t: Tables) -> DataFrame:
    span = lambda df, key, v: df.groupBy(F.col(key).alias("id")).agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v))
    both = span(t.supplier, "s_nationkey", "s_suppkey").join(span(t.customer, "c_nationkey", "c_custkey"), "id")
    both = both.select("id", A.join_interval(F.col("s_suppkey"), F.col("c_custkey")).alias("j"), A.widen_interval(F.col("s_suppkey"), F.col("c_custkey")).alias("w"))
    return both.select("id", F.col("j.lo").alias("join_lo"), F.col("j.hi").alias("join_hi"), F.col("w.lo").alias("widen_lo"), F.col("w.hi").alias("widen_hi"))


@query(f"""WITH {MODEL_NODES}, {MODEL_EDGES} SELECT 'edges.' || kind AS metric, count(*) AS value FROM hints GROUP BY 1 UNION ALL SELECT 'nodes', count(*) FROM model
    UNION ALL SELECT 'unsafe', count(*) FILTER (unsafe) FROM model UNION ALL SELECT 'public', count(*) FILTER (visibility = 'pub') FROM model""")
def d15_report(t: Tables) -> DataFrame:
    return A.report(model_nodes(t), model_edges(t))


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {SCC}, c AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM flow JOIN comp a ON flow.src = a.id JOIN comp b ON flow.dst = b.id WHERE a.component <> b.component),
    outs AS (SELECT DISTINCT component AS block, 'd' || component AS def FROM comp UNION SELECT dst, def FROM outs JOIN c ON src = block) SELECT block, def FROM outs""")
def d16_facts_over_components(t: Tables) -> DataFrame:
    comps = G.scc(nations(t), flow(t))
    groups, edges = G.condense(flow(t), comps)
    gen = groups.select(F.col("component").alias("block"), F.concat(F.lit("d"), "component").alias("def"))
    return G.reaching_definitions(edges.select(F.col("dst").alias("block"), F.col("src").alias("pred")), gen, gen.limit(0))


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, e AS (SELECT src, dst FROM hints WHERE kind = 'Contains'), walk AS (
        SELECT id, 0 AS level FROM model WHERE kind = 'Crate' UNION ALL SELECT dst, level + 1 FROM walk JOIN e ON src = id)
    SELECT id, level::INT AS level FROM walk JOIN model USING (id) WHERE kind IN ('Crate', 'Module')""")
def v1_emit_order(t: Tables) -> DataFrame:
    containers = model_nodes(t).where("kind in ('Crate', 'Module')")
    return S.emit_order(containers, model_edges(t).where("kind = 'Contains'"))


@query("SELECT s.s_suppkey AS id, coalesce(g.given, s.s_name) AS name FROM supplier s LEFT JOIN (SELECT s_suppkey // 3 AS k, arg_max(s_name, s_suppkey) AS given FROM supplier GROUP BY 1) g ON g.k = s.s_suppkey")
def v2_renames(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return S.renamed(nodes, nodes.select(F.col("id").alias("src"), F.expr("id div 3").alias("dst")))


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {SCC} SELECT component, count(*) AS members FROM comp GROUP BY 1 HAVING count(*) > 1")
def v3_type_cycles(t: Tables) -> DataFrame:
    return G.scc(nations(t), flow(t)).groupBy("component").agg(F.count("*").alias("members")).where("members > 1")


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {CALLS}, f AS (SELECT id FROM model WHERE kind = 'Function'), roots AS (SELECT id FROM f WHERE id NOT IN (SELECT dst FROM calls)),
    r AS (SELECT id FROM roots UNION SELECT dst FROM r JOIN calls ON src = id)
    SELECT id, CASE WHEN id IN (FROM roots) THEN 'root' WHEN id IN (FROM r) THEN 'live' ELSE 'dead' END AS state FROM f""")
def v4_call_states(t: Tables) -> DataFrame:
    f, c = functions(t), calls(t)
    state = S.call_roots(f, c).withColumn("state", F.lit("root")).unionByName(S.dead_functions(f, c).withColumn("state", F.lit("dead")))
    return f.select("id").join(state, "id", "left").na.fill("live", ["state"])


@query(f"WITH RECURSIVE {DAG}, {NATIONS}, live AS (SELECT 0::BIGINT AS id UNION SELECT dst FROM live JOIN dag ON src = id) SELECT id FROM nodes WHERE id NOT IN (FROM live)")
def v5_dead_blocks(t: Tables) -> DataFrame:
    return A.dead_symbols(nations(t), dag(t), nations(t).where("id = 0"))


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {OWNERS} SELECT DISTINCT a.owner AS module, dst AS target FROM hints JOIN owners a ON a.id = src JOIN owners b ON b.id = dst
    WHERE kind = 'Resolves' AND a.owner IS NOT NULL AND a.owner IS DISTINCT FROM b.owner""")
def v6_needed_uses(t: Tables) -> DataFrame:
    return S.needed_uses(model_nodes(t), model_edges(t))


@query(f"WITH {MODEL_NODES}, {MODEL_EDGES} SELECT kind, count(*) AS broken FROM (SELECT DISTINCT * FROM hints WHERE src NOT IN (SELECT id FROM model) OR dst NOT IN (SELECT id FROM model)) GROUP BY 1")
def v7_invariants(t: Tables) -> DataFrame:
    return S.dangling(model_nodes(t), model_edges(t))


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {OWNERS} SELECT DISTINCT src, dst FROM hints JOIN model m ON m.id = dst AND visibility = 'private' JOIN owners a ON a.id = src JOIN owners b ON b.id = dst
    WHERE hints.kind = 'Resolves' AND a.owner IS DISTINCT FROM b.owner""")
def v8_private_uses(t: Tables) -> DataFrame:
    return S.private_uses(model_nodes(t), model_edges(t))


IMPLS = "impls AS (SELECT p_partkey AS id, p_partkey % 113 + 1 AS struct, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS trait FROM part)"


def impls(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 113 + 1").alias("struct"), F.expr("if(p_size % 4 = 0, null, p_brand)").alias("trait"))


@query(f"""WITH {IMPLS} SELECT 'unknown struct' AS defect, id::VARCHAR AS subject FROM impls WHERE struct NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'duplicate impl', struct || '/' || coalesce(trait, '') FROM impls GROUP BY struct, trait HAVING count(*) > 1""")
def v9_impl_defects(t: Tables) -> DataFrame:
    structs = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("Struct").alias("kind"))
    return S.impl_defects(structs, impls(t))


REQUIRED = "required AS (SELECT DISTINCT p_brand AS trait, p_size % 5 AS method FROM part), implemented AS (SELECT p_partkey AS impl, p_size % 5 AS method FROM part UNION SELECT p_partkey, p_partkey % 5 FROM part)"


@query(f"WITH {REQUIRED} SELECT p_partkey AS impl, method::INT AS method FROM part JOIN required ON trait = p_brand WHERE NOT EXISTS (FROM implemented i WHERE i.impl = p_partkey AND i.method = required.method)")
def v10_missing_methods(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("impl"), F.col("p_brand").alias("trait"), (F.col("p_size") % 5).alias("method"))
    done = p.select("impl", "method").union(p.select("impl", F.expr("cast(impl % 5 as int)")))
    return S.missing_methods(p.select("trait", "method").distinct(), p.select("impl", "trait"), done)


@query(f"""WITH RECURSIVE {FLOW}, {NATIONS}, {SCC}, typed AS (SELECT component, id, n_regionkey AS type FROM comp JOIN nation ON n_nationkey = id), f AS (SELECT component AS c, arg_min(type, id) AS first FROM typed GROUP BY 1)
    SELECT component, id FROM typed JOIN f ON c = component WHERE type <> first""")
def v11_type_conflicts(t: Tables) -> DataFrame:
    return S.type_conflicts(G.scc(nations(t), flow(t)), t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("type")))


@query(f"WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {OWNERS} SELECT owner AS module, name, count(*) AS n FROM model JOIN owners USING (id) WHERE owner IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def v12_shadowing(t: Tables) -> DataFrame:
    return S.shadowed(model_nodes(t), S.owners(model_nodes(t), model_edges(t)))


@query(f"WITH RECURSIVE {FLOW}, {NATIONS}, {SCC} SELECT string_agg(name, ' -> ' ORDER BY name) AS label FROM comp JOIN nodes USING (id) GROUP BY component HAVING count(*) > 1")
def v13_cycle_labels(t: Tables) -> DataFrame:
    named = G.scc(nations(t), flow(t)).join(nations(t), "id")
    return named.groupBy("component").agg(F.sort_array(F.collect_list("name")).alias("names")).where(F.size("names") > 1).select(F.array_join("names", " -> ").alias("label"))


@query(f"""WITH RECURSIVE {MODEL_NODES}, {MODEL_EDGES}, {CALLS}, r AS (SELECT id FROM model WHERE kind = 'Function' AND visibility = 'pub' UNION SELECT dst FROM r JOIN calls ON src = id)
    SELECT id, kind FROM model WHERE kind <> 'Function' OR visibility = 'pub' OR id IN (FROM r)""")
def v14_liveness(t: Tables) -> DataFrame:
    return S.live_order(model_nodes(t), calls(t)).select("id", "kind")


@query(f"""WITH {MODEL_NODES}, b AS (
        SELECT id, CASE kind WHEN 'Module' THEN 'crate::' || lower(name) WHEN 'Impl' THEN name || '__' || CASE WHEN id % 2 = 0 THEN 'T' || id % 7 ELSE '' END ELSE name END AS n,
            CASE kind WHEN 'Crate' THEN '0_crate' WHEN 'Module' THEN '1_module' WHEN 'Struct' THEN '3_struct' WHEN 'Impl' THEN '6_impl' ELSE '7_fn' END AS bucket FROM model
        UNION ALL SELECT -event_id, event_type, CASE event_id % 9 WHEN 0 THEN '2_use' WHEN 1 THEN '3_enum' WHEN 2 THEN '4_trait' WHEN 3 THEN '5_tyalias' WHEN 4 THEN '5b_const' WHEN 5 THEN '5c_static' WHEN 6 THEN '8_method' WHEN 7 THEN '9_tyref' ELSE '9b_macro' END FROM events)
    SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY n, id)::INT AS pos FROM b""")
def v15_stable_order(t: Tables) -> DataFrame:
    """Model nodes, impls with a trait for even ids, modules by their path; events stand for the kinds that the model lacks."""
    kinds = F.array(*map(F.lit, ("Use", "Enum", "Trait", "TypeAlias", "Const", "Static", "Method", "TypeRef", "MacroCall")))
    model = model_nodes(t).select("id", "kind", "name", F.expr("if(kind = 'Module', concat('crate::', lower(name)), null)").alias("path"), F.col("name").alias("struct"), F.expr("if(id % 2 = 0, concat('T', id % 7), null)").alias("trait"))
    more = t.events.select((-F.col("event_id")).alias("id"), F.get(kinds, (F.col("event_id") % 9).cast("int")).alias("kind"), F.col("event_type").alias("name"))
    return S.stable_order(model.unionByName(more, allowMissingColumns=True))


@query(f"""WITH RECURSIVE {DAG}, loops AS (SELECT src, dst FROM flow UNION ALL SELECT src, src FROM flow WHERE src = 3),
    c1 AS (SELECT src, dst FROM dag UNION SELECT c.src, e.dst FROM c1 c JOIN dag e ON c.dst = e.src), c2 AS (SELECT src, dst FROM flow UNION SELECT c.src, e.dst FROM c2 c JOIN flow e ON c.dst = e.src)
    SELECT 'Outlives' AS kind, count(*) = 0 AS acyclic FROM c1 WHERE src = dst UNION ALL SELECT 'ConstDep', count(*) = 0 FROM c2 WHERE src = dst UNION ALL SELECT 'Expands', false""")
def v16_v18_acyclic_kinds(t: Tables) -> DataFrame:
    """Regions (OP-V16), constants (OP-V17) and macros (OP-V18) must not depend on themselves."""
    self_loop = dag(t).select("src", "dst").unionByName(flow(t).where("src = 3").select("src", F.col("src").alias("dst")))
    graphs = {"Outlives": dag(t), "ConstDep": flow(t), "Expands": self_loop}
    parts = [G.is_acyclic(nations(t), e).select(F.lit(k).alias("kind"), "acyclic") for k, e in graphs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT DISTINCT v AS variant FROM (SELECT replace(p_brand, '#', '_') AS v FROM part UNION SELECT 'Size_' || p_size FROM part)
    WHERE v NOT IN (SELECT replace(p_brand, '#', '_') FROM part WHERE p_size < 3)""")
def v19_exhaustiveness(t: Tables) -> DataFrame:
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9_]", "_")
    variants = t.part.select(brand.alias("variant")).union(t.part.select(F.concat(F.lit("Size_"), "p_size"))).distinct()
    bodies = t.part.where("p_size < 3").select(F.concat(F.lit("match x { "), brand, F.lit(" => 1 }")).alias("text"))
    return S.unmentioned(variants, bodies)


@query(f"WITH {MODEL_NODES}, {MODEL_EDGES}, {CALLS} SELECT src, dst FROM calls JOIN model a ON a.id = src AND NOT a.unsafe JOIN model b ON b.id = dst AND b.unsafe")
def v21_unsafe_calls(t: Tables) -> DataFrame:
    return S.unsafe_calls(model_nodes(t), calls(t))


@query(f"WITH {MODEL_EDGES} SELECT CASE kind WHEN 'Resolves' THEN 'name' WHEN 'Calls' THEN 'call' ELSE 'module' END AS graph, kind, count(*) AS n FROM hints GROUP BY ALL")
def v22_derive(t: Tables) -> DataFrame:
    return S.route(model_edges(t)).groupBy("graph", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS function, l_linenumber AS src, ((l_linenumber + 1) % 5) AS dst FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT o_orderkey, l_linenumber, 7 FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber FROM lineitem)")
def v22_cfg_edges(t: Tables) -> DataFrame:
    blocks = t.lineitem.select(F.col("l_orderkey").alias("function"), F.col("l_linenumber").alias("block")).distinct()
    return S.cfg_edges(blocks.withColumn("targets", F.array((F.col("block") + 1) % 5, F.lit(7))))


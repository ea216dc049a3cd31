"""Validation rules over artifact tables (OP-R*): nations are modules, suppliers structs, customers functions, orders deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import rules as R
from graphloom.queries.registry import query
from graphloom.recipes import FLOW, MODEL_EDGES, MODEL_NODES, Tables, flow, model_edges, model_nodes


def artifacts(t: Tables) -> dict[str, DataFrame]:
    """Artifact tables whose defects follow from arithmetic on the keys."""
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    modules = t.nation.where("n_nationkey != 24").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    structs = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("module"), F.expr("array(struct('a' as name), struct(if(s_suppkey % 41 = 0, 'a', 'b') as name))").alias("fields"))
    traits = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(1).cast("long").alias("module"), F.expr("if(r_regionkey = 3, array(), array('f', 'g'))").alias("functions"))
    impls = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr("cast(if(s_suppkey % 31 = 0, 1, s_nationkey) as bigint)").alias("module"), F.expr("if(s_suppkey % 37 = 0, -s_suppkey, s_suppkey)").alias("struct_id"), F.expr("s_suppkey % 5").alias("trait_id"))
    functions = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("module"), F.expr("if(c_custkey % 203 = 0, null, c_custkey % 100 + 1)").alias("impl_id"), F.expr("if(c_custkey % 3 = 0, 'private', 'public')").alias("visibility"),
        F.expr("c_custkey % 101 != 0").alias("total"), F.lit(True).alias("deterministic"), F.lit(True).alias("explicit_inputs"), F.lit(True).alias("explicit_outputs"), F.expr("c_custkey % 103 != 0").alias("effects_are_deltas"),
        F.expr("if(c_custkey % 107 = 0, array(), array('x'))").alias("outputs"), F.expr("if(c_custkey % 109 = 0, array(c_custkey, c_custkey), array(c_custkey))").alias("deltas"), F.expr("case when c_custkey % 113 = 0 then '{\"kind\": \"goto\", \"x\": [{\"kind\":\"literal\"}]}' when c_custkey % 7 = 0 then null else '{\"kind\": \"struct_lit\", \"x\": {\"kind\": \"bin\"}}' end").alias("ast"),
    )
    calls = t.customer.where("c_custkey > 1").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("caller"), F.expr("if(c_custkey = 5, 10, c_custkey div 2)").alias("callee"))
    deltas = t.orders.select(F.col("o_orderkey").alias("id"), pick(["Observe", "Learn", "Decide", "Plan", "Act"], "o_orderkey").alias("stage"), pick(["State", "Io", "Structure", "History"], "o_custkey").alias("kind"), F.expr("if(o_orderkey % 997 = 0, -1, o_orderkey % 3)").alias("proof"), F.expr("o_orderkey % 499 != 0").alias("append_only"), F.expr("cast(null as bigint)").alias("related_function"))
    proofs = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("id"), pick(["Execution", "Structure", "Law"], "r_regionkey").alias("scope"))
    edges = flow(t).select(F.col("src").alias("from"), F.col("dst").alias("to"), F.expr("array(if(src = 7, ' ', 'x'))").alias("imported_types"), F.col("src").alias("id"))
    rewards = t.events.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), F.col("value").alias("reward"), F.expr("if(event_id % 3 = 0, null, value)").alias("snapshot"))
    epochs = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.expr("cast(case when n_nationkey = 0 then null when n_nationkey = 6 then 13 when n_nationkey = 8 then 8 when n_nationkey = 20 then 77 else n_nationkey div 2 end as bigint)").alias("parent"))
    return {"modules": modules, "structs": structs, "traits": traits, "impls": impls, "functions": functions, "call_edges": calls, "deltas": deltas, "proofs": proofs, "module_edges": edges, "rewards": rewards, "epochs": epochs}


def found(t: Tables, *rules: str) -> DataFrame:
    """(rule, subject, n) of the standard rules of these names."""
    tables = artifacts(t)
    return R.validate(tables, [r for r in R.STANDARD_RULES if r.rule in rules]).groupBy("rule", "subject").agg(F.count("*").alias("n"))


def _sql(*parts: str) -> str:
    return "SELECT rule, subject::VARCHAR AS subject, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query("SELECT l_orderkey || '/' || l_linenumber AS subject FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def r1_unique(t: Tables) -> DataFrame:
    return R.Unique("ExplicitArtifacts", "lineitem", ("l_orderkey", "l_linenumber")).check({"lineitem": t.lineitem}).select("subject")


@query(f"""WITH RECURSIVE {FLOW}, closure AS (SELECT src, dst FROM flow UNION SELECT c.src, e.dst FROM closure c JOIN flow e ON c.dst = e.src),
    bad AS (SELECT DISTINCT dst AS id FROM closure JOIN (SELECT src AS c FROM closure WHERE src = dst) ON src = c) """ + _sql(
    "SELECT 'ModuleDag' AS rule, src AS subject FROM flow WHERE src = 24", "SELECT 'ModuleDag', src FROM flow WHERE dst = 24", "SELECT 'ModuleDag', id FROM bad", "SELECT 'ModuleDag', src FROM flow WHERE src = 7"))
def r2_module_dag(t: Tables) -> DataFrame:
    return found(t, "ModuleDag", "ModuleSelfImport")


@query(_sql("SELECT 'CallGraphPublicApis' AS rule, c AS subject FROM (SELECT c_custkey AS c, CASE WHEN c_custkey = 5 THEN 10 ELSE c_custkey // 2 END AS callee FROM customer WHERE c_custkey > 1) WHERE callee % 3 = 0"))
def r3_public_callees(t: Tables) -> DataFrame:
    return found(t, "CallGraphPublicApis")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, CASE WHEN c_custkey = 5 THEN 10 ELSE c_custkey // 2 END AS dst FROM customer WHERE c_custkey > 1),
    closure AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM closure c JOIN e ON c.dst = e.src), bad AS (SELECT DISTINCT dst AS id FROM closure JOIN (SELECT src AS c FROM closure WHERE src = dst) ON src = c)
    SELECT 'CallGraphAcyclic' AS rule, id::VARCHAR AS subject, 1::BIGINT AS n FROM bad""")
def r3_call_cycles(t: Tables) -> DataFrame:
    return found(t, "CallGraphAcyclic")


@query(f"""WITH RECURSIVE {FLOW}, closure AS (SELECT src, dst FROM flow UNION SELECT c.src, e.dst FROM closure c JOIN flow e ON c.dst = e.src),
    calls AS (SELECT a.c_custkey AS id, a.c_nationkey AS src, b.c_nationkey AS dst FROM customer a JOIN customer b ON b.c_custkey = CASE WHEN a.c_custkey = 5 THEN 10 ELSE a.c_custkey // 2 END WHERE a.c_custkey > 1)
    SELECT 'CallGraphRespectsDag' AS rule, id::VARCHAR AS subject, 1::BIGINT AS n FROM calls c WHERE src <> dst AND NOT EXISTS (FROM closure k WHERE k.src = c.src AND k.dst = c.dst)""")
def r3_call_permissions(t: Tables) -> DataFrame:
    return found(t, "CallGraphRespectsDag")


@query("""SELECT 'TickGraphEdgesDeclared' AS rule, n_nationkey::VARCHAR AS subject, count(*) AS n FROM (SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT n_nationkey FROM nation WHERE (n_nationkey + 1) % 7 = 3 OR n_nationkey = 24) GROUP BY 2
    UNION ALL SELECT 'LoopContinuationJudgment', r_regionkey::VARCHAR, 1 FROM region WHERE r_regionkey > 2""")
def r4_r5_ticks_and_loops(t: Tables) -> DataFrame:
    """Edges from each nation's node to the next, some of which are not declared; loops with continuations that are no predicate."""
    node = lambda c: F.col(c).cast("long")
    declared = t.nation.where("n_nationkey % 7 != 3").select(node("n_nationkey").alias("id"), node("n_nationkey").alias("function"))
    edges = t.nation.select(node("n_nationkey").alias("id"), node("n_nationkey").alias("from"), (node("n_nationkey") + 1).alias("to"))
    loops = t.region.select(node("r_regionkey").alias("id"), node("r_regionkey").alias("graph"), node("r_regionkey").alias("continuation"))
    tables = {"tick_graph_nodes": declared, "tick_graph_edges": edges, "functions": declared, "loop_policies": loops, "tick_graphs": loops.select("id"), "predicates": t.spark.range(3)}
    rules = [r for r in R.STANDARD_RULES if r.rule in ("TickGraphEdgesDeclared", "TickGraphAcyclic", "LoopContinuationJudgment")]
    return R.validate(tables, rules).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query(_sql("SELECT 'ImplBinding' AS rule, s_suppkey AS subject FROM supplier WHERE (CASE WHEN s_suppkey % 31 = 0 THEN 1 ELSE s_nationkey END) = 24", "SELECT 'ImplBinding', s_suppkey FROM supplier WHERE s_suppkey % 37 = 0",
    "SELECT 'ImplBinding', s_suppkey FROM supplier WHERE s_suppkey % 37 <> 0 AND s_suppkey % 31 = 0 AND s_nationkey <> 1", "SELECT 'ImplBinding', c_custkey FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 + 1 WHERE c_custkey % 203 <> 0 AND c_nationkey <> CASE WHEN s_suppkey % 31 = 0 THEN 1 ELSE s_nationkey END"))
def r6_impl_binding(t: Tables) -> DataFrame:
    return found(t, "ImplBinding")


@query(_sql("SELECT 'ExecutionOnlyInImpl' AS rule, c_custkey AS subject FROM customer WHERE c_custkey % 203 = 0", "SELECT 'ExecutionOnlyInImpl', c_custkey FROM customer WHERE c_custkey % 203 <> 0 AND c_custkey % 100 + 1 NOT IN (SELECT s_suppkey FROM supplier)", "SELECT 'ExecutionOnlyInImpl', c_custkey FROM customer WHERE c_nationkey = 24",
    "SELECT 'FunctionContracts', c_custkey FROM customer WHERE c_custkey % 101 = 0", "SELECT 'FunctionContracts', c_custkey FROM customer WHERE c_custkey % 107 = 0"))
def r7_functions(t: Tables) -> DataFrame:
    return found(t, "ExecutionOnlyInImpl", "FunctionContracts")


@query(_sql("SELECT 'EffectsAreDeltas' AS rule, c_custkey AS subject FROM customer WHERE c_custkey % 103 = 0", "SELECT 'EffectsAreDeltas', c_custkey FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 109 = 0) WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders)", "SELECT 'EffectsAreDeltas', c_custkey FROM customer WHERE c_custkey % 109 = 0"))
def r7_effects(t: Tables) -> DataFrame:
    return found(t, "EffectsAreDeltas")


@query(_sql("SELECT 'StructShape' AS rule, s_suppkey AS subject FROM supplier WHERE s_nationkey = 24", "SELECT 'StructShape', s_suppkey FROM supplier WHERE s_suppkey % 41 = 0", "SELECT 'TraitVerbs', 3"))
def r8_shapes(t: Tables) -> DataFrame:
    return found(t, "StructShape", "TraitVerbs")


@query(_sql("SELECT 'FunctionAst' AS rule, c_custkey AS subject FROM customer, range(2) WHERE c_custkey % 113 = 0"))
def r9_function_ast(t: Tables) -> DataFrame:
    return found(t, "FunctionAst")


D = "d AS (SELECT o_orderkey AS id, ['Observe', 'Learn', 'Decide', 'Plan', 'Act'][o_orderkey % 5 + 1] AS stage, ['State', 'Io', 'Structure', 'History'][o_custkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 997 = 0 THEN -1 ELSE o_orderkey % 3 END AS proof FROM orders)"


@query(f"WITH {D} " + _sql("SELECT 'DeltaAppendOnly' AS rule, id AS subject FROM d WHERE id % 499 = 0", "SELECT 'DeltaProofs', id FROM d WHERE proof = -1",
    "SELECT 'DeltaPipeline', id FROM d WHERE NOT (stage = 'Observe' OR kind = 'History' OR (stage IN ('Learn', 'Act') AND kind = 'State') OR (stage IN ('Learn', 'Decide', 'Plan') AND kind = 'Structure') OR (stage = 'Act' AND kind = 'Io'))",
    "SELECT 'ProofScope', id FROM d WHERE proof >= 0 AND NOT ((kind IN ('State', 'Io') AND proof = 0) OR (kind = 'Structure' AND proof IN (1, 2)) OR (kind = 'History' AND proof IN (0, 1)))"))
def r11_deltas(t: Tables) -> DataFrame:
    return found(t, "DeltaAppendOnly", "DeltaPipeline", "DeltaProofs", "ProofScope")


@query("SELECT 'AdmissionBridge' AS rule, o_orderkey::VARCHAR AS subject FROM (SELECT o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b FROM orders) WHERE o_orderdate <= b")
def r12_applied_order(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate")
    return R.Increasing("AdmissionBridge", "applied", "id", "o_orderdate", by="o_custkey", strict=True).check({"applied": rows}).select("rule", "subject")


@query(_sql("SELECT 'TickEpochs' AS rule, 20 AS subject", "SELECT 'TickEpochs', 8", "SELECT 'TickEpochs', unnest([6, 13])"))
def r13_epochs(t: Tables) -> DataFrame:
    """A parent that is missing, one that is its own child, and the cycle of 6 and 13."""
    return found(t, "TickEpochs")


@query("SELECT 'TickRoot' AS rule, l_orderkey::VARCHAR AS subject, count(*) AS n FROM lineitem WHERE l_suppkey % 89 = 0 GROUP BY 2")
def r14_ticks(t: Tables) -> DataFrame:
    ticks = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("output_deltas"))
    known = t.supplier.where("s_suppkey % 89 != 0").select(F.col("s_suppkey").alias("id"))
    return R.Refers("TickRoot", "ticks", "output_deltas", "deltas", many=True).check({"ticks": ticks, "deltas": known}).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query("SELECT 'PlanArtifacts' AS rule, o_orderkey::VARCHAR AS subject FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def r15_plans(t: Tables) -> DataFrame:
    plans = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey").join(t.customer.select("c_custkey", F.expr("if(c_acctbal < 0, 'Reject', 'Accept')").alias("decision")), F.col("o_custkey") == F.col("c_custkey"))
    return R.Holds("PlanArtifacts", "p", "decision = 'Accept'", "judgment does not accept").check({"p": plans}).select("rule", "subject")


@query("SELECT 'ExecutionBoundary' AS rule, l_orderkey::VARCHAR AS subject, count(*) AS n FROM lineitem WHERE l_partkey % 211 = 0 GROUP BY 2")
def r16_executions(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_partkey")
    known = t.part.where("p_partkey % 211 != 0").select(F.col("p_partkey").alias("id"))
    return R.Refers("ExecutionBoundary", "e", "l_partkey", "parts").check({"e": rows, "parts": known}).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id AS id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS s FROM events),
    w AS (SELECT id, value, s, last_value(value IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, last_value(s IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb FROM r)
    SELECT 'RewardCollapseDetected' AS rule, id::VARCHAR AS subject, 1::BIGINT AS n FROM w WHERE value < b UNION ALL SELECT 'RewardMonotonicity', id::VARCHAR, 1 FROM w WHERE s < sb - 0.05""")
def r17_rewards(t: Tables) -> DataFrame:
    return found(t, "RewardCollapseDetected", "RewardMonotonicity")


@query("""SELECT 'GpuLawfulMath' AS rule, p_partkey::VARCHAR AS subject, (CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size = 13 THEN 1 ELSE 0 END)::BIGINT AS n FROM part WHERE p_size % 10 = 0 OR p_size % 7 = 0 OR p_size = 13""")
def r18_gpu(t: Tables) -> DataFrame:
    gpu = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("function"), F.expr("array(p_size % 10)").alias("inputs"), F.expr("if(p_size % 7 = 0, array(), array(1))").alias("outputs"), F.expr("p_size != 13").alias("pure"), *[F.lit(True).alias(c) for c in ("no_io", "no_alloc", "no_branch")])
    rules = [r for r in R.STANDARD_RULES if r.rule == "GpuLawfulMath"]
    return R.validate({"gpu_functions": gpu, "functions": gpu.select("id")}, rules).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query(_sql("SELECT 'ProposalDeclarative' AS rule, c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT 'JudgmentDecisions', o_orderkey FROM orders WHERE o_custkey % 10 = 0", "SELECT 'LearningDeclarations', o_orderkey FROM orders WHERE o_orderkey % 100 = 0"))
def r19_r20_decisions(t: Tables) -> DataFrame:
    used = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.slice(F.collect_list("o_orderkey"), 1, 1).alias("nodes"))
    proposals = t.customer.select(F.col("c_custkey").alias("id")).join(used, "id", "left").select("id", F.coalesce("nodes", F.expr("cast(array() as array<bigint>)")).alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("edges"))
    judgments = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("proposal"), F.expr("o_custkey % 10").alias("predicate"))
    learning = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("proposal"), F.expr("if(o_orderkey % 100 = 0, array(), array(1))").alias("new_rules"))
    predicates = t.spark.range(1, 10)
    tables = {"proposals": proposals, "judgments": judgments, "learning": learning, "predicates": predicates}
    rules = [r for r in R.STANDARD_RULES if r.rule in ("ProposalDeclarative", "JudgmentDecisions", "LearningDeclarations")]
    return R.validate(tables, rules).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query(_sql("SELECT 'GoalMutationRequiresJudgment' AS rule, s_suppkey AS subject FROM supplier WHERE s_suppkey % 9 = 0 OR s_nationkey = 24", "SELECT 'GoalMutationInvariantMissing', s_suppkey FROM supplier WHERE s_suppkey % 11 = 0"))
def r21_goals(t: Tables) -> DataFrame:
    goals = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr("if(s_suppkey % 9 = 0, null, cast(s_nationkey as bigint))").alias("judgment"), F.expr("if(s_suppkey % 11 = 0, null, 'i')").alias("invariant"))
    tables = {"goal_mutations": goals, "judgments": t.nation.where("n_nationkey != 24").select(F.col("n_nationkey").cast("long").alias("id"))}
    return R.validate(tables, [r for r in R.STANDARD_RULES if r.rule.startswith("GoalMutation")]).groupBy("rule", "subject").agg(F.count("*").alias("n"))


@query("SELECT 'ExternalDependencies' AS rule, p_type AS subject FROM part WHERE p_size < 10 GROUP BY p_type HAVING count(*) > 1 UNION ALL SELECT 'ProjectEnvelope', r_regionkey::VARCHAR FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'VersionEvolution', r_regionkey::VARCHAR FROM region WHERE r_regionkey > 3 UNION ALL SELECT 'VersionEvolution', 'migration_proofs'")
def r22_project(t: Tables) -> DataFrame:
    project = t.region.select(F.col("r_regionkey").alias("id"), F.expr("if(r_regionkey = 2, ' ', r_name)").alias("name"), F.lit("1").alias("version"), F.expr("if(r_regionkey > 3, array('1', '1'), array('1'))").alias("compatible"))
    tables = {"project": project, "dependencies": t.part.where("p_size < 10").select(F.col("p_type").alias("name")), "migration_proofs": t.region.select(F.lit("Structure").alias("scope"))}
    return R.validate(tables, [r for r in R.STANDARD_RULES if r.rule in ("ProjectEnvelope", "ExternalDependencies", "VersionEvolution")]).select("rule", "subject")


@query("""SELECT 'LayoutDuplicate' AS rule, s_suppkey::VARCHAR AS subject FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'LayoutUnknownFile', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 24
    UNION ALL SELECT 'LayoutModule', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 20 = 0 AND s_nationkey <> 0 UNION ALL SELECT 'LayoutMissing', '-1'""")
def r23_layout(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("module")).unionByName(t.spark.range(1).select(F.lit(-1).cast("long").alias("node"), F.lit(1).alias("module")))
    routes = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("file")).unionByName(t.supplier.where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("node"), F.lit(0).alias("file")))
    files = t.nation.where("n_nationkey != 24").select(F.col("n_nationkey").alias("file"), F.col("n_nationkey").alias("module"))
    return R.layout_violations(routes, files, nodes).select("rule", "subject")


@query(f"""WITH {MODEL_NODES}, {MODEL_EDGES} SELECT 'Endpoint' AS rule, count(*) AS n FROM (SELECT src AS id FROM hints UNION ALL SELECT dst FROM hints) WHERE id NOT IN (SELECT id FROM model) HAVING count(*) > 0
    UNION ALL SELECT 'UniqueEdge', count(*) FROM (SELECT src FROM hints GROUP BY src, dst, kind HAVING count(*) > 1) HAVING count(*) > 0""")
def r24_r25_snapshot(t: Tables) -> DataFrame:
    return R.snapshot_violations(model_nodes(t), model_edges(t)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {FLOW}, {D}, closure AS (SELECT src, dst FROM flow UNION SELECT c.src, e.dst FROM closure c JOIN flow e ON c.dst = e.src), bad AS (SELECT DISTINCT dst AS id FROM closure JOIN (SELECT src AS c FROM closure WHERE src = dst) ON src = c),
    v AS (SELECT 'DeltaAppendOnly' AS rule, id AS subject FROM d WHERE id % 499 = 0 UNION ALL SELECT 'DeltaProofs', id FROM d WHERE proof = -1 UNION ALL SELECT 'ModuleDag', src FROM flow WHERE src = 24 OR dst = 24 UNION ALL SELECT 'ModuleDag', src FROM flow WHERE src = 24 AND dst = 24
        UNION ALL SELECT 'ModuleDag', id FROM bad UNION ALL SELECT 'ModuleDag', src FROM flow WHERE src = 7),
    loops AS (SELECT a.src AS id, min(a.dst) AS component FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
    least AS (SELECT string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS cycle FROM loops WHERE component = (SELECT min(component) FROM (SELECT component FROM loops GROUP BY 1 HAVING count(*) > 1)))
    SELECT rule, count(*) AS n, min(subject::VARCHAR) AS example, CASE WHEN rule <> 'ModuleDag' THEN 'WrongValue' WHEN (SELECT cycle FROM least) IS NULL THEN 'MissingContext' ELSE 'CycleDetected' END AS class,
        CASE WHEN rule = 'ModuleDag' THEN (SELECT cycle FROM least) END AS cycle FROM v GROUP BY rule""")
def r26_diagnosis(t: Tables) -> DataFrame:
    tables = artifacts(t)
    rows = R.validate(tables, [r for r in R.STANDARD_RULES if r.rule in ("DeltaAppendOnly", "DeltaProofs", "ModuleDag")])
    return R.diagnose(rows, tables).withColumn("cycle", F.array_join("cycle", ","))


@query("SELECT p_brand AS subject FROM part GROUP BY 1 HAVING count(*) > 1")
def r27_duplicate_ids(t: Tables) -> DataFrame:
    return R.Unique("ExplicitArtifacts", "part", ("p_brand",)).check({"part": t.part}).select("subject")

"""Versioning, resolution, sources and sinks (OP-M*, OP-Y*, OP-S*, OP-K*) and labelled extras (X_*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import layout as L
from graphloom.operators import relational as R
from graphloom.operators import resolution as Y
from graphloom.operators import versions as V
from graphloom.operators.relational import differences, jaccard
from graphloom.operators.solvers import GRAPH_OF
from graphloom.queries.registry import query
from graphloom.recipes import DAG, LOG, MODEL_EDGES, MODEL_NODES, NATION, Tables, dag, log, model_edges, model_nodes
from graphloom.sources import dot, files
from graphloom.store import materialize, own_dir

STATE = "state AS (SELECT key, payload, seq FROM (SELECT key, arg_max(payload, seq) AS payload, max(seq) AS seq, arg_max(op, seq) AS op FROM log GROUP BY key) WHERE op <> 'RemoveNode')"


@query(f"WITH {LOG}, {STATE} SELECT key, payload, seq FROM state")
def m1_replay(t: Tables) -> DataFrame:
    return V.replay(log(t))


@query("""WITH e AS (SELECT user_id AS src, event_id % 7 AS dst, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY 1, 2), gone AS (SELECT user_id AS k, max(event_id) AS g FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT src, dst FROM e LEFT JOIN gone a ON a.k = src LEFT JOIN gone b ON b.k = dst WHERE op <> 'click' AND coalesce(a.g < seq, true) AND coalesce(b.g < seq, true)""")
def m1_replay_edges(t: Tables) -> DataFrame:
    edges = t.events.select(F.col("event_id").alias("seq"), F.expr("if(event_type = 'click', 'RemoveEdge', 'AddEdge')").alias("op"), F.col("user_id").alias("src"), (F.col("event_id") % 7).alias("dst"), F.lit("Calls").alias("kind"))
    return V.replay_edges(edges, log(t)).select("src", "dst")


TWO = """a AS (SELECT key, payload FROM (SELECT key, arg_max(payload, seq) AS payload, arg_max(op, seq) AS op FROM log WHERE seq < 4000 GROUP BY 1) WHERE op <> 'RemoveNode'),
    b AS (SELECT key, payload FROM (SELECT key, arg_max(payload, seq) AS payload, arg_max(op, seq) AS op FROM log WHERE seq < 8000 GROUP BY 1) WHERE op <> 'RemoveNode')"""


@query(f"WITH {LOG}, {TWO} SELECT CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(a.key, b.key) AS key, a.payload AS old, b.payload AS new FROM a FULL JOIN b ON a.key = b.key WHERE a.payload IS DISTINCT FROM b.payload")
def m2_changes(t: Tables) -> DataFrame:
    return V.changes(V.replay(log(t), 4000), V.replay(log(t), 8000))


@query(f"WITH {LOG}, {TWO} SELECT * FROM b")
def m2_apply_changes(t: Tables) -> DataFrame:
    a = V.replay(log(t), 4000)
    return V.apply_changes(a, V.changes(a, V.replay(log(t), 8000)))


@query(f"""WITH {MODEL_NODES}, {MODEL_EDGES}, more AS (FROM hints UNION ALL SELECT 1, n_nationkey + {NATION}, 'Contains' FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT {NATION}, 0, 'Contains' UNION ALL SELECT src, dst, kind FROM hints WHERE kind = 'ImplFor' AND src % 700 = 0),
        ids AS (SELECT id FROM model UNION ALL SELECT id FROM model WHERE id % 301 = 0), inside AS (SELECT DISTINCT src, dst FROM more WHERE kind = 'Contains'),
        round AS (SELECT id FROM (SELECT src AS id FROM inside UNION SELECT dst FROM inside) WHERE id = 0 OR id = {NATION} OR id IN (SELECT dst FROM inside WHERE src IN (0, {NATION})) OR id IN (SELECT b.dst FROM inside a JOIN inside b ON a.dst = b.src WHERE a.src IN (0, {NATION})))
    SELECT 'UniqueNode' AS rule, id::VARCHAR AS subject FROM ids GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'UniqueEdge', src || '->' || dst FROM more GROUP BY src, dst, kind HAVING count(*) > 1
    UNION ALL SELECT 'Endpoint', src || '->' || dst FROM (SELECT src, dst, unnest([src, dst]) AS e FROM more) WHERE e NOT IN (SELECT id FROM model) UNION ALL SELECT 'OneContainer', dst::VARCHAR FROM inside GROUP BY dst HAVING count(*) > 1 UNION ALL SELECT 'AcyclicContains', id::VARCHAR FROM round""")
def m3_verify(t: Tables) -> DataFrame:
    """A model with ids and edges twice, nations in two regions, and a region in one of its nations."""
    edges = model_edges(t)
    second = t.nation.where("n_nationkey % 6 = 0").select(F.lit(1).cast("long").alias("src"), (F.col("n_nationkey").cast("long") + NATION).alias("dst"), F.lit("Contains").alias("kind"))
    back = t.spark.range(1).select(F.lit(NATION).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("Contains").alias("kind"))
    more = edges.unionByName(second).unionByName(back).unionByName(edges.where("kind = 'ImplFor' and src % 700 = 0"))
    nodes = model_nodes(t).select("id", "kind", "name")
    return V.verify(nodes.unionByName(nodes.where("id % 301 = 0")), more)


_VERTICES = " UNION ALL ".join(f"SELECT '{g}_graph' AS part, (SELECT count(DISTINCT e) FROM (SELECT unnest([src, dst]) AS e FROM {{0}} WHERE kind IN ({', '.join(repr(k) for k, x in sorted(GRAPH_OF.items()) if x == g)}))) AS n" for g in sorted(set(GRAPH_OF.values())))


@query(f"""WITH {MODEL_NODES}, {MODEL_EDGES}, later AS (SELECT src, dst, CASE WHEN kind = 'Calls' AND src % 4 = 0 THEN 'CfgEdge' ELSE kind END AS kind FROM hints WHERE kind <> 'ImplFor' OR src % 2 = 0),
    a AS (SELECT 'nodes' AS part, (SELECT count(*) FROM model) AS n UNION ALL SELECT 'edge_hints', (SELECT count(*) FROM hints) UNION ALL {_VERTICES.format('hints')}),
    b AS (SELECT 'nodes' AS part, (SELECT count(*) FROM model) AS n UNION ALL SELECT 'edge_hints', (SELECT count(*) FROM later) UNION ALL {_VERTICES.format('later')})
    SELECT part, a.n AS before, b.n AS after, a.n <> b.n AS changed FROM a JOIN b USING (part)""")
def m4_coarse_diff(t: Tables) -> DataFrame:
    """The model, and one with half of its impls and a quarter of its calls made control flow."""
    nodes, edges = model_nodes(t).select("id", "kind", "name"), model_edges(t)
    later = edges.where("kind != 'ImplFor' or src % 2 = 0").withColumn("kind", F.expr("if(kind = 'Calls' and src % 4 = 0, 'CfgEdge', kind)"))
    return V.coarse_diff((nodes, edges), (nodes, later))


@query(f"WITH {LOG}, {TWO} SELECT key, payload FROM a")
def m5_time_travel(t: Tables) -> DataFrame:
    return V.replay(log(t), 4000).select("key", "payload")


@query(f"WITH {LOG} SELECT key, arg_min(payload, seq) AS payload FROM log WHERE op <> 'RemoveNode' GROUP BY 1")
def m5_first_wins(t: Tables) -> DataFrame:
    return V.replay(log(t), mode="first").select("key", "payload")


@query(f"WITH {LOG}, {STATE} SELECT key, payload, 1::BIGINT AS version FROM state")
def m6_m8_version_store(t: Tables) -> DataFrame:
    """Two appended versions, the second against the first, and the snapshot that they give."""
    import uuid

    store = V.VersionStore(t.spark, f"{own_dir(t.spark)}/store-{uuid.uuid4().hex}")
    first = store.append(log(t).where("seq < 5000").select("seq", "op", "key", "payload"), expected=-1)
    last = store.append(log(t).where("seq >= 5000").select("seq", "op", "key", "payload"), expected=first)
    return store.checkpoint("now", store.snapshot()).select("key", "payload", F.lit(last).cast("long").alias("version"))


@query("""WITH r AS (SELECT event_id AS seq, user_id % 50 AS judgment, event_id % 9 AS epoch, event_id % 40 AS nonce FROM events)
    SELECT seq, CASE WHEN judgment % 5 = 0 THEN 'rejected' WHEN epoch < 3 THEN 'stale' WHEN seq > min(seq) OVER (PARTITION BY judgment, nonce) THEN 'replayed' ELSE 'admitted' END AS decision FROM r""")
def m7_admission(t: Tables) -> DataFrame:
    requests = t.events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("judgment"), (F.col("event_id") % 9).alias("epoch"), (F.col("event_id") % 40).alias("nonce"))
    judgments = t.spark.range(50).select(F.col("id").alias("judgment"), (F.col("id") % 5 != 0).alias("approved"))
    return V.admitted(requests, judgments, 3).select("seq", "decision")


@query(f"WITH {LOG}, {STATE} SELECT key, payload, seq FROM state")
def m9_compaction(t: Tables) -> DataFrame:
    return V.replay(V.compact(log(t), 6000))


@query("""WITH w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_name || ' x', ' ')) AS b FROM part) SELECT id, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) <= 0.3 AS within FROM w""")
def m11_drift_bound(t: Tables) -> DataFrame:
    a, b = F.split("p_name", " "), F.split(F.concat("p_name", F.lit(" x")), " ")
    return t.part.select(F.col("p_partkey").alias("id"), (F.round(1 - jaccard(a, b), 9) <= 0.3).alias("within"))


STRUCTURAL = """d AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'AddField' WHEN 'click' THEN 'UpdateStructVisibility' WHEN 'error' THEN 'RemoveField' WHEN 'purchase' THEN 'AddStruct' ELSE 'Nothing' END AS payload,
        CASE WHEN event_type IN ('view', 'error') THEN 's' || user_id % 120 || '.f' || event_id % 3 WHEN event_type = 'purchase' THEN 's' || user_id ELSE 's' || user_id % 120 END AS id, CASE WHEN event_type = 'view' THEN 's' || user_id % 120 END AS parent, event_id::VARCHAR AS value FROM events),
    base AS (SELECT -1 AS seq, 'AddStruct' AS payload, 's' || s_suppkey AS id, NULL AS parent, NULL AS value FROM supplier),
    r AS (SELECT *, CASE WHEN payload LIKE '%Field' THEN 'fields' ELSE 'structs' END AS collection FROM (FROM base UNION ALL FROM d) WHERE payload <> 'Nothing'),
    born AS (SELECT id AS p, min(seq) AS b FROM r WHERE payload IN ('AddField', 'AddStruct') GROUP BY 1),
    o AS (SELECT r.*, payload LIKE 'Add%' AND seq >= 0 AND parent IS NOT NULL AND coalesce(b >= seq, true) AS orphan FROM r LEFT JOIN born ON p = parent),
    l AS (SELECT *, last_value(CASE WHEN NOT orphan AND payload LIKE 'Add%' THEN 1 WHEN payload LIKE 'Remove%' THEN 0 END IGNORE NULLS) OVER (PARTITION BY collection, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live FROM o),
    x AS (SELECT *, CASE WHEN orphan THEN 'unknown parent' WHEN payload LIKE 'Add%' AND live = 1 THEN 'duplicate' WHEN payload NOT LIKE 'Add%' AND coalesce(live, 0) = 0 THEN 'unknown target' END AS defect FROM l)"""


def _structural(t: Tables) -> tuple[DataFrame, DataFrame]:
    items = t.supplier.select(F.lit("structs").alias("collection"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.expr("cast(map() as map<string,string>)").alias("props"))
    payload = F.expr("case event_type when 'view' then 'AddField' when 'click' then 'UpdateStructVisibility' when 'error' then 'RemoveField' when 'purchase' then 'AddStruct' else 'Nothing' end")
    key = F.expr("case when event_type in ('view', 'error') then concat('s', user_id % 120, '.f', event_id % 3) when event_type = 'purchase' then concat('s', user_id) else concat('s', user_id % 120) end")
    parent = F.expr("if(event_type = 'view', concat('s', user_id % 120), null)")
    return items, t.events.select(F.col("event_id").alias("seq"), payload.alias("payload"), key.alias("id"), parent.alias("parent"), F.col("event_id").cast("string").alias("value"))


@query(f"""WITH {STRUCTURAL}, g AS (FROM x WHERE defect IS NULL), e AS (SELECT collection, id, arg_max(payload, seq) AS last, arg_max(parent, seq) AS parent FROM g WHERE payload <> 'UpdateStructVisibility' GROUP BY ALL)
    SELECT collection, e.id, parent, (SELECT arg_max(value, seq) FROM g WHERE g.id = e.id AND payload = 'UpdateStructVisibility') AS visibility FROM e WHERE last LIKE 'Add%'""")
def m12_structural_state(t: Tables) -> DataFrame:
    from graphloom.operators.structural import apply_payloads

    state, _ = apply_payloads(*_structural(t))
    return state.select("collection", "id", "parent", F.col("props")["visibility"].alias("visibility"))


@query(f"WITH {STRUCTURAL} SELECT seq, defect FROM x WHERE defect IS NOT NULL UNION ALL SELECT seq, 'unknown payload' FROM d WHERE payload = 'Nothing'")
def m12_structural_errors(t: Tables) -> DataFrame:
    from graphloom.operators.structural import apply_payloads

    return apply_payloads(*_structural(t))[1]


@query("""SELECT 'a' || n_nationkey AS admission, 'd' || n_nationkey AS delta, row_number() OVER (ORDER BY 'a' || n_nationkey) - 1 AS seq FROM nation WHERE n_regionkey <> 2""")
def m10_admitted_changes(t: Tables) -> DataFrame:
    """Each nation's admission adds a module; those of one region were not accepted."""
    from graphloom.operators.structural import apply_admitted

    items, _ = _structural(t)
    n = t.nation.select(F.concat(F.lit("a"), "n_nationkey").alias("id"), F.col("n_regionkey").alias("judgment"), F.array(F.concat(F.lit("d"), "n_nationkey")).alias("delta_ids"))
    judgments = t.region.select(F.col("r_regionkey").alias("id"), F.expr("if(r_regionkey = 2, 'Reject', 'Accept')").alias("decision"))
    deltas = t.nation.select(F.concat(F.lit("d"), "n_nationkey").alias("delta"), F.lit(0).alias("seq"), F.lit("AddModule").alias("payload"), F.concat(F.lit("m"), "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("value"))
    return apply_admitted(items, n, judgments, deltas)[1]


@query("""SELECT l_orderkey * 10 + l_linenumber AS seq, defect FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'unproven' AS defect FROM lineitem WHERE l_linenumber = 3
    UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'unknown delta' FROM lineitem WHERE l_linenumber = 5)""")
def m13_application_checks(t: Tables) -> DataFrame:
    applied = t.lineitem.select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("run"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), F.col("l_linenumber").alias("order"), F.col("l_linenumber").alias("delta"))
    deltas = t.spark.range(10).where("id != 5").select(F.col("id").cast("int").alias("id"), F.expr("if(id = 3, 99, 1)").alias("proof"))
    return V.verify_application(applied, deltas, t.spark.range(2).select(F.col("id").cast("int").alias("id")))


_ROLLOUT = """WITH RECURSIVE w AS (SELECT 0 AS depth, c_custkey AS id, c_custkey AS x FROM customer UNION ALL SELECT depth + 1, id, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END FROM w WHERE depth < 6),
    r AS (SELECT depth, (count(*) FILTER (x % 2 = 0) - count(*) FILTER (x % 2 = 1))::DOUBLE AS step FROM w WHERE depth > 0 GROUP BY 1), u AS (SELECT depth::INT AS depth, sum(step) OVER (ORDER BY depth) AS reward FROM r)
    SELECT depth, reward, round(reward + (1000 - reward) * 0.1, 6) AS utility FROM u"""


def _rollout(t: Tables) -> DataFrame:
    """Numbers that are halved or tripled; a step is worth the even ones over the odd ones."""
    step = lambda df: df.withColumn("x", F.expr("if(x % 2 = 0, x div 2, 3 * x + 1)"))
    reward = F.count_if(F.col("x") % 2 == 0) - F.count_if(F.col("x") % 2 == 1)
    return V.rollout(t.customer.select(F.col("c_custkey").alias("x")), step, reward, 6, 1000.0).withColumn("utility", F.round("utility", 6))


@query(_ROLLOUT)
def m18_rollout(t: Tables) -> DataFrame:
    return _rollout(t)


@query(_ROLLOUT + " ORDER BY utility DESC, depth LIMIT 1")
def m18_best_depth(t: Tables) -> DataFrame:
    return V.best_depth(_rollout(t))


@query("SELECT o_custkey AS id, abs(count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F')) AS error FROM orders GROUP BY 1")
def m19_prediction_error(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.abs(n("O") - n("F")).cast("long").alias("error"))


@query("SELECT s_suppkey AS dst, CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE s_nationkey END::BIGINT AS src FROM supplier")
def m20_moves(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("key"))
    contains = t.supplier.select(F.col("s_nationkey").cast("long").alias("src"), F.col("s_suppkey").alias("dst"))
    moves = t.supplier.where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("moved."), "s_name").alias("new_key"), F.lit(1).cast("long").alias("new_parent"))
    return V.moved(nodes, contains, moves)[1].select("dst", "src")


@query("SELECT user_id || '/' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS delta, event_type AS payload FROM events")
def m21_event_deltas(t: Tables) -> DataFrame:
    runs = t.events.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("events"))
    return V.event_deltas(runs).select("delta", "payload")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision FROM supplier")
def m22_m23_patch_gate(t: Tables) -> DataFrame:
    text = F.concat(F.lit("*** Begin Patch\n"), F.when(F.col("s_suppkey") % 2 == 0, "*** End Patch").otherwise("x"))
    return T.gate_patches(t.supplier.select(F.col("s_suppkey").alias("id"), text.alias("text")), "text").select("id", "decision")


@query("SELECT doc_id::VARCHAR AS path, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\\bthe\\b') GROUP BY 1")
def m26_rename_preview(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("path"), "text")
    return Y.rename_preview(docs, {"the": "der"}).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT 'm' || c_nationkey AS path, sha256(string_agg('fn f' || c_custkey || '() {}', chr(10) ORDER BY c_custkey)) AS hash FROM customer GROUP BY 1")
def m27_k5_file_tree(t: Tables) -> DataFrame:
    parts = t.customer.select(F.concat(F.lit("m"), "c_nationkey").alias("path"), F.col("c_custkey").alias("pos"), F.concat(F.lit("fn f"), "c_custkey", F.lit("() {}")).alias("text"))
    return files.file_tree(parts).select("path", "hash")


def _sources(t: Tables) -> DataFrame:
    text = F.concat(F.lit("use crate::m"), F.col("s_nationkey"), F.lit("::x;\nuse super::y;\npub(crate) mod b;\n\npub fn run"), F.col("s_suppkey"), F.lit("() {\n    struct S;\n}\nenum E { A }\n"))
    return t.supplier.select(F.concat(F.lit("src/s"), F.col("s_suppkey"), F.lit(".rs")).alias("path"), text.alias("text"))


@query("""SELECT 'src/s' || s_suppkey || '.rs' AS path, line, kind, CASE kind WHEN 'fn' THEN 'run' || s_suppkey ELSE name END AS name, public FROM supplier, (VALUES (3, 'mod', 'b', true), (5, 'fn', '', true), (6, 'struct', 'S', false), (8, 'enum', 'E', false)) v(line, kind, name, public)""")
def m28_source_symbols(t: Tables) -> DataFrame:
    return T.source_symbols(_sources(t))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN 'pub const S' || s_suppkey || ': u64 = ' || s_nationkey || ';' WHEN 1 THEN 'pub static S' || s_suppkey || ': u64 = ' || s_nationkey || ';' WHEN 2 THEN 'pub type S' || s_suppkey || ' = u64;'
    WHEN 3 THEN 'use S' || s_suppkey || ' as ' || s_nationkey || ';' WHEN 4 THEN 'pub mod S' || s_suppkey || ';' WHEN 5 THEN 'pub struct S' || s_suppkey || ' {' || chr(10) || '    a,' || chr(10) || '    b,' || chr(10) || '}' WHEN 6 THEN 'pub enum S' || s_suppkey || ' {' || chr(10) || '    a,' || chr(10) || '    b,' || chr(10) || '}'
    ELSE 'pub fn S' || s_suppkey || 'u64 {' || chr(10) || '    a' || chr(10) || '    b' || chr(10) || '}' END AS text FROM supplier""")
def m27_rendered(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("Const", "Static", "TypeAlias", "Use", "Module", "Struct", "Enum", "Function")))
    kind = F.get(kinds, (F.col("s_suppkey") % 8).cast("int"))
    text = T.rendered(kind, F.concat(F.lit("S"), "s_suppkey"), F.lit("pub "), F.lit("u64"), F.col("s_nationkey").cast("string"), F.array(F.lit("a"), F.lit("b")))
    return t.supplier.select(F.col("s_suppkey").alias("id"), text.alias("text"))


@query("""SELECT path, text, strlen(text) // 4 AS tokens FROM (SELECT 'src/s' || s_suppkey || '.rs' AS path, 'src/s' || s_suppkey || '.rs:' || chr(10) || '  pub mod b' || chr(10) || '  pub fn run' || s_suppkey || chr(10) || '  struct S' || chr(10) || '  enum E' || chr(10) AS text FROM supplier)""")
def m28_repo_map(t: Tables) -> DataFrame:
    return T.repo_map(T.source_symbols(_sources(t)))


_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]', '_', 'g')"
_MOD = "'file.' || regexp_replace(lower(module), '[^a-z0-9]', '_', 'g')"
PARTS = """parts AS (SELECT s_suppkey AS id, 'Struct' AS kind, 'S-' || s_suppkey % 70 AS name, 'M::' || s_nationkey AS module, NULL::BIGINT AS struct, NULL::BIGINT AS impl FROM supplier
    UNION ALL SELECT 1000000 + p_partkey, CASE p_size % 3 WHEN 0 THEN 'Impl' WHEN 1 THEN 'Enum' ELSE 'Trait' END, p_name, 'M::' || p_size % 25, CASE WHEN p_size % 3 = 0 THEN p_partkey % 120 END, NULL FROM part
    UNION ALL SELECT 9000000 + c_custkey, 'Function', 'F ' || c_custkey, 'M::' || c_nationkey, NULL, CASE WHEN c_custkey % 2 = 0 THEN 1000000 + c_custkey END FROM customer)"""


def _laid_out(t: Tables) -> DataFrame:
    node = lambda df, key, first, kind, name, module, struct="null", impl="null": df.select(F.expr(f"{first} + {key}").cast("long").alias("id"), F.expr(kind).alias("kind"), F.expr(name).alias("name"), F.expr(f"concat('M::', {module})").alias("module"), F.expr(f"cast({struct} as bigint)").alias("struct"), F.expr(f"cast({impl} as bigint)").alias("impl"))
    out = node(t.supplier, "s_suppkey", 0, "'Struct'", "concat('S-', s_suppkey % 70)", "s_nationkey")
    out = out.unionByName(node(t.part, "p_partkey", 1_000_000, "case p_size % 3 when 0 then 'Impl' when 1 then 'Enum' else 'Trait' end", "p_name", "p_size % 25", "if(p_size % 3 = 0, p_partkey % 120, null)"))
    return out.unionByName(node(t.customer, "c_custkey", 9_000_000, "'Function'", "concat('F ', c_custkey)", "c_nationkey", impl="if(c_custkey % 2 = 0, 1000000 + c_custkey, null)"))


@query(f"""WITH {PARTS}, t AS (SELECT id, module, {_MOD} || '.' || {_PLAIN.format('name')} AS file, {_PLAIN.format('name')} || '.rs' AS path, kind FROM parts WHERE kind IN ('Struct', 'Enum', 'Trait')),
    own AS (SELECT p.id, p.module, CASE WHEN p.kind = 'Impl' THEN p.struct ELSE i.struct END AS struct FROM parts p LEFT JOIN parts i ON p.kind = 'Function' AND i.kind = 'Impl' AND p.impl = i.id WHERE p.kind IN ('Impl', 'Function')),
    typed AS (SELECT id AS node, module, file, path FROM t UNION ALL SELECT o.id, o.module, coalesce(t.file, 'file.' || {_PLAIN.format('o.module')} || '.mod'), coalesce(t.path, 'mod.rs') FROM own o LEFT JOIN t ON t.kind = 'Struct' AND t.id = o.struct AND t.module = o.module),
    flat AS (SELECT id AS node, module, CASE kind WHEN 'Function' THEN 'fn' ELSE lower(kind) END AS w, CASE kind WHEN 'Impl' THEN id::VARCHAR ELSE {_PLAIN.format('name')} END AS s FROM parts)
    SELECT 'per_type' AS strategy, * FROM typed UNION ALL SELECT 'single_file', id, module, {_MOD} || '.mod', 'mod.rs' FROM parts UNION ALL SELECT 'original', id, module, {_MOD} || '.mod', 'mod.rs' FROM parts
    UNION ALL SELECT 'flat_nodes', node, module, {_MOD} || '.' || w || '.' || s, w || '_' || s || '.rs' FROM flat UNION ALL SELECT 'canonical_normalized', node, module, {_MOD} || '.' || w || '.' || s, w || '_' || s || '.rs' FROM flat""")
def m30_layouts(t: Tables) -> DataFrame:
    """Each strategy's files for suppliers as structs, parts as impls, enums and traits, customers as functions."""
    nodes = _laid_out(t)
    base = L.layout(nodes, "single_file")
    laid = [L.layout(nodes, s, base).withColumn("strategy", F.lit(s)) for s in ("original", *L.STRATEGIES)]
    return reduce(DataFrame.unionByName, laid)


@query("SELECT f AS function, 'non_negative(' || f || ')' AS condition, v >= 0 AS holds, CASE WHEN v < 0 THEN v END AS counterexample FROM (SELECT 'c_acctbal' AS f, min(c_acctbal) AS v FROM customer UNION ALL SELECT 'c_custkey', min(c_custkey) FROM customer UNION ALL SELECT 'c_nationkey', min(c_nationkey) FROM customer)")
def m24_postconditions(t: Tables) -> DataFrame:
    return R.postconditions(t.customer, {c: [c] for c in ("c_acctbal", "c_custkey", "c_nationkey")})


@query("""WITH e AS (SELECT event_id AS seq, 'k' || user_id % 50 AS key, event_type, value FROM events), o AS (SELECT seq, unnest([0, 1]) AS part, unnest([key, 'k0']) AS key FROM e WHERE event_type = 'purchase')
    SELECT seq, 0 AS part, CASE event_type WHEN 'view' THEN 'AddNode' WHEN 'error' THEN 'RemoveNode' WHEN 'click' THEN 'UpdateNode' END AS op, key, CASE event_type WHEN 'view' THEN 'InsertAfter:v' || seq WHEN 'click' THEN 'RenameIdent:v' || seq ELSE 'v' || seq END AS payload FROM e WHERE event_type <> 'purchase'
    UNION ALL SELECT seq, part, 'UpdateNode', key, 'position:' || part FROM o""")
def m25_edit_changes(t: Tables) -> DataFrame:
    """Events as edits: views insert, clicks rename, errors delete, purchases reorder, and signups are a mutation that no edit knows."""
    edit = F.expr("case event_type when 'view' then 'InsertAfter' when 'error' then 'DeleteNode' when 'purchase' then 'ReorderItems' when 'click' then 'MutateField' else 'Transmute' end")
    key = F.expr("concat('k', user_id % 50)")
    rows = t.events.select(F.col("event_id").alias("seq"), edit.alias("edit"), key.alias("key"), F.lit("RenameIdent").alias("mutation"), F.concat(F.lit("v"), "event_id").alias("value"), F.array(key, F.lit("k0")).alias("items"))
    return V.edit_changes(rows)


@query("""WITH RECURSIVE a AS (SELECT 'crate::m' || n_nationkey || '::x' AS src, 'crate::m' || (n_nationkey // 2) || '::x' AS dst FROM nation WHERE n_nationkey > 2),
    s AS (SELECT s_suppkey AS id, 'crate::m' || s_nationkey || '::x' AS pos FROM supplier), w AS (SELECT id, pos, 0 AS hops FROM s UNION ALL SELECT id, dst, hops + 1 FROM w JOIN a ON pos = src WHERE hops < 8)
    SELECT id, CASE WHEN pos <> 'crate::m2::x' THEN pos END AS symbol, hops::INT AS hops FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1""")
def y1_path_resolution(t: Tables) -> DataFrame:
    m = lambda n: F.concat(F.lit("crate::m"), n, F.lit("::x"))
    sites = t.supplier.select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("self::x"), F.lit("x"), F.concat(F.lit("super::m"), "s_nationkey", F.lit("::x"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("path"), F.concat(F.lit("crate::m"), "s_nationkey").alias("module"))
    aliases = t.nation.where("n_nationkey > 2").select(m(F.col("n_nationkey")).alias("src"), m(F.expr("n_nationkey div 2")).alias("dst"))
    symbols = t.nation.where("n_nationkey != 2").select(m(F.col("n_nationkey")).alias("path"))
    return Y.resolve_paths(sites, symbols, aliases)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'inner' WHEN c_custkey % 2 = 0 THEN 'outer' END AS binding FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def y2_scopes(t: Tables) -> DataFrame:
    uses = t.customer.select(F.col("c_custkey").alias("id"), F.lit("v").alias("name"), F.expr("array(concat('o', c_custkey % 2), concat('i', c_custkey % 3))").alias("scopes"))
    bindings = t.spark.createDataFrame([("v", "o0", "outer"), ("v", "i0", "inner")], "name string, scope string, binding string")
    return Y.innermost(uses, bindings)


@query("""WITH f AS (SELECT c_custkey AS id, c_nationkey AS module, c_custkey // 3 AS name, c_custkey % 3 <> 0 AS public FROM customer), s AS (SELECT c_custkey AS caller, c_nationkey AS module, c_custkey // 6 AS name FROM customer),
    o AS (SELECT name, min(id) AS far FROM f WHERE public GROUP BY 1 HAVING count(*) = 1)
    SELECT DISTINCT caller, coalesce(f.id, far) AS callee FROM s LEFT JOIN f ON f.module = s.module AND f.name = s.name AND f.public LEFT JOIN o ON o.name = s.name WHERE coalesce(f.id, far) IS NOT NULL AND coalesce(f.id, far) <> caller""")
def y3_call_discovery(t: Tables) -> DataFrame:
    f = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("module"), F.expr("c_custkey div 3").alias("name"), F.expr("c_custkey % 3 != 0").alias("public"))
    sites = t.customer.select(F.col("c_custkey").alias("caller"), F.col("c_nationkey").alias("module"), F.expr("c_custkey div 6").alias("name"))
    return Y.call_edges(sites, f)


@query("""SELECT src, dst, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT 'r' || n_regionkey || '::n' || n_nationkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'r' || (s_suppkey % 5) END AS dst, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    WHERE src <> dst AND NOT starts_with(src, dst || '::') GROUP BY 1, 2""")
def y4_module_edges(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    uses = rows.select(F.expr("concat('r', n_regionkey, '::n', n_nationkey)").alias("src"), F.expr("if(s_suppkey % 2 = 0, concat('r', n_regionkey), concat('r', s_suppkey % 5))").alias("dst"), F.col("s_name").alias("name"))
    return Y.module_edges(uses).withColumn("names", F.array_join("names", ","))


@query("SELECT DISTINCT 'src/s' || a.s_suppkey || '.rs' AS path, 'src/s' || a.s_nationkey || '.rs' AS target FROM supplier a WHERE a.s_nationkey BETWEEN 1 AND 20 AND a.s_nationkey <> a.s_suppkey")
def y5_y6_file_dependencies(t: Tables) -> DataFrame:
    deps = T.source_dependencies(_sources(t))
    modules = t.nation.where("n_nationkey between 1 and 20").select(F.concat(F.lit("m"), "n_nationkey", F.lit("::x")).alias("module"), F.concat(F.lit("src/s"), "n_nationkey", F.lit(".rs")).alias("path"))
    return Y.file_dependencies(deps, modules)


@query("""WITH l AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    w AS (SELECT path, line, unnest(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*')) AS name, generate_subscripts(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*'), 1) AS nth FROM l)
    SELECT path, line::INT AS line, nth::INT AS nth, name FROM w WHERE name IN ('the', 'der', 'la')""")
def y7_symbol_uses(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("the",), ("der",), ("la",)], "name string")
    return T.symbol_uses(t.documents.select(F.col("doc_id").cast("string").alias("path"), "text"), names)


@query("SELECT kind, a, b FROM (VALUES ('module', 'parse', NULL), ('module', 'lint', NULL), ('import', 'lint', 'parse'), ('goal', 'pipeline', NULL), ('step', 'parse', 'lint')) v(kind, a, b)")
def y8_proposals(t: Tables) -> DataFrame:
    text = "module parse\n module lint imports parse\n\ngoal pipeline: parse -> lint\nnothing"
    return T.proposal(t.region.where("r_regionkey = 0").select(F.lit(text).alias("text"))).select("kind", "a", "b")


@query("SELECT 'module' AS kind, 'module.' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') AS id, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1")
def y9_proposal_nodes(t: Tables) -> DataFrame:
    nodes = t.part.select(F.lit("module").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("p_brand").alias("name"))
    return Y.proposal_nodes(nodes)[1]


@query("SELECT 'delta.p.' || row_number() OVER (ORDER BY r_regionkey % 2, r_name) AS delta, r_name AS id FROM region")
def y10_acceptance(t: Tables) -> DataFrame:
    return Y.accept(t.region.select(F.concat(F.lit("k"), F.col("r_regionkey") % 2).alias("kind"), F.col("r_name").alias("id")), "p").select("delta", "id")


def _dot(t: Tables) -> DataFrame:
    heads = t.nation.select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("n"), F.explode(F.expr("array(struct(0 as o, concat('subgraph cluster_c', n_nationkey % 2, ' {') as line), struct(1 as o, concat('  a', n_nationkey, ' [label=\"n', n_nationkey, '\"];') as line), struct(2 as o, '}' as line), struct(3 as o, concat('  a', n_nationkey, ' -> b', n_regionkey, ';') as line))")).alias("l"))
    return heads.select("graph", (F.col("n") * 10 + F.col("l.o")).alias("pos"), "l.line")


@query("SELECT 'c' || n_nationkey % 2 AS cluster, string_agg('a' || n_nationkey, ',' ORDER BY 'a' || n_nationkey) AS members FROM nation GROUP BY 1")
def s13_y11_dot_topology(t: Tables) -> DataFrame:
    nodes, _ = dot.parse_dot(_dot(t))
    return dot.topology(nodes).withColumn("members", F.array_join("members", ","))


@query("SELECT n_regionkey AS graph, 'a' || n_nationkey AS src, 'b' || n_regionkey AS dst FROM nation")
def s13_dot_edges(t: Tables) -> DataFrame:
    return dot.parse_dot(_dot(t))[1].select("graph", "src", "dst")


@query(f"WITH {DAG} SELECT src, src || ': ' || string_agg(dst::VARCHAR, ', ' ORDER BY dst::VARCHAR) AS line FROM dag GROUP BY 1")
def k6_flat_dependencies(t: Tables) -> DataFrame:
    return dot.flat_dependencies(dag(t))


@query(f"""WITH {DAG} SELECT '  "' || n_nationkey || '" [label="' || n_name || '"];' AS line FROM nation UNION ALL SELECT '  "' || src || '" -> "' || dst || '";' FROM dag UNION ALL SELECT unnest(['digraph {{', '}}'])
    UNION ALL SELECT unnest(['subgraph "cluster_' || r_regionkey || '" {{', '}}']) FROM region""")
def k6_dot_lines(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), "n_regionkey")
    return dot.dot_lines(nodes, dag(t), F.col("n_regionkey")).select("line")


@query("SELECT p_partkey AS id, p_size % 4 = 1 OR p_size % 4 = 2 AS fits FROM part")
def y12_version_gate(t: Tables) -> DataFrame:
    own, ok = (F.col("p_size") % 4).cast("string"), F.when(F.col("p_size") % 4 == 2, F.array(F.lit("1")))
    return t.part.select(F.col("p_partkey").alias("id"), Y.version_fits(F.lit("1"), own, ok).alias("fits"))


@query(f"WITH {DAG} SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 7 >= 2 AND n_nationkey >= 18 AND NOT EXISTS (FROM dag WHERE dst = n_nationkey AND src >= 18)")
def y13_dispatch(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 7 / 10).alias("trust"))
    return Y.dispatchable(nodes, dag(t), nodes.where("id < 18").select("id"), F.lit(0.2)).select("id")


@query("""WITH o AS (SELECT s_name AS symbol, CASE s_suppkey % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'delete' ELSE 'move' END AS op, s_suppkey AS k FROM supplier)
    SELECT DISTINCT op, symbol, l_partkey % 10 AS file, CASE op WHEN 'rename' THEN 'replace use' WHEN 'delete' THEN 'remove use' ELSE 'repath use' END AS action FROM o JOIN lineitem ON l_suppkey = k""")
def y15_edit_propagation(t: Tables) -> DataFrame:
    ops = t.supplier.select(F.col("s_name").alias("symbol"), F.element_at(F.array(*map(F.lit, ("rename", "delete", "move"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("op"))
    occurrences = t.lineitem.select("l_suppkey", (F.col("l_partkey") % 10).alias("file")).distinct().join(t.supplier.select("s_suppkey", F.col("s_name").alias("symbol")), F.col("l_suppkey") == F.col("s_suppkey")).select("symbol", "file")
    return Y.propagate_edits(ops, occurrences, occurrences.limit(0))


@query("SELECT event_id, user_id FROM events WHERE event_id % 100 <= 40")
def y17_ledger_restore(t: Tables) -> DataFrame:
    ledger = t.events.select("event_id", "user_id", (F.col("event_id") % 100).alias("epoch"))
    return files.restore_ledger(ledger, 40).select("event_id", "user_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 500 = 77 GROUP BY 1")
def y18_tampering(t: Tables) -> DataFrame:
    """A stored chain of hashes, some of which were changed: the first wrong one of each chain."""
    good = materialize(V.running_hashes(t.events, "user_id", "event_id", "event_type", "value"), "hashes")
    stored = good.withColumn("stored", F.when(F.col("event_id") % 500 == 77, "changed").otherwise(F.col("hash"))).drop("hash")
    rows = t.events.select("user_id", "event_id", "event_type", "value").join(stored, ["user_id", "event_id"])
    return V.tampered(rows, "user_id", "event_id", "stored", "event_type", "value")


@query("SELECT user_id AS file, event_id AS seq FROM events WHERE event_id < (SELECT coalesce(min(e.event_id), 9223372036854775807) FROM events e WHERE e.user_id = events.user_id AND e.event_id % 300 = 11)")
def s10_intact_prefix(t: Tables) -> DataFrame:
    """Records with a checksum, some broken: those before the first broken one of each file."""
    rows = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), "event_type", (F.crc32(F.col("event_type").cast("binary")) + (F.col("event_id") % 300 == 11).cast("long")).alias("crc"))
    return V.valid_prefix(rows, "file", "seq", F.crc32(F.col("event_type").cast("binary")) == F.col("crc")).select("file", "seq")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s12_k1_ledger_round_trip(t: Tables) -> DataFrame:
    """Events written as lines of JSON in two appends and read back by their schema."""
    import uuid

    path = f"{own_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("user_id").alias("shell_id"), F.col("event_id").alias("epoch"), F.col("event_type").alias("command"), F.lit("").alias("state_hash"))
    rows.where("epoch % 2 = 0").write.mode("append").json(path)
    rows.where("epoch % 2 = 1").write.mode("append").json(path)
    return files.read_ledger(t.spark, path).groupBy(F.col("command").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN a.s IS NULL THEN 'added' ELSE 'removed' END AS change, coalesce(a.s, b.s) AS id FROM (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 3 = 0) b ON a.s = b.s WHERE a.s IS NULL OR b.s IS NULL")
def k8_diff_report(t: Tables) -> DataFrame:
    ids = t.supplier.select(F.col("s_suppkey").alias("id"))
    return differences(ids.where("id % 2 = 0"), ids.where("id % 3 = 0"), ["id"], ["id"]).select("change", "id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extra_windowed_counts(t: Tables) -> DataFrame:
    """An extra, not in the inventory: daily windows over events; `streaming` has the same with a watermark."""
    from graphloom.streaming.windows import windowed_counts

    return windowed_counts(t.events, "1 day").select(F.col("start").alias("day"), "event_type", "n")


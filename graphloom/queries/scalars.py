"""Scalar, text and graph-of-columns operators (OP-X*, OP-M14 to OP-M17, OP-M29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar as X
from graphloom.functions import text as T
from graphloom.operators.relational import branch_label, meta_interval, trust_threshold, updated_policy
from graphloom.plans import dag as P
from graphloom.queries.registry import query
from graphloom.recipes import Tables


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, 'th')) AS part, generate_subscripts(string_split(text, 'th'), 1) AS k, len(string_split(text, 'th')) AS n FROM documents)
    SELECT doc_id, pos::INT AS at FROM (SELECT doc_id, k, n, sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY k) + 2 * (k - 1) AS pos FROM p) WHERE k < n""")
def x1_occurrences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.occurrences(F.col("text"), "th")).alias("at"))


@query("SELECT page_id, unnest(list_filter(range(1, length(url)::BIGINT + 1), lambda i: url[i:i + 1] = 'tt'))::INT - 1 AS at FROM pages")
def x2_rolling_matches(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(X.occurrences(F.col("url"), "tt")).alias("at"))


@query("SELECT DISTINCT p_size AS a, gcd(p_partkey, p_size * 6)::BIGINT AS g, p_partkey % 5 AS e, (p_size::HUGEINT ** (p_partkey % 5))::DECIMAL(38, 0)::VARCHAR AS power FROM part")
def x3_gcd_power(t: Tables) -> DataFrame:
    e = F.col("p_partkey") % 5
    return t.part.select(F.col("p_size").alias("a"), X.gcd(F.col("p_partkey"), F.col("p_size") * 6).alias("g"), e.alias("e"), X.power(F.col("p_size"), e).cast("string").alias("power")).distinct()


@query("SELECT n AS p FROM range(2, 1001) r(n) WHERE NOT EXISTS (FROM range(2, 32) d(m) WHERE m < n AND n % m = 0)")
def x3_sieve(t: Tables) -> DataFrame:
    return X.primes(t.spark, 1000)


@query("""WITH m AS (SELECT vec_id % 64 AS i, j - 1 AS j, sum(floor(embedding[j] * 100)::BIGINT)::BIGINT AS v FROM embeddings, range(1, 65) r(j) GROUP BY ALL)
    SELECT a.i, b.j, sum(a.v * b.v)::BIGINT AS v FROM m a JOIN m b ON a.j = b.i GROUP BY ALL""")
def x4_matmul(t: Tables) -> DataFrame:
    cells = t.embeddings.select((F.col("vec_id") % 64).alias("i"), F.posexplode("embedding").alias("j", "x"))
    m = cells.groupBy("i", F.col("j").cast("long").alias("j")).agg(F.sum(F.floor(F.col("x") * F.lit(100).cast("float"))).alias("v"))
    return X.matmul(m, m)


@query("WITH RECURSIVE f AS (SELECT 0 AS n, 0::HUGEINT AS a, 1::HUGEINT AS b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60) SELECT DISTINCT p_size AS n, a::VARCHAR AS fib FROM part JOIN f ON n = p_size")
def x5_fibonacci(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("n")).distinct().select("n", X.fibonacci(F.col("n")).cast("string").alias("fib"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 10 THEN l_quantity * 2 ELSE l_quantity - l_linenumber END, 4) AS value, l_linenumber * 3 + 4 AS stacked FROM lineitem")
def x7_expressions(t: Tables) -> DataFrame:
    q = {"col": "l_quantity"}
    tree = {"if": [{"op": "<", "args": [q, 10]}, {"op": "*", "args": [q, 2]}, {"op": "-", "args": [q, {"col": "l_linenumber"}]}]}
    code = [("load", "l_linenumber"), ("push", 3), ("*",), ("push", 4), ("+",)]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(P.expression(tree), 4).alias("value"), P.stack_program(code).alias("stacked"))


@query("SELECT p_partkey AS id, p_partkey * p_size AS value, (length(regexp_replace(p_name, '[^aeiou]', '', 'g')) % 2) = 0 AS even FROM part")
def x8_parse_accept(t: Tables) -> DataFrame:
    text = F.concat_ws(" * ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    symbols = F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.when(c.isin(*"aeiou"), "v").otherwise("c"))
    delta = {(0, "v"): 1, (1, "v"): 0, (0, "c"): 0, (1, "c"): 1}
    return t.part.select(F.col("p_partkey").alias("id"), X.three_tokens(text).alias("value"), X.accepts(symbols, delta, {0}).alias("even"))


#: Leaves of the tree over orders.
LEAVES = 256
_UP = "l{1} AS (SELECT idx // 2 AS idx, sha256(unhex(max(hash) FILTER (idx % 2 = 0) || max(hash) FILTER (idx % 2 = 1))) AS hash FROM l{0} GROUP BY 1)"
MERKLE = f"l0 AS (SELECT o_orderkey % {LEAVES} AS idx, sha256(count(*) || ':' || sum(o_custkey)::BIGINT) AS hash FROM orders GROUP BY 1), " + ", ".join(_UP.format(k, k + 1) for k in range(8))


def _leaves(t: Tables) -> DataFrame:
    """Orders in LEAVES parts, each with what its rows add up to."""
    parts = t.orders.groupBy((F.col("o_orderkey") % LEAVES).alias("idx")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))
    return parts.select("idx", X.leaf_hash(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"))).alias("hash"))


@query(f"WITH {MERKLE} " + " UNION ALL ".join(f"SELECT {k} AS level, idx, hash FROM l{k}" for k in range(9)))
def x9_merkle(t: Tables) -> DataFrame:
    return X.merkle_levels(_leaves(t))


@query(f"WITH {MERKLE} " + " UNION ALL ".join(f"SELECT {k} AS level, hash, {5 >> k & 1} = 1 AS \"left\", true AS valid FROM l{k} WHERE idx = {5 >> k ^ 1}" for k in range(8)))
def x9_merkle_proof(t: Tables) -> DataFrame:
    """The way up from leaf 5, and whether it leads to the root."""
    levels = X.merkle_levels(_leaves(t))
    proof = X.merkle_proof(levels, 5)
    ends = levels.agg(F.max(F.when((F.col("level") == 0) & (F.col("idx") == 5), F.col("hash"))).alias("leaf"), F.max_by("hash", "level").alias("root"))
    path = proof.agg(F.sort_array(F.collect_list(F.struct("level", "hash", "left"))).alias("p"), F.lit(1).alias("one"))  # a row a level
    valid = path.join(ends.withColumn("one", F.lit(1)), "one").select("one", X.verify_proof(F.col("leaf"), F.col("p"), F.col("root")).alias("valid"))
    return proof.withColumn("one", F.lit(1)).join(valid, "one").drop("one")


@query("""SELECT page_id, sha256(string_agg(h, '' ORDER BY i)) AS hash FROM (SELECT page_id, i, sha256(substr(html, i * 4096 + 1, 4096)) AS h FROM pages, range(0, 64) r(i) WHERE i * 4096 < length(html)) GROUP BY 1""")
def x10_page_hashes(t: Tables) -> DataFrame:
    """Pages of 4096 characters, hashed apart and then together, in standard SHA-256."""
    n = F.greatest(F.ceil(F.length("html") / 4096), F.lit(1)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(F.col("html"), i * 4096 + 1, F.lit(4096)).cast("binary"), 256))
    return t.pages.where("length(html) > 0").select("page_id", F.sha2(F.array_join(cuts, "").cast("binary"), 256).alias("hash"))


@query("SELECT event_id, sha256('event:' || strlen(event_type) || ':' || event_type || ':' || strlen(user_id::VARCHAR) || ':' || user_id) AS hash FROM events")
def x11_event_hash(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.event_hash("event", F.col("event_type"), F.col("user_id")).alias("hash"))


@query("SELECT conv_id, turn, 0 AS block, 'rust' AS language, role || chr(10) || 'end' AS content, 'rust' AS type FROM conversations UNION ALL SELECT conv_id, turn, 1, NULL, '{' || turn || '}', 'json' FROM conversations")
def x12_code_blocks(t: Tables) -> DataFrame:
    """Blocks of a text built around each turn, as the tables have no fences, and their types (OP-X13)."""
    text = F.concat(F.lit("intro\n```rust\n"), "role", F.lit("\nend\n```\nbetween\n```\n{"), "turn", F.lit("}\n```\n```\n```"))
    found = T.code_blocks(t.conversations.select("conv_id", "turn", text.alias("text")))
    return found.withColumn("type", T.classify_block(F.col("language"), F.col("content")))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'update' END AS op, CASE WHEN s_suppkey % 4 = 3 THEN 'PATCH' ELSE s_name END AS path, s_suppkey % 2 = 0 AS structured FROM supplier")
def x14_patches(t: Tables) -> DataFrame:
    verb = F.element_at(F.array(*map(F.lit, ("Add", "Update", "Delete", "Move"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("*** Begin Patch\n*** "), verb, F.lit(" File: "), "s_name", F.lit(" \n+x\n"), F.when(F.col("s_suppkey") % 2 == 0, "*** End Patch").otherwise(""))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), text.alias("text"))
    return rows.select("id", T.patch_target(F.col("text"))["op"].alias("op"), T.patch_target(F.col("text"))["path"].alias("path"), T.is_structured_patch(F.col("text")).alias("structured"))


@query("SELECT s_suppkey AS id, 0 AS pos, 'pending' AS status, s_name AS step FROM supplier UNION ALL SELECT s_suppkey, 1, 'in_progress', 'b.c' FROM supplier")
def x15_plan_steps(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Explanation: why\n1. [pending] "), "s_name", F.lit("\n2. [In Progress] b.c\n3. [other] d\n4. none\n5. [completed]  "))
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.posexplode(T.plan_steps(text)).alias("pos", "s")).select("id", "pos", "s.status", "s.step")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'ls|-l|x' ELSE 'sh|-lc|cd ' || s_nationkey || chr(10) || 'ls' END AS words FROM supplier")
def x16_shell_words(t: Tables) -> DataFrame:
    text = F.when(F.col("s_suppkey") % 2 == 0, "ls  -l x  \n```\n").otherwise(F.concat(F.lit("cd "), "s_nationkey", F.lit("  \n\nls\n")))
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.array_join(T.shell_words(text), "|").alias("words"))


@query("""WITH r AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)
    SELECT user_id, coalesce(string_agg(CASE WHEN event_type = 'click' THEN '[' || event_id || ']' ELSE event_type[1:1] END, '' ORDER BY event_id) FILTER (event_id >= coalesce(c, 0) AND event_type <> 'error'), '') AS text FROM events JOIN r USING (user_id) GROUP BY 1""")
def x17_folded_patches(t: Tables) -> DataFrame:
    """Events as patches: a click replaces the text, an error goes to another path, all others append a letter."""
    op = F.struct("event_id", F.expr("if(event_type = 'error', '/other', '/message/content/parts/0')").alias("path"), F.expr("if(event_type = 'click', 'replace', 'append')").alias("op"), F.expr("if(event_type = 'click', concat('[', event_id, ']'), substring(event_type, 1, 1))").alias("value"))
    return t.events.groupBy("user_id").agg(F.sort_array(F.collect_list(op)).alias("ops")).select("user_id", T.folded_text(F.col("ops")).alias("text"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN event_type || '!' END AS text, event_id % 5 = 4 AS done FROM events""")
def x18_stream_frames(t: Tables) -> DataFrame:
    frames = [
        F.concat(F.lit('data: {"v": "'), "event_type", F.lit('"}')),
        F.concat(F.lit('{"o": "append", "p": "/message/content/parts/0", "v": "'), "event_type", F.lit('"}')),
        F.concat(F.lit('{"o": "patch", "v": [{"o": "append", "p": "/parts/0", "v": "'), "event_type", F.lit('"}, {"o": "append", "p": "/status", "v": "x"}, {"o": "append", "p": "/parts/0", "v": "!"}]}')),
        F.lit('data: {"type": "x", "v": "no"}'),
        F.lit("data: [DONE]"),
    ]
    raw = F.element_at(F.array(*frames), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", T.frame_text(raw).alias("text"), T.frame_done(raw).alias("done"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'crate::m' || s_nationkey WHEN 1 THEN 'crate::m' || s_nationkey || '::b' WHEN 2 THEN 'crate' ELSE 'crate::x::y' END AS module,
    CASE s_suppkey % 4 WHEN 0 THEN 'crate' WHEN 1 THEN 'crate::m' || s_nationkey WHEN 2 THEN '' ELSE 'crate::x' END AS dir FROM supplier""")
def x19_module_paths(t: Tables) -> DataFrame:
    m = F.concat(F.lit("src/m"), "s_nationkey")
    path = F.element_at(F.array(F.concat(m, F.lit("/mod.rs")), F.concat(m, F.lit("/b.rs")), F.lit("src/lib.rs"), F.lit("x/y.rs")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), T.module_path(path).alias("module"), T.module_dir(T.module_path(path)).alias("dir"))


@query("SELECT p_partkey AS id, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS ident, regexp_full_match(trim(p_name), '[A-Za-z][A-Za-z0-9_]*') AS word FROM part")
def x20_identifiers(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), T.sanitized(F.col("p_brand")).alias("ident"), T.is_word(F.col("p_name")).alias("word"))


@query("SELECT s_suppkey AS id, s_name AS path, 'a \"b\"' AS quoted, 'ls -l' AS ll, true AS glob, false AS other FROM supplier")
def x21_shell_dumps(t: Tables) -> DataFrame:
    dump = F.concat(F.lit("declare -x PATH=old\ndeclare -x PATH='"), "s_name", F.lit("'\n declare -x Q=\"a \\\"b\\\"\"\ndeclare -i N=1\nalias ll='ls -l'\nshopt -p glob\nshopt -u other"))
    env, names, opts = T.declares(dump), T.aliases(dump), T.shopts(dump)
    return t.supplier.select(F.col("s_suppkey").alias("id"), env["PATH"].alias("path"), env["Q"].alias("quoted"), names["ll"].alias("ll"), opts["glob"].alias("glob"), opts["other"].alias("other"))


@query("""SELECT p_partkey AS id, (CASE WHEN p_size % 2 = 1 THEN p_size ELSE 1 END) || ',' || (CASE WHEN p_size % 3 = 1 THEN 9 ELSE 2 END) || ',3' AS merged,
    (CASE WHEN p_size % 2 = 1 THEN p_size ELSE 0 END) || ',' || (CASE WHEN p_size % 3 = 1 THEN (CASE WHEN p_size % 2 = 1 THEN 9 ELSE p_size END) ELSE 0 END) || ',0' AS dense FROM part""")
def x22_masks(t: Tables) -> DataFrame:
    ints = lambda *xs: F.array(*[x.cast("int") if not isinstance(x, int) else F.lit(x) for x in xs])
    mask = F.array(F.col("p_size") % 2 == 1, F.col("p_size") % 3 == 1, F.lit(False))
    merged = X.merge_masked(ints(1, 2, 3), ints(F.col("p_size"), 9, 7), mask)
    dense = X.to_dense(ints(F.col("p_size"), 9), mask)
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(merged.cast("array<string>"), ",").alias("merged"), F.array_join(dense.cast("array<string>"), ",").alias("dense"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'old' ELSE event_type END AS kind, user_id::VARCHAR AS who, 'x' AS keep FROM events")
def x24_metadata(t: Tables) -> DataFrame:
    old = F.create_map(*map(F.lit, ("kind", "old", "keep", "x")))
    new = F.create_map(F.lit("kind"), F.expr("if(event_type = 'view', '', event_type)"), F.lit("who"), F.col("user_id").cast("string"))
    m = X.only_keys(X.merge_metadata(old, new), "kind", "who", "keep")
    return t.events.select("event_id", m["kind"].alias("kind"), m["who"].alias("who"), m["keep"].alias("keep"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, chr((65 + event_id % 26)::INT) AS label FROM events")
def x25_formats(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", X.from_millis(ms).alias("at"), branch_label(F.col("event_id") % 26).alias("label"))


@query("""SELECT c_custkey AS id, round(0.1 + 0.1 * (c_acctbal / 1000 - 0.5), 9) AS rate, round(0.5 + 0.1 * (c_acctbal / 1000 - 0.5), 9) AS baseline, least(greatest(round(10 / (abs(c_acctbal) / 1000 + 0.1)), 2), 50)::BIGINT AS interval,
    round(least(greatest(0.5 - 0.05 * c_acctbal / 1000, 0.1), 0.95), 9) AS threshold FROM customer""")
def x26_x27_policy(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("r"), F.lit(0.1).alias("rate"), F.lit(0.5).alias("baseline"))
    new = updated_policy(F.col("r"), "rate", "baseline", [])
    return rows.select("id", F.round(new["rate"], 9).alias("rate"), F.round(new["baseline"], 9).alias("baseline"), meta_interval(F.abs("r")).alias("interval"), F.round(trust_threshold(F.col("r")), 9).alias("threshold"))


@query("SELECT p_partkey AS id, array_to_string(list_concat([1, 2, 3, 4][p_size % 4 + 1:], [1, 2, 3, 4][:p_size % 4]), ',') AS rotated FROM part")
def x28_rotate(t: Tables) -> DataFrame:
    items = F.array(*map(F.lit, (1, 2, 3, 4)))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(X.rotate_left(items, F.col("p_size")).cast("array<string>"), ",").alias("rotated"))


@query("""SELECT p_partkey AS id, (SELECT max(s) FROM (SELECT (m % 2) * p_size + (m // 2 % 2) * 7 + (m // 4) * 11 AS s FROM range(8) r(m)) WHERE s <= 30)::INT AS best FROM part""")
def x29_knapsack(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), X.best_subset_sum(F.array(F.col("p_size"), F.lit(7), F.lit(11)), 30).alias("best"))


@query("""SELECT o_custkey, CASE WHEN count(*) > 1 THEN list_sort(list((o_totalprice * 100)::BIGINT))[count(*) // 2] END AS best FROM orders GROUP BY 1""")
def x30_genetic(t: Tables) -> DataFrame:
    """A generation over each customer's orders: children lie between their parents, so the best is the largest that is kept."""
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list(F.round(F.col("o_totalprice") * 100).cast("long")).alias("x"))
    return lists.select("o_custkey", X.genetic(F.col("x"), 1).alias("best"))


@query("SELECT p_partkey AS id, p_size * 2 AS doubled, p_size * 2 + 1 AS next, (p_size * 2) + (p_size * 2 + 1) AS total FROM part")
def m14_column_graph(t: Tables) -> DataFrame:
    functions = {"double": lambda c: {"x": c["x"] * 2}, "next": lambda c: {"y": c["x"] + 1}, "total": lambda c: {"z": c["x"] + c["y"]}}
    out = P.execute_graph(t.part, functions, [("double", "next"), ("double", "total"), ("next", "total")], {"x": "p_size"})
    return out.select(F.col("p_partkey").alias("id"), F.col("`double.x`").alias("doubled"), F.col("`next.y`").alias("next"), F.col("`total.z`").alias("total"))


@query("SELECT 'first' AS side, p_partkey FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT 'second', p_partkey FROM part WHERE p_partkey % 150 = 1")
def m15_run_differences(t: Tables) -> DataFrame:
    keys = t.part.select("p_partkey")
    return P.verify_equal(keys.where("p_partkey % 150 != 1"), keys.where("p_partkey % 100 != 0"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def m16_composition(t: Tables) -> DataFrame:
    return P.compose(t.customer, [lambda d: d.where("c_acctbal > 0"), lambda d: d.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")), lambda d: d.groupBy("n_name").agg(F.count("*").alias("n"))])


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice <= 1000 THEN 'price' WHEN o_orderstatus = 'F' THEN 'status' END AS gate FROM orders")
def m17_gates(t: Tables) -> DataFrame:
    return P.gated(t.orders, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "F"}).select(F.col("o_orderkey").alias("id"), "gate")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x * x)::FLOAT))::DOUBLE, 3) AS energy FROM embeddings")
def m29_lanes(t: Tables) -> DataFrame:
    squared = X.lanes(F.col("embedding"), F.col("embedding"), "mul")
    return t.embeddings.select("vec_id", F.round(F.aggregate(squared, F.lit(0.0).cast("double"), lambda s, x: s + x), 3).alias("energy"))

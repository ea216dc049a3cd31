"""Operators on literal fixtures, and laws that hold for any input."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom import engine
from graphloom.functions import scalar as X
from graphloom.functions import text as T
from graphloom.operators import analysis as A
from graphloom.operators import graph as G
from graphloom.operators import layout as LA
from graphloom.operators import relational as R
from graphloom.operators import resolution as Y
from graphloom.operators import rules as RU
from graphloom.operators import solvers as S
from graphloom.operators import structural
from graphloom.operators import versions as V
from graphloom.plans import dag as P
from graphloom.plans import ordered
from graphloom.queries import ORACLE_SQL, QUERIES
from graphloom.sources import dot, files, framed
from graphloom.streaming import changelog, windows

DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]


@pytest.fixture(scope="module")
def edges(spark):
    return lambda rows: spark.createDataFrame(rows, "src long, dst long") if not rows or len(rows[0]) == 2 else spark.createDataFrame(rows, "src long, dst long, weight long")


@pytest.fixture(scope="module")
def nodes(spark):
    return lambda n: spark.range(n)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def test_levels(edges, nodes, spark):
    assert pairs(G.levels(nodes(5), edges(DIAMOND), spark.range(1))) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, -1)]


def test_reach_ignores_roots_that_are_no_node(edges, nodes, spark):
    assert pairs(G.reach(edges(DIAMOND), spark.createDataFrame([(1,), (99,)], "id long"), nodes(4))) == [(1,), (3,)]


def test_peel_and_cycles(edges, nodes):
    assert pairs(G.peel(nodes(4), edges(DIAMOND))) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert sorted((r.id, r.level is None) for r in G.peel(nodes(4), edges([(0, 1), (1, 2), (2, 1), (3, 0)])).collect()) == [(0, False), (1, True), (2, True), (3, False)]
    assert G.is_acyclic(nodes(2), edges([(1, 1)])).first().acyclic is False
    assert G.is_acyclic(nodes(2), edges([])).first().acyclic is True


def test_scc_and_condensation(edges, nodes, spark):
    e = edges([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)])
    comps = G.scc(nodes(6), e)
    assert pairs(comps) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]
    groups, between = G.condense(e, comps)
    assert pairs(between) == [(0, 3)] and {r.label for r in groups.collect()} == {"[cycle: 0, 1, 2]", "[cycle: 3, 4]", "5"}
    assert sorted((r.component, r.path) for r in G.witness_cycle(e, comps).collect()) == [(0, [0, 1, 2, 0]), (3, [3, 4, 3])]


def test_shortest(edges, nodes):
    assert pairs(G.shortest(nodes(5), edges([(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 1)]), 0))[:4] == [(0, 0), (1, 3), (2, 1), (3, 4)]
    with pytest.raises(RuntimeError):
        G.shortest(nodes(2), edges([(0, 1, -1), (1, 0, -1)]), 0)


def test_dominators(edges):
    doms = G.dominators(edges(DIAMOND), 0)
    assert pairs(doms) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 3)]
    assert pairs(G.immediate_dominators(doms)) == [(1, 0), (2, 0), (3, 0)]
    # Loops, ways of different lengths and nodes that the entry does not reach, against what is left without each node.
    import random

    rng = random.Random(3)
    e = sorted({(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(22)} | {(i, i + 1) for i in range(0, 9)} | {(30, 3)})

    def reached(without):
        out, ahead = set(), [0] if without != 0 else []
        while ahead:
            v = ahead.pop()
            if v not in out:
                out.add(v)
                ahead += [b for a, b in e if a == v and b != without]
        return out

    want = sorted((v, d) for v in reached(None) for d in reached(None) if v == d or v not in reached(d))
    assert pairs(G.dominators(edges(e), 0)) == want


def test_reaching_definitions(spark):
    preds = spark.createDataFrame([(1, 0), (2, 1)], "block int, pred int")
    gen = spark.createDataFrame([(0, "d0"), (1, "d1")], "block int, def string")
    assert pairs(G.reaching_definitions(preds, gen, gen.limit(0))) == [(0, "d0"), (1, "d0"), (1, "d1"), (2, "d0"), (2, "d1")]
    kill = spark.createDataFrame([(1, "d0")], "block int, def string")
    assert pairs(G.reaching_definitions(preds, gen, kill)) == [(0, "d0"), (1, "d1"), (2, "d1")]


def test_closure_is_idempotent(edges):
    once = G.closure(edges([(0, 1), (1, 2), (2, 0), (3, 1)]))
    assert pairs(G.closure(once)) == pairs(once)


def test_csr_keeps_repeats(edges, nodes):
    got = pairs(G.csr(nodes(4), edges([(0, 2), (0, 1), (0, 1), (3, 0)])).select("id", "row_ptr", "degree"))
    assert got == [(0, 0, 3), (1, 3, 0), (2, 3, 0), (3, 3, 1)]


def test_windows_over_a_whole_table(spark):
    rows = [(i * 3 - 50, None if i % 4 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "o long, v long")
    last, total, want = None, 0, []
    for o, v in rows:
        want.append((o, last, total))
        last, total = v if v is not None else last, total + (v or 0)
    got = ordered.running_sum(ordered.previous(df, "o", "v", "p", rows=7), "o", "v", "s", rows=7)
    assert pairs(got.select("o", "p", "s")) == want
    assert ordered.previous(df.limit(0), "o", "v").count() == 0


def test_structural_changes(spark):
    items = spark.createDataFrame([("structs", "s", None, {"visibility": "pub"}), ("fields", "s.a", "s", {})], "collection string, id string, parent string, props map<string,string>")
    rows = [(0, "AddField", "s.a", "s", None), (1, "AddField", "s.b", "s", None), (2, "RemoveField", "s.a", None, None), (3, "AddField", "s.a", "s", None), (4, "UpdateStructVisibility", "s", None, "private"), (5, "AddField", "q.a", "q", None), (6, "UpdateFunctionAst", "f", None, "x"), (7, "RenameArtifact", "s", "structs", "t"), (8, "Odd", "z", None, None)]
    deltas = spark.createDataFrame(rows, "seq long, payload string, id string, parent string, value string")
    state, errors = structural.apply_payloads(items, deltas)
    assert sorted((r.collection, r.id, r.parent, r.props) for r in state.collect()) == [("fields", "s.a", "t", {}), ("fields", "s.b", "t", {}), ("structs", "t", None, {"visibility": "private"})]
    assert pairs(errors) == [(0, "duplicate"), (5, "unknown parent"), (6, "unknown target"), (8, "unknown payload")]
    adm = spark.createDataFrame([("a1", "j", ["d1"]), ("a2", "k", ["d2"])], "id string, judgment string, delta_ids array<string>")
    jud = spark.createDataFrame([("j", "Accept"), ("k", "Reject")], "id string, decision string")
    ds = spark.createDataFrame([("d1", 0, "AddModule", "m", None, None), ("d2", 0, "AddModule", "n", None, None)], "delta string, seq long, payload string, id string, parent string, value string")
    after, applied, moved = structural.apply_admitted(items, adm, jud, ds)
    assert after.count() == 3 and pairs(applied) == [("a1", "d1", 0)] and moved == pytest.approx(1 / 3)
    after, applied, _ = structural.apply_admitted(items, adm, jud, ds, theta=0.1)
    assert after.count() == 2 and applied.count() == 0


def test_trust_and_chase(edges, nodes, spark):
    got = dict(pairs(G.trust(nodes(4), edges([(0, 1, 1), (0, 2, 3), (1, 3, 1), (2, 3, 1)]))))
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}
    loop = G.chase(edges([(0, 1), (1, 2), (2, 1)]), spark.range(1))
    assert pairs(loop) == [(0, 2, 2)]
    assert pairs(G.chase(edges([(i, i + 1) for i in range(20)]), spark.range(1), 8)) == [(0, 8, 8)]


def test_batches_that_share_a_dependency(edges, spark):
    order = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3)], "pos long, id long")
    assert pairs(G.batches(order, edges(DIAMOND), shared=True)) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert pairs(G.batches(order, edges(DIAMOND))) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_containing_and_solvers(spark):
    n = spark.createDataFrame([(0, "Crate", "c", "pub", False), (1, "Module", "m", "pub", False), (2, "Module", "n", "pub", False), (3, "Function", "f", "private", False), (4, "Function", "f", "pub", True), (5, "Function", "g", "pub", False)], "id long, kind string, name string, visibility string, unsafe boolean")
    e = spark.createDataFrame([(0, 1, "Contains"), (1, 2, "Contains"), (1, 3, "Contains"), (2, 4, "Contains"), (1, 5, "Contains"), (4, 3, "Resolves"), (5, 3, "Resolves"), (5, 4, "Calls")], "src long, dst long, kind string")
    assert {r.id: r.owner for r in G.containing(n, e.where("kind = 'Contains'")).collect()} == {0: None, 1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
    assert pairs(S.private_uses(n, e)) == [(4, 3)]
    assert pairs(S.needed_uses(n, e)) == [(2, 3)]
    assert pairs(S.unsafe_calls(n, e.where("kind = 'Calls'"))) == [(5, 4)]
    impls = spark.createDataFrame([(1, 10, None), (2, 10, None), (3, 11, "T")], "id long, struct long, trait string")
    structs = spark.createDataFrame([(10, "Struct")], "id long, kind string")
    assert pairs(S.impl_defects(structs, impls)) == [("duplicate impl", "10/"), ("unknown struct", "3")]
    v = spark.createDataFrame([("A",), ("B",)], "variant string")
    body = spark.createDataFrame([("match x { E::A => 1 }",)], "text string")
    assert pairs(S.unmentioned(v, body)) == [("B",)]
    assert pairs(S.unmentioned(v, body.unionByName(spark.createDataFrame([("_ => 2",)], "text string")))) == []


def test_locksets(spark):
    t = spark.createDataFrame([(0, "a", "acquire", "l"), (1, "a", "access", "x"), (2, "a", "release", "l"), (3, "b", "access", "x"), (4, "b", "acquire", "l"), (5, "b", "access", "x")], "seq long, thread string, action string, target string")
    assert pairs(A.races(A.held_locks(t))) == [("x", 1, 3)]


def test_alias_of_unknown(edges, spark):
    asked = spark.createDataFrame([(0, 1), (0, 9)], "p long, q long")
    assert pairs(A.may_alias(edges([(0, 5), (1, 5)]), asked)) == [(0, 1, True), (0, 9, False)]


def test_genetic(spark):
    """By hand: [1, 5, 10, 7, 3] keeps 1 and 3; the generator's first picks are odd and even, so means of 1 and 3, 2, come in."""
    lists = spark.createDataFrame([(1, [1, 5, 10, 7, 3]), (2, [9]), (3, None), (4, [4, 4, 8, 2])], "id int, x array<long>")
    best = lambda generations, **how: {r.id: r.best for r in lists.select("id", X.genetic(F.col("x"), generations, **how).alias("best")).collect()}
    assert best(0) == {1: 10, 2: 9, 3: None, 4: 8}
    assert best(1) == {1: 3, 2: None, 3: None, 4: 4}
    assert best(10)[1] == 1  # the lower half again and again
    assert best(1, fitness=lambda x: -x) == {1: 7, 2: None, 3: None, 4: 4}


def test_emission_order(spark):
    kinds = ["MacroCall", "TypeRef", "Method", "Function", "Impl", "Impl", "Static", "Const", "TypeAlias", "Trait", "Enum", "Struct", "Use", "Module", "Crate"]
    rows = [(i, k, "b" if k == "Enum" else "a", f"z{i}", "S", "T" if i == 4 else None) for i, k in enumerate(kinds)] + [(99, "Struct", "c", None, None, None), (98, "Function", "a", None, None, None)]
    got = S.stable_order(spark.createDataFrame(rows, "id long, kind string, name string, path string, struct string, trait string"))
    want = [14, 13, 12, 10, 11, 99, 9, 8, 7, 6, 5, 4, 3, 98, 2, 1, 0]
    assert [r.id for r in got.orderBy("bucket", "pos").collect()] == want


def test_noise_and_messages(spark):
    assert [column(spark, R.is_noise_type(F.lit(x))) for x in ("my::String", "usize", "Vec<()>", "()", "Order")] == [True, True, False, True, False]
    assert column(spark, R.is_noise_definition(F.lit("<A as std::ops::Add>::add"))) and not column(spark, R.is_noise_definition(F.lit("a::ops::add")))
    rows = [("system", "text", ["", " ", None]), ("system", "text", []), ("system", "text", None), ("system", "text", ["x"]), ("system", "code", [""]), ("user", "text", [""]), ("user", "user_editable_context", ["x"]), ("assistant", "model_editable_context", ["x"]), (None, None, None)]
    got = spark.createDataFrame(rows, "role string, kind string, parts array<string>").select(R.is_message(F.col("role"), F.col("kind"), F.col("parts")).alias("m")).collect()
    assert [r.m for r in got] == [False, False, True, True, True, True, False, False, True]
    assert column(spark, R.truncated(F.array(*map(F.lit, "abcd")), 3)) == ["a", "b", "c", "... (1 more items truncated)"]


def test_reconnect(spark):
    dead = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["Z"]), (3, [])], "id long, inputs array<string>")
    live = spark.createDataFrame([(10, "long::module", ["A", "B"]), (11, "m", ["B", "C", "D"]), (12, "m", ["A", "B"])], "id long, module string, inputs array<string>")
    assert pairs(R.reconnect(dead, live)) == [(1, 11, 0.5), (2, None, 0.0), (3, None, 0.0)]


def test_defect_classes(spark):
    v = lambda *rows: spark.createDataFrame(rows, "rule string, subject string, detail string")
    edge = lambda *rows: spark.createDataFrame(rows, "`from` string, `to` string")
    modules = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    functions = spark.createDataFrame([("f", "b", "b.standalone"), ("g", "a", "i")], "id string, module string, impl_id string")
    impls = spark.createDataFrame([("i", ""), ("j", "t")], "id string, trait_id string")
    t = {"modules": modules, "module_edges": edge(("a", "b")), "functions": functions, "impls": impls}

    def cls(rule, subject, detail="", **other):
        return tuple(RU.diagnose(v((rule, subject, detail)), t | other).select("class", "cycle").first())

    assert cls("VersionEvolution", "") == ("ValidatorOverConstraint", None) and cls("DeltaProofs", "d") == ("WrongValue", None)
    assert cls("ExecutionOnlyInImpl", "f") == ("MissingEmit", None) and cls("ExecutionOnlyInImpl", "g") == ("WrongValue", None)
    assert cls("ImplBinding", "i", "trait_id: missing") == ("ValidatorOverConstraint", None) and cls("ImplBinding", "i", "module")[0] == cls("ImplBinding", "j", "trait_id: t")[0] == "WrongValue"
    assert cls("ModuleDag", "f", module_edges=edge(("a", "b")).limit(0)) == ("MissingEmit", None)
    assert cls("ModuleDag", "x", module_edges=edge(("b", "c"), ("c", "b"), ("a", "b"))) == ("CycleDetected", ["b", "c"])
    assert cls("CallGraphRespectsDag", "f") == ("WrongDirection", None) and cls("CallGraphRespectsDag", "g") == ("MissingContext", None)


@pytest.mark.parametrize(("ast", "n"), [(None, 0), ('{"kind": "closure", "body": [{"kind": "if_expr"}, {"kind": 3}]}', 0), ('{"kind": "literal", "x": {"kind" : "binary"}}', 2), ('{"kind": "lit", "value": "\\"kind\\": \\"x\\""}', 0)])
def test_kinds_of_syntax_nodes(spark, ast, n):
    rule = RU.KnownKinds("FunctionAst", "functions", "ast")
    assert rule.check({"functions": spark.createDataFrame([("f", ast)], "id string, ast string")}).count() == n


@pytest.mark.parametrize(("n", "label"), [(0, "A"), (25, "Z"), (26, "AA"), (27, "AB"), (701, "ZZ"), (702, "AAA")])
def test_branch_label(spark, n, label):
    assert column(spark, R.branch_label(F.lit(n))) == label


def test_branch_labels_after_zzz_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    # One group of 60,000 rows, past the code points of one byte; a key that is null comes last.
    key = F.when(F.col("id") > 0, F.col("id"))
    spark.range(60_000).select(key.alias("c_custkey"), F.lit(2).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(con.execute(ORACLE_SQL["w7_branch_labels"]).fetchall())
    got = {r.id: r.label for r in QUERIES["w7_branch_labels"](spark, str(tmp_path)).collect()}
    assert (got[18_278], got[18_279], got[18_279 + 37 * 676]) == ("ZZZ", "[AA", "\x80AA") and got == want
    assert column(spark, R.branch_label(F.lit(18_278))) == "AAAA"


def test_folds(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 2.0)], "o int, v double")
    assert rows.agg(R.ema(F.col("o"), F.col("v"), 0.5).alias("e")).first().e == 1.0
    assert column(spark, X.best_subset_sum(F.array(F.lit(2), F.lit(3), F.lit(4)), 5)) == 5
    assert column(spark, R.subsets(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [[], [3], [2], [2, 3], [1], [1, 3], [1, 2], [1, 2, 3]]
    assert column(spark, X.fibonacci(F.lit(90))) == 2880067194370816120
    assert column(spark, X.gcd(F.lit(-48), F.lit(36))) == 12 and column(spark, X.gcd(F.lit(0), F.lit(0))) == 0
    assert pairs(X.primes(spark, 30)) == [(p,) for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)]


@pytest.mark.parametrize(("text", "pattern", "at"), [("abracadabra", "abra", [0, 7]), ("aaaa", "aa", [0, 1, 2]), ("éaéa", "a", [2, 5]), ("", "a", []), ("b", "a", []), ("a.a", ".", [1])])
def test_occurrences(spark, text, pattern, at):
    assert column(spark, X.occurrences(F.lit(text), pattern)) == at


def test_merkle(spark):
    leaves = spark.createDataFrame([(i, hashlib.sha256(c.encode()).hexdigest()) for i, c in enumerate("abcd")], "idx long, hash string")
    levels = X.merkle_levels(leaves)
    assert levels.where("level = 2").first().hash == "14ede5e8e97ad9372327728f5099b95604a39593cac3bd38a343ad76205213e7"
    proof = [(r.level, r.hash, r.left) for r in X.merkle_proof(levels, 2).orderBy("level").collect()]
    path = F.array(*[F.struct(F.lit(h).alias("hash"), F.lit(left).alias("left")) for _, h, left in proof])
    leaf = F.lit(hashlib.sha256(b"c").hexdigest())
    assert column(spark, X.verify_proof(leaf, path, F.lit(levels.where("level = 2").first().hash)))
    assert not column(spark, X.verify_proof(leaf, path, F.lit("00")))
    with pytest.raises(ValueError):
        X.merkle_levels(leaves.limit(3))


def test_matrices(spark):
    eye = spark.createDataFrame([(i, i, 1) for i in range(3)], "i int, j int, v long")
    assert pairs(X.matmul(eye, eye)) == [(0, 0, 1), (1, 1, 1), (2, 2, 1)]


def test_masks_and_intervals(spark):
    mask = F.array(F.lit(True), F.lit(False), F.lit(True))
    ints = lambda *x: F.array(*map(F.lit, x))
    assert column(spark, X.merge_masked(ints(1, 2, 3), ints(7, 8, 9), mask)) == [7, 2, 9]
    assert column(spark, X.to_dense(ints(5, 6), mask)) == [5, 0, 6]
    iv = lambda lo, hi: F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    assert tuple(column(spark, A.join_interval(iv(0, 3), iv(2, 9)))) == (0, 9)
    assert tuple(column(spark, A.widen_interval(iv(0, 3), iv(2, 9)))) == (0, A.HIGH)


def test_code_blocks(spark):
    text = "a\n```rust\nfn x() {}\n```\n```\n```\n```\n```py\nx = 1\n```\n```sh\nopen"
    df = spark.createDataFrame([(1, text), (2, None), (3, "```\n```")], "id int, text string")
    got = [(r.id, r.block, r.language, r.content) for r in T.code_blocks(df).orderBy("id", "block").collect()]
    assert got == [(1, 0, "rust", "fn x() {}"), (1, 1, "py", "x = 1"), (1, 2, "sh", "open")]


@pytest.mark.parametrize(("lang", "body", "kind"), [("Diff", "", "patch"), ("bash", "", "shell"), (None, "*** Begin Patch", "patch"), (None, "#!/bin/sh", "shell"), (None, "  [1]", "json"), ("jl", "{", "julia"), (None, "x", "other")])
def test_block_types(spark, lang, body, kind):
    assert column(spark, T.classify_block(F.lit(lang), F.lit(body))) == kind


def test_text_parsers(spark):
    c = lambda x: column(spark, x)
    assert tuple(c(T.patch_target(F.lit("x\n*** Delete File:  a/b.rs \n")))) == ("delete", "a/b.rs")
    assert tuple(c(T.patch_target(F.lit("nothing")))) == ("update", "PATCH")
    assert [tuple(s) for s in c(T.plan_steps(F.lit("EXPLANATION: e\n1. [Completed] a [b]\n2. x\n3. [in progress]  y")))] == [("completed", "a [b]"), ("in_progress", "y")]
    assert c(T.plan_explanation(F.lit("x\nExplanation: why not"))) == "why not"
    assert c(T.shell_words(F.lit("ls -l  \n```\n"))) == ["ls", "-l"] and c(T.shell_words(F.lit("a\nb"))) == ["sh", "-lc", "a\nb"] and c(T.shell_words(F.lit(""))) == []
    assert c(T.frame_text(F.lit('data: {"v": "x"}'))) == "x" and c(T.frame_text(F.lit('{"v": "x", "type": "t"}'))) is None and c(T.frame_text(F.lit("data: [DONE]"))) is None
    assert c(T.frame_done(F.lit('{"type": "message_stream_complete"}'))) and not c(T.frame_done(F.lit('{"v": "x"}')))
    assert c(T.module_path(F.lit("src/a/mod.rs"))) == "crate::a" and c(T.module_path(F.lit("src/main.rs"))) == "crate" and c(T.module_dir(F.lit("a::b::c"))) == "a::b"
    assert c(T.declares(F.lit("declare -x A=\"x \\\"y\\\"\"\ndeclare -x B\ndeclare -x A='z'"))) == {"A": "z", "B": ""}
    assert c(T.shopts(F.lit("shopt -p a\nshopt -u b\nx"))) == {"a": True, "b": False}


def test_visibility_and_policy(spark):
    see = lambda sym, site, scope: column(spark, R.is_visible(F.lit(sym), F.lit(site), F.lit(scope), F.lit("a::b")))
    assert see("a::x", "b", "public") and see("a::x", "a::y", "crate") and not see("a", "b", "crate")
    assert see("a", "a::b", "super") and not see("a::b", "a", "super") and see("a::b", "a::b", "private") and see("q", "a::b::c", "restricted")
    assert column(spark, R.trust_threshold(F.lit(100.0))) == 0.1 and column(spark, R.trust_threshold(F.lit(None).cast("double"))) == 0.5
    assert column(spark, R.meta_interval(F.lit(0.9))) == 10


def test_symbol_query(spark):
    s = spark.createDataFrame([("fn", "a::b", "Run"), ("struct", "a", "runner"), ("fn", "c", "x")], "kind string, module string, name string")
    assert R.symbol_query(s).count() == 3
    assert pairs(R.query_request(s, {"kinds": ["fn"], "name_contains": "RUN"})) == [("fn", "a::b", "Run")]
    with pytest.raises(ValueError):
        R.query_request(s, {"kind": "fn"})


def log_of(spark, rows):
    return spark.createDataFrame(rows, "seq long, op string, key string, payload string")


ROWS = [(0, "AddNode", "a", "1"), (1, "AddNode", "b", "1"), (2, "UpdateNode", "a", "2"), (3, "RemoveNode", "b", None), (4, "AddNode", "c", "1"), (5, "AddNode", "b", "9")]


def test_replay(spark):
    log = log_of(spark, ROWS)
    assert pairs(V.replay(log).select("key", "payload")) == [("a", "2"), ("b", "9"), ("c", "1")]
    assert pairs(V.replay(log, 4).select("key", "payload")) == [("a", "2")]
    assert pairs(V.replay(log, mode="first").select("key", "payload")) == [("a", "1"), ("b", "1"), ("c", "1")]
    for upto in range(7):
        assert pairs(V.replay(V.compact(log, upto))) == pairs(V.replay(log))


def test_diff_applies(spark):
    log = log_of(spark, ROWS)
    a, b = V.replay(log, 3).select("key", "payload"), V.replay(log).select("key", "payload")
    assert pairs(V.apply_changes(a, V.changes(a, b))) == pairs(b)
    assert V.changes(a, a).count() == 0


def test_merge(spark):
    state = lambda **kv: spark.createDataFrame(list(kv.items()), "key string, payload string")
    got = pairs(V.merge(state(a="1", b="1", c="1", d="1"), state(a="2", b="1", c="2", d="1"), state(a="1", b="3", c="4")))
    assert got == [("a", "2", False), ("b", "3", False), ("c", "2", True)]


def test_admission(spark):
    req = spark.createDataFrame([(0, "j", 5, 1), (1, "j", 5, 1), (2, "j", 1, 2), (3, "k", 5, 3)], "seq long, judgment string, epoch long, nonce long")
    jud = spark.createDataFrame([("j", True), ("k", False)], "judgment string, approved boolean")
    assert [r.decision for r in V.admitted(req, jud, 2).orderBy("seq").collect()] == ["admitted", "replayed", "stale", "rejected"]


def test_version_store(spark, tmp_path):
    store = V.VersionStore(spark, f"file://{tmp_path}/s")
    assert store.version() == -1
    log = log_of(spark, ROWS)
    assert store.append(log.where("seq < 3"), expected=-1) == 0 and store.append(log.where("seq >= 3")) == 1
    with pytest.raises(ValueError):
        store.append(log, expected=0)
    assert pairs(store.snapshot()) == pairs(V.replay(log)) and pairs(store.snapshot(0)) == pairs(V.replay(log, 3))
    assert pairs(store.checkpoint("c", store.snapshot())) == pairs(store.restore("c"))


def test_tampering(spark):
    rows = spark.createDataFrame([("f", i, f"e{i}") for i in range(5)], "file string, seq long, entry string")
    stored = rows.join(V.running_hashes(rows, "file", "seq", "entry"), ["file", "seq"]).withColumnRenamed("hash", "stored")
    assert V.tampered(stored, "file", "seq", "stored", "entry").count() == 0
    changed = stored.withColumn("entry", F.when(F.col("seq") == 2, "x").otherwise(F.col("entry")))
    assert pairs(V.tampered(changed, "file", "seq", "stored", "entry")) == [("f", 2)]


def valid(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "modules": df([(1,), (2,)], "id long"),
        "module_edges": df([(1, 1, 2, ["X"])], "id long, `from` long, `to` long, imported_types array<string>"),
        "structs": df([(1, 1, [("a",)])], "id long, module long, fields array<struct<name:string>>"),
        "traits": df([(1, 2, ["f"])], "id long, module long, functions array<string>"),
        "impls": df([(1, 1, 1, 1)], "id long, module long, struct_id long, trait_id long"),
        "functions": df([(1, 1, 1, "public", True, True, True, True, True, ["o"], [1], None)], "id long, module long, impl_id long, visibility string, total boolean, deterministic boolean, explicit_inputs boolean, explicit_outputs boolean, effects_are_deltas boolean, outputs array<string>, deltas array<long>, ast string"),
        "deltas": df([(1, "Act", "State", 1, True, 1)], "id long, stage string, kind string, proof long, append_only boolean, related_function long"),
        "proofs": df([(1, "Execution")], "id long, scope string"),
        "rewards": df([(1, 1, 1.0, 1.0), (2, 2, 2.0, None)], "id long, seq long, reward double, snapshot double"),
    }


def rules_of(tables):
    return {r.rule for r in RU.validate(tables, RU.STANDARD_RULES).collect()}


def test_valid_artifacts_have_no_violation(spark):
    assert rules_of(valid(spark)) == set()


@pytest.mark.parametrize(
    ("table", "change", "rule"),
    [
        ("deltas", {"stage": "'Decide'"}, "DeltaPipeline"),
        ("proofs", {"scope": "'Law'"}, "ProofScope"),
        ("deltas", {"proof": "9L"}, "DeltaProofs"),
        ("deltas", {"append_only": "false"}, "DeltaAppendOnly"),
        ("impls", {"struct_id": "9L"}, "ImplBinding"),
        ("impls", {"module": "2L"}, "ImplBinding"),
        ("functions", {"impl_id": "cast(null as bigint)"}, "ExecutionOnlyInImpl"),
        ("functions", {"total": "false"}, "FunctionContracts"),
        ("functions", {"effects_are_deltas": "false"}, "EffectsAreDeltas"),
        ("functions", {"deltas": "array(1L, 7L)"}, "EffectsAreDeltas"),
        ("functions", {"ast": "'{\"kind\": \"goto\"}'"}, "FunctionAst"),
        ("module_edges", {"to": "9L"}, "ModuleDag"),
        ("module_edges", {"to": "1L"}, "ModuleSelfImport"),
        ("module_edges", {"imported_types": "array(' ')"}, "ModuleDag"),
        ("structs", {"fields": "array(struct('a' as name), struct('a' as name))"}, "StructShape"),
        ("traits", {"functions": "cast(array() as array<string>)"}, "TraitVerbs"),
        ("rewards", {"reward": "-seq * 1D"}, "RewardCollapseDetected"),
    ],
)
def test_one_defect_gives_its_rule(spark, table, change, rule):
    tables = valid(spark)
    tables[table] = tables[table].withColumns({k: F.expr(v) for k, v in change.items()})
    assert rule in rules_of(tables)


def test_call_rules(spark):
    tables = valid(spark)
    f = tables["functions"]
    tables["functions"] = f.unionByName(f.withColumns({"id": F.lit(2).cast("long"), "module": F.lit(2).cast("long"), "visibility": F.lit("private")}))
    calls = lambda rows: tables | {"call_edges": spark.createDataFrame(rows, "id long, caller long, callee long")}
    only = [r for r in RU.STANDARD_RULES if r.rule.startswith("CallGraph")]
    rules = lambda t: {r.rule for r in RU.validate(t, only).collect()}
    assert rules(calls([(1, 1, 2)])) == {"CallGraphPublicApis"}
    assert rules(calls([(1, 2, 1)])) == {"CallGraphRespectsDag"}
    assert "CallGraphAcyclic" in rules(calls([(1, 1, 2), (2, 2, 1)]))


def test_resolution(spark):
    sites = spark.createDataFrame([(1, "self::x", "crate::a"), (2, "super::a::x", "crate::b"), (3, "gone", "crate::a")], "id long, path string, module string")
    aliases = spark.createDataFrame([("crate::a::x", "crate::c::y")], "src string, dst string")
    symbols = spark.createDataFrame([("crate::c::y",)], "path string")
    assert pairs(Y.resolve_paths(sites, symbols, aliases)) == [(1, "crate::c::y", 1), (2, "crate::c::y", 1), (3, None, 0)]


def test_columns_graph(spark):
    double = lambda c: {"v": c["v"] * 2}
    df = P.execute_graph(spark.createDataFrame([(5,)], "s long"), {"a": double, "b": double}, [("a", "b")], {"v": "s"})
    assert df.first()["b.v"] == 20
    with pytest.raises(ValueError):
        P.dependency_order(["a", "b"], [("a", "b"), ("b", "a")])
    assert column(spark, P.stack_program([("push", 2), ("push", 3), ("+",)])) == 5


def test_frames(spark, tmp_path):
    data = b"".join(framed.frame(p) for p in (b"one", b"", b"three"))
    (tmp_path / "a.log").write_bytes(data + struct.pack("<I", 50) + b"torn")
    broken = bytearray(data)
    broken[5] ^= 1
    (tmp_path / "b.log").write_bytes(bytes(broken))
    rows = framed.read_frames(spark, str(tmp_path))
    assert rows.count() == 7 and framed.count_frames(spark, str(tmp_path)) == 7
    assert [bytes(r.payload) for r in framed.intact(rows).orderBy("seq").collect()] == [b"one", b"", b"three"]
    spark.dataSource.register(framed.FramedLog)
    assert spark.read.format("framed_log").load(f"{tmp_path}/*.log").count() == 7
    assert zlib.crc32(b"one") == struct.unpack("<I", framed.frame(b"one")[-4:])[0]


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"nodes": [{"id": 0, "kind": "Crate"}, {"id": 1, "kind": "Module"}],\n "edge_hints": [{"src": 0, "dst": 1, "kind": "Contains"}], "emit_order": [1, 0]}')
    n, e, o = files.load_model(spark, str(tmp_path / "m.json"))
    assert n.count() == 2 and e.first().kind == "Contains" and pairs(o) == [(0, 1), (1, 0)]
    (tmp_path / "s.json").write_text('{"modules": [{"id": "a"}], "odd": []}')
    with pytest.raises(ValueError):
        files.load_collections(spark, str(tmp_path / "s.json"), {"modules": "id string"})
    assert files.load_collections(spark, str(tmp_path / "s.json"), {"modules": "id string", "odd": "id string"})["modules"].count() == 1
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("use crate::b;\npub fn run() {}\n")
    tree = files.source_tree(spark, str(tmp_path))
    assert pairs(tree.select("path", "bytes")) == [("src/a.rs", 30)]
    assert [(r.kind, r.name, r.public) for r in T.source_symbols(tree).collect()] == [("fn", "run", True)]
    assert pairs(T.source_dependencies(tree)) == [("src/a.rs", "b")]


def test_dot(spark):
    text = ["digraph {", "subgraph cluster_c {", '  a [label="A"];', "}", "  b;", "  a -> b;", "}"]
    nodes, found = dot.parse_dot(spark.createDataFrame([(0, i, x) for i, x in enumerate(text)], "graph int, pos int, line string"))
    assert sorted((r.id, r.label, r.cluster) for r in nodes.collect()) == [("a", "A", "c"), ("b", None, None)]
    assert [(r.src, r.dst) for r in found.collect()] == [("a", "b")]
    out = [r.line for r in dot.dot_lines(nodes, found, F.col("cluster")).orderBy("pos").collect()]
    assert out[0] == "digraph {" and out[-1] == "}" and '  "a" -> "b";' in out and 'subgraph "cluster_c" {' in out


def test_stream_of_changes(spark, tmp_path):
    log_of(spark, ROWS).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, op string, key string, payload string").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        changelog.to_versions(stream, f"file://{tmp_path}/store", str(tmp_path / "cp")).awaitTermination()
    assert pairs(V.VersionStore(spark, f"file://{tmp_path}/store").snapshot()) == pairs(V.replay(log_of(spark, ROWS)))


def test_windows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 05:00:00")], "user_id int, at string").select("user_id", F.to_timestamp("at").alias("ts"), F.lit("x").alias("event_type"))
    assert [r.n for r in windows.windowed_counts(rows, "1 hour").orderBy("start").collect()] == [2, 1]
    assert [r.n for r in windows.sessions(rows, "30 minutes").orderBy("start").collect()] == [2, 1]


def test_engine(spark, edges, nodes):
    e = engine.Engine(spark)
    e.register("ns", nodes(4))
    e.register("es", edges(DIAMOND))
    e.register("order", e.graph("ns", "es").order())
    assert pairs(e.sql("select max(level) from order")) == [(2,)]
    e.register("symbols", spark.createDataFrame([("fn", "m", "Run")], "kind string, module string, name string"))
    assert e.symbols("symbols", '{"name_contains": "run"}').count() == 1
    e.register("modules", spark.createDataFrame([(1,), (1,)], "id long"))
    assert [r.rule for r in e.validate(["modules"]).collect()] == ["ExplicitArtifacts"]


def test_nearest_ancestors(spark):
    keys = ["a", "a::b::c", "a::b::c::d", "ab::c", "x::y", "a::bb"]
    got = R.nearest_ancestors(spark.createDataFrame([(k,) for k in [*keys, "a"]], "key string"))
    assert pairs(got) == [("a::b::c", "a"), ("a::b::c::d", "a::b::c"), ("a::bb", "a")]


def test_layouts(spark):
    rows = [(1, "Struct", "My-Type", "M::A", None, None), (2, "Enum", "my_type", "M::A", None, None), (3, "Impl", None, "M::A", 1, None), (4, "Impl", None, "M::B", 1, None), (5, "Function", "run", "M::A", None, 3), (6, "Function", "go", "M::A", None, None), (7, "Module", "m", "M::A", None, None)]
    nodes = spark.createDataFrame(rows, "id long, kind string, name string, module string, struct long, impl long")
    of = lambda s, **how: {r.node: (r.file, r.path) for r in LA.layout(nodes, s, **how).collect()}
    assert set(of("single_file").values()) == {("file.m__a.mod", "mod.rs"), ("file.m__b.mod", "mod.rs")}
    own = ("file.m__a.my_type", "my_type.rs")
    assert of("per_type") == {1: own, 2: own, 3: own, 4: ("file.m__b.mod", "mod.rs"), 5: own, 6: ("file.m__a.mod", "mod.rs")}
    assert of("flat_nodes") == of("canonical_normalized") and of("flat_nodes")[1] == ("file.m__a.struct.my_type", "struct_my_type.rs") and of("flat_nodes")[5] == ("file.m__a.fn.run", "fn_run.rs") and of("flat_nodes")[3] == ("file.m__a.impl.3", "impl_3.rs")
    assert pairs(LA.layout(nodes, "original", LA.layout(nodes, "per_type"))) == pairs(LA.layout(nodes, "per_type"))


def test_snapshots_are_verified_and_compared(spark):
    nodes = spark.createDataFrame([(i, "Module", f"n{i}") for i in range(4)], "id long, kind string, name string")
    edge = lambda *rows: spark.createDataFrame(rows, "src long, dst long, kind string")
    assert V.verify(nodes, edge((0, 1, "Contains"), (0, 2, "Contains"), (1, 2, "Calls"), (2, 1, "Calls"))).count() == 0
    bad = V.verify(nodes.unionByName(nodes.where("id = 3")), edge((0, 1, "Contains"), (2, 1, "Contains"), (1, 2, "Contains"), (0, 9, "Calls"), (3, 3, "Expands"), (3, 3, "Expands")))
    assert sorted({r.rule for r in bad.collect()}) == ["AcyclicContains", "AcyclicExpands", "Endpoint", "OneContainer", "UniqueEdge", "UniqueNode"]
    diff = V.coarse_diff((nodes, edge((0, 1, "Calls"))), (nodes.withColumn("name", F.upper("name")), edge((0, 2, "Calls"), (0, 3, "CfgEdge"))))
    assert {r.part for r in diff.where("changed").collect()} == {"nodes", "edge_hints", "cfg_graph"} and diff.count() == 10


def test_rollouts(spark):
    state = spark.createDataFrame([(3,)], "x long")
    step = lambda df: df.withColumn("x", F.col("x") - 2)
    found = V.rollout(state, step, F.sum("x"), 3, 10.0)
    assert [tuple(r) for r in found.orderBy("depth").collect()] == [(1, 1.0, 1.9), (2, 0.0, 1.0), (3, -3.0, pytest.approx(-1.7))]
    assert V.best_depth(found).first().depth == 1 and V.rollout(state, step, F.sum("x"), 0).count() == 0


def test_postconditions(spark):
    rows = spark.createDataFrame([(1, -2, None), (0, 5, None)], "a int, b int, c int")
    assert pairs(R.postconditions(rows, {"f": ["a", "b"], "g": ["c"]})) == [("f", "non_negative(a)", True, None), ("f", "non_negative(b)", False, -2.0), ("g", "non_negative(c)", True, None)]


def test_structured_edits(spark):
    rows = [(1, "ReplaceNode", "k", None, "fn f() {}", None), (2, "InsertAfter", "n", None, "k", None), (3, "DeleteNode", "d", None, None, None), (4, "MutateField", "k", "RenameIdent", "g", None), (5, "MutateField", "k", "Invent", "g", None), (6, "ReorderItems", None, None, None, ["b", "a"]), (7, "MoveSymbol", "k", None, "crate::m", None)]
    got = V.edit_changes(spark.createDataFrame(rows, "seq long, edit string, key string, mutation string, value string, items array<string>")).orderBy("seq", "part").collect()
    assert [(r.op, r.key, r.payload) for r in got] == [("UpdateNode", "k", "fn f() {}"), ("AddNode", "n", "InsertAfter:k"), ("RemoveNode", "d", None), ("UpdateNode", "k", "RenameIdent:g"), (None, "k", "Invent:g"), ("UpdateNode", "b", "position:0"), ("UpdateNode", "a", "position:1"), ("UpdateNode", "k", "module:crate::m")]


def test_framed_logs_are_read_by_stretches(spark, tmp_path):
    payloads = [bytes([i % 256]) * (i % 37) for i in range(500)]
    rows = spark.createDataFrame([(p,) for p in payloads], "payload binary").repartition(2)
    for header in (False, True):
        folder = str(tmp_path / str(header))
        assert framed.write_frames(rows, folder, header).agg(F.sum("records")).first()[0] == 500
        index = framed.index_frames(spark, folder, header, stretch=300)
        assert index.count() > 10 and framed.count_frames(spark, folder, header) == 500
        got = framed.read_frames(spark, folder, header, stretch=300)
        assert sorted(bytes(r.payload) for r in got.collect()) == sorted(payloads) and got.where("not ok").isEmpty()
        assert got.select("path", "seq").distinct().count() == 500 and got.agg(F.max("seq")).first()[0] < 500
    with pytest.raises(Exception, match="no log of version"):
        framed.read_frames(spark, str(tmp_path / "False"), header=True).count()


def test_locks_of_a_thread_with_most_rows(spark):
    import random

    rng, rows, held, want = random.Random(4), [], {}, {}
    for seq in range(0, 3000, 3):
        thread, action = rng.choice("aaab"), rng.choice(["acquire", "release", "access", "access"])
        target = rng.choice("xyz") if action != "access" else "o"
        rows.append((seq, thread, action, target))
        own = held.setdefault(thread, set())
        if action == "access":
            want[seq] = sorted(own)
        else:
            (own.add if action == "acquire" else own.discard)(target)
    trace = spark.createDataFrame(rows, "seq long, thread string, action string, target string")
    for stretch in (1, 64, 10_000):
        assert {r.seq: r.held for r in A.held_locks(trace, stretch).collect()} == want
    assert A.held_locks(trace.limit(0)).count() == 0

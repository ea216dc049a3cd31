"""Append-only change logs: replay, diff, admission, compaction and verification (OP-M*, OP-Y17, OP-Y18)."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.relational import first_wins, latest_wins
from graphloom.store import materialize


def replay(log: DataFrame, upto: int | None = None, mode: str = "last") -> DataFrame:
    """(key, payload, seq) after the log's changes (seq, op, key, payload) with seq below upto (OP-M1, OP-M5, OP-U5).

    mode last: a key's last change counts, and a RemoveNode takes it away. mode first: the first insertion
    stays and later ones are repeats. One aggregation that starts before the shuffle.
    """
    log = log.select("key", "seq", "op", "payload")
    if upto is not None:
        log = log.where(F.col("seq") < upto)
    if mode == "first":
        return first_wins(log.where("op != 'RemoveNode'"), ["key"], "seq").select("key", "payload", "seq")
    if mode != "last":
        raise ValueError("mode is first or last")
    return latest_wins(log, ["key"], "seq").where("op != 'RemoveNode'").select("key", "payload", "seq")


def replay_edges(edge_log: DataFrame, node_log: DataFrame) -> DataFrame:
    """(src, dst, kind) that stand after changes (seq, op, src, dst, kind) and removals of their ends (OP-M1).

    An edge stands if its last change adds it and neither end was removed after that.
    """
    last = latest_wins(edge_log, ["src", "dst", "kind"], "seq").where("op = 'AddEdge'")
    gone = node_log.where("op = 'RemoveNode'").groupBy("key").agg(F.max("seq").alias("gone"))
    for end in ("src", "dst"):
        last = last.join(gone.select(F.col("key").alias(end), F.col("gone").alias(f"g_{end}")), end, "left")
    return last.where("coalesce(g_src < seq, true) and coalesce(g_dst < seq, true)").select("src", "dst", "kind")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, key, old, new) between two states (key, payload) (OP-M2)."""
    a, b = before.select("key", F.col("payload").alias("old")), after.select("key", F.col("payload").alias("new"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), "key", "full_outer").where("__a is null or __b is null or not (old <=> new)")
    return both.select(change.alias("change"), "key", "old", "new")


def apply_changes(before: DataFrame, diff: DataFrame) -> DataFrame:
    """The state that changes lead to: apply_changes(a, changes(a, b)) is b (OP-M2)."""
    kept = before.select("key", "payload").join(diff.select("key"), "key", "left_anti")
    return kept.unionByName(diff.where("change != 'removed'").select("key", F.col("new").alias("payload")))


def merge(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, payload, conflict) of a three-way merge: a side that changed a key wins; both, differently, is a conflict."""
    j = base.select("key", F.struct("payload").alias("b")).join(left.select("key", F.struct("payload").alias("l")), "key", "full_outer").join(right.select("key", F.struct("payload").alias("r")), "key", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    pick = F.when(same("l", "r"), F.col("l")).when(same("l", "b"), F.col("r")).when(same("r", "b"), F.col("l")).otherwise(F.col("l"))
    conflict = ~same("l", "r") & ~same("l", "b") & ~same("r", "b")
    return j.select("key", pick.alias("p"), conflict.alias("conflict")).where("p is not null or conflict").select("key", F.col("p.payload").alias("payload"), "conflict")


def admitted(requests: DataFrame, judgments: DataFrame, epoch: int) -> DataFrame:
    """Requests (seq, judgment, epoch, nonce) with their decision (OP-M7).

    In this order: unknown or unapproved judgment; epoch before the current one; a nonce that an earlier request of
    the judgment used.
    """
    known = judgments.where("approved").select("judgment", F.lit(True).alias("ok")).distinct()
    first = requests.groupBy("judgment", "nonce").agg(F.min("seq").alias("first"))
    rows = requests.join(known, "judgment", "left").join(first, ["judgment", "nonce"])
    decision = F.when(F.col("ok").isNull(), "rejected").when(F.col("epoch") < epoch, "stale").when(F.col("seq") > F.col("first"), "replayed").otherwise("admitted")
    return rows.select("seq", "judgment", "epoch", "nonce", decision.alias("decision"))


def compact(log: DataFrame, upto: int) -> DataFrame:
    """A log with the same replay: the state at upto as insertions, then the rest (OP-M9)."""
    state = replay(log, upto).select("seq", F.lit("AddNode").alias("op"), "key", "payload")
    return state.unionByName(log.where(F.col("seq") >= upto).select("seq", "op", "key", "payload"))


def running_hashes(log: DataFrame, by: str, order: str, *parts: str) -> DataFrame:
    """Each entry with the hash of its chain's entries so far (OP-Y18).

    hash(n) covers hash(n - 1) and the entry, a fold over a chain; chains (by) are as many as tasks want.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    chain = log.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("c"))
    start = F.struct(F.lit("").alias("h"), F.array().cast("array<struct<o:bigint,h:string>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        h = F.sha2(F.concat(s["h"], F.lit("|"), e["t"]).cast("binary"), 256)
        return F.struct(h.alias("h"), F.array_append(s["out"], F.struct(e["o"].alias("o"), h.alias("h"))).alias("out"))

    return chain.select(by, F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("e")).select(by, F.col("e.o").alias(order), F.col("e.h").alias("hash"))


def tampered(log: DataFrame, by: str, order: str, stored: str, *parts: str) -> DataFrame:
    """(by, order) of the first entry of each chain whose stored hash is not what its entries give (OP-Y18)."""
    good = running_hashes(log, by, order, *parts)
    bad = log.select(by, order, F.col(stored).alias("__s")).join(good, [by, order]).where("not (__s <=> hash)")
    return bad.groupBy(by).agg(F.min(order).alias(order))


def valid_prefix(log: DataFrame, by: str, order: str, ok: Column) -> DataFrame:
    """Entries before the first one of their file that is not intact (OP-S10)."""
    bad = log.where(~F.coalesce(ok, F.lit(False))).groupBy(by).agg(F.min(order).alias("__bad"))
    return log.join(bad, by, "left").where(F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")


def verify_application(applied: DataFrame, deltas: DataFrame, proofs: DataFrame, group: str = "run") -> DataFrame:
    """(seq, defect) of applied records (run, seq, order, delta): unknown delta, unproven delta, order not rising (OP-M13)."""
    unknown = applied.join(deltas.select(F.col("id").alias("delta")), "delta", "left_anti").select("seq", F.lit("unknown delta").alias("defect"))
    unproven = applied.join(deltas.select(F.col("id").alias("delta"), "proof"), "delta").join(proofs.select(F.col("id").alias("proof")), "proof", "left_anti").select("seq", F.lit("unproven").alias("defect"))
    w = Window.partitionBy(group).orderBy("seq")
    order = applied.withColumn("__b", F.lag("order").over(w)).where("order <= __b").select("seq", F.lit("order").alias("defect"))
    return unknown.unionByName(unproven).unionByName(order)


def moved(nodes: DataFrame, contains: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with new keys and contains edges with new parents, by moves (id, new_key, new_parent) (OP-M20)."""
    n = nodes.join(moves.select("id", "new_key"), "id", "left").withColumn("key", F.coalesce("new_key", "key")).drop("new_key")
    c = contains.join(moves.select(F.col("id").alias("dst"), "new_parent"), "dst", "left").select(F.coalesce("new_parent", "src").alias("src"), "dst")
    return n, c


def event_deltas(executions: DataFrame) -> DataFrame:
    """(id, execution, payload): a history delta for each event of an execution, in order (OP-M21)."""
    return executions.select("id", F.posexplode("events").alias("n", "payload")).select(F.concat_ws("/", F.col("id").cast("string"), F.col("n").cast("string")).alias("delta"), F.col("id").alias("execution"), "payload")


class VersionStore:
    """A change log in a folder: numbered versions of appended changes, snapshots and compare-and-append (OP-M6, OP-M8, OP-K1,
    OP-K2, OP-K3).

    A version is a folder of its own; a file named by its number holds the folder's name, and only one writer can create
    that file. What a writer that failed or came second left behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version, -1 for none."""
        if not self._fs.exists(self._file(f"{self.path}/versions")):
            return -1
        names = (s.getPath().getName() for s in self._fs.listStatus(self._file(f"{self.path}/versions")))
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def append(self, changes: DataFrame, expected: int | None = None) -> int:
        """Append changes as the next version; fail if the last one is not the expected one."""
        last = self.version()
        if expected is not None and expected != last:
            raise ValueError(f"version {last}, not {expected}")
        folder = f"{last + 1}-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.path}/log/{folder}")
        try:
            out = self._fs.create(self._file(f"{self.path}/versions/{last + 1}"), False)
        except Py4JJavaError as e:
            self._fs.delete(self._file(f"{self.path}/log/{folder}"), True)
            raise ValueError(f"version {last + 1} was written meanwhile") from e
        out.write(bytearray(folder.encode()))
        out.close()
        return last + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The log up to a version."""
        last = self.version() if version is None else version
        marks = self.spark.read.text([f"{self.path}/versions/{v}" for v in range(last + 1)])
        folders = sorted(r["value"] for r in marks.collect())  # a row for each version
        return self.spark.read.parquet(*[f"{self.path}/log/{f}" for f in folders])

    def snapshot(self, version: int | None = None) -> DataFrame:
        return replay(self.read(version))

    def checkpoint(self, name: str, state: DataFrame) -> DataFrame:
        """Write a state beside the log and read it back."""
        state.write.mode("overwrite").parquet(f"{self.path}/checkpoints/{name}")
        return self.restore(name)

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/checkpoints/{name}")


def rollout(state: DataFrame, step, reward: Column, depth: int, estimate: float | None = None, weight: float = 0.1) -> DataFrame:
    """(depth, reward, utility) for each depth from 1 on: the sum of the rewards of that many steps (OP-M18).

    step takes a state to the next; reward is an aggregate of the state that a step gives. A world model's estimate draws
    the utility towards it: the reward and `weight` of what the estimate has over it.
    """
    rows, at = [], state
    for d in range(1, depth + 1):
        at = materialize(step(at), "rollout")
        rows.append(at.agg(reward.cast("double").alias("step")).select(F.lit(d).alias("depth"), "step"))
    if not rows:
        return state.sparkSession.createDataFrame([], "depth int, reward double, utility double")
    so_far = F.sum("step").over(Window.orderBy("depth"))  # a row a step
    found = reduce(DataFrame.unionByName, rows).select("depth", so_far.alias("reward"))
    bonus = F.lit(0.0) if estimate is None else (F.lit(float(estimate)) - F.col("reward")) * weight
    return found.withColumn("utility", F.col("reward") + bonus)


def best_depth(rollouts: DataFrame) -> DataFrame:
    """The depth of the most utility, the least of equals (OP-M18)."""
    return rollouts.orderBy(F.desc("utility"), "depth").limit(1)


def verify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject) for what a snapshot of nodes (id, kind, name) and edges (src, dst, kind) must not have (OP-M3).

    Ids twice; edges twice; edges without an end; a node in two containers; containment, regions, constants and macros that
    go round. No row: the snapshot holds.
    """
    from graphloom.operators.graph import peel
    from graphloom.operators.rules import snapshot_violations

    out = [snapshot_violations(nodes, edges).select("rule", "subject")]
    homes = edges.where("kind = 'Contains'").groupBy("dst").agg(F.countDistinct("src").alias("n")).where("n > 1")
    out.append(homes.select(F.lit("OneContainer").alias("rule"), F.col("dst").cast("string").alias("subject")))
    for kind in ("Contains", "Outlives", "ConstDep", "Expands"):
        own = materialize(edges.where(F.col("kind") == kind).select("src", "dst"), "edges")
        if not own.isEmpty():
            ends = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            out.append(peel(ends, own).where("level is null").select(F.concat(F.lit("Acyclic"), F.lit(kind)).alias("rule"), F.col("id").cast("string").alias("subject")))
    return reduce(DataFrame.unionByName, out)


def coarse_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(part, before, after, changed) of two snapshots (nodes, edges): their nodes and edges by content, and the number of
    vertices of each of the eight graphs that edges belong to (OP-M4)."""
    from graphloom.operators.solvers import GRAPH_OF, route

    def measured(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
        content = lambda df, name: df.agg(F.count("*").alias(side), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias(f"h_{side}")).withColumn("part", F.lit(name))
        ends = route(edges).select("graph", F.explode(F.array("src", "dst")).alias("id")).groupBy(F.concat("graph", F.lit("_graph")).alias("part")).agg(F.countDistinct("id").alias(side))
        graphs = edges.sparkSession.createDataFrame([(f"{g}_graph",) for g in sorted(set(GRAPH_OF.values()))], "part string").join(ends, "part", "left").na.fill(0, [side])
        return content(nodes, "nodes").unionByName(content(edges, "edge_hints")).unionByName(graphs, allowMissingColumns=True)

    both = measured(*before, "before").join(measured(*after, "after"), "part")
    return both.select("part", "before", "after", ((F.col("before") != F.col("after")) | ~F.col("h_before").eqNullSafe(F.col("h_after"))).alias("changed"))


#: Structured edits of items and of their fields, and the change of the log that each is.
NODE_EDITS = {"ReplaceNode": "UpdateNode", "InsertBefore": "AddNode", "InsertAfter": "AddNode", "DeleteNode": "RemoveNode", "MutateField": "UpdateNode", "ReorderItems": "UpdateNode", "MoveSymbol": "UpdateNode"}
FIELD_EDITS = ("RenameIdent", "ChangeVisibility", "AddAttribute", "RemoveAttribute", "ReplaceSignature", "AddStructField", "RemoveStructField", "AddVariant", "RemoveVariant")


def edit_changes(edits: DataFrame) -> DataFrame:
    """Log rows (seq, part, op, key, payload) of structured edits (seq, edit, key, mutation, value, items) (OP-M25).

    An insertion's key is the new item's and its value the neighbour's; a mutation names the field; a new order is a row
    for each of its items, numbered by `part`. Edits or mutations of another name have a null op.
    """
    known = F.create_map(*[F.lit(x) for kv in NODE_EDITS.items() for x in kv])
    op = F.when((F.col("edit") == "MutateField") & ~F.coalesce(F.col("mutation").isin(*FIELD_EDITS), F.lit(False)), F.lit(None)).otherwise(known[F.col("edit")])
    payload = F.when(F.col("edit") == "MutateField", F.concat_ws(":", "mutation", "value")).when(F.col("edit") == "MoveSymbol", F.concat(F.lit("module:"), "value"))
    payload = payload.when(F.col("edit").isin("InsertBefore", "InsertAfter"), F.concat_ws(":", "edit", "value")).otherwise(F.col("value"))
    one = edits.where("edit != 'ReorderItems'").select("seq", F.lit(0).alias("part"), op.alias("op"), "key", payload.alias("payload"))
    order = edits.where("edit = 'ReorderItems'").select("seq", F.posexplode("items").alias("part", "key"))
    return one.unionByName(order.select("seq", "part", F.lit("UpdateNode").alias("op"), "key", F.concat(F.lit("position:"), F.col("part").cast("string")).alias("payload")))

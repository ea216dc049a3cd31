"""Structural changes of artifact collections: payloads folded into items, admission with a drift bound (OP-M10, OP-M12, OP-M11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.store import materialize

#: The payloads, the collection that each changes and what it does there.
PAYLOADS = {
    "AddModule": ("modules", "add"), "AddStruct": ("structs", "add"), "AddField": ("fields", "add"), "AddTrait": ("traits", "add"),
    "AddTraitFunction": ("trait_functions", "add"), "AddImpl": ("impls", "add"), "AddFunction": ("functions", "add"),
    "AddModuleEdge": ("module_edges", "add"), "AddCallEdge": ("call_edges", "add"), "AttachExecutionEvent": ("events", "add"),
    "UpdateFunctionAst": ("functions", "ast"), "AddEnum": ("enums", "add"), "AddEnumVariant": ("variants", "add"),
    "UpdateFunctionInputs": ("functions", "inputs"), "UpdateFunctionOutputs": ("functions", "outputs"),
    "UpdateStructVisibility": ("structs", "visibility"), "RemoveField": ("fields", "remove"), "RenameArtifact": ("", "rename"), "RecordReward": ("rewards", "add"),
}
#: Distance between the artifacts before and after that an admission may cause.
THETA = 0.5


def _routed(deltas: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for k, v in PAYLOADS.items() for x in (k, "/".join(v))]
    to = F.split(F.create_map(*pairs)[F.col("payload")], "/")
    return deltas.withColumn("collection", F.when(to[1] == "rename", F.col("parent")).otherwise(to[0])).withColumn("action", to[1])


def apply_payloads(items: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (collection, id, parent, props) after deltas (seq, payload, id, parent, value), and errors (seq, defect).

    An item of an item, such as a field, is an item with a parent. Errors, which change nothing: adding what is there; updating or
    removing what is not; adding to a parent that is not there yet; an unknown payload. An update sets the property that its payload
    names to the value, the last one counting. RenameArtifact (id: old, value: new, parent: collection) renames at the end, in items
    and in their children. Items' histories are windows of their own.
    """
    routed = _routed(deltas)
    unknown = routed.where("action is null").select("seq", F.lit("unknown payload").alias("defect"))
    base = items.select(F.lit(-1).cast("long").alias("seq"), "collection", "id", "parent", F.lit("add").alias("action"), F.lit(None).cast("string").alias("value"))
    rows = base.unionByName(routed.where("action is not null and action != 'rename'").select(F.col("seq").cast("long").alias("seq"), "collection", "id", "parent", "action", "value"))
    # A parent is of any collection; it is there from its first addition on.
    births = rows.where("action = 'add'").groupBy(F.col("id").alias("parent")).agg(F.min("seq").alias("__born"))
    rows = rows.join(births, "parent", "left").withColumn("__orphan", F.expr("action = 'add' and seq >= 0 and parent is not null and coalesce(__born >= seq, true)"))
    life = Window.partitionBy("collection", "id").orderBy("seq")
    turn = F.when(F.col("action").isin("add", "remove") & ~F.col("__orphan"), F.col("action"))
    before = F.last(turn, ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before)
    alive = F.coalesce(F.col("__before") == "add", F.lit(False))
    defect = F.when(F.col("__orphan"), "unknown parent").when((F.col("action") == "add") & alive, "duplicate").when((F.col("action") != "add") & ~alive, "unknown target")
    rows = materialize(rows.withColumn("defect", defect), "changes")
    good = rows.where("defect is null")
    last = good.where("action in ('add', 'remove')").groupBy("collection", "id").agg(F.max_by(F.struct("action", "parent", "seq"), "seq").alias("l")).where("l.action = 'add'")
    props = good.where("action not in ('add', 'remove')").groupBy("collection", "id", "action").agg(F.max_by(F.struct("value", "seq"), "seq").alias("p"))
    props = props.join(last.select("collection", "id", F.col("l.seq").alias("born")), ["collection", "id"]).where("p.seq > born")
    props = props.groupBy("collection", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "p.value")))).alias("new"))
    empty = F.expr("cast(map() as map<string,string>)")
    state = last.select("collection", "id", F.col("l.parent").alias("parent")).join(items.select("collection", "id", F.col("props").alias("old")), ["collection", "id"], "left").join(props, ["collection", "id"], "left")
    merged = F.map_concat(F.map_filter(F.coalesce("old", empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("new", empty)), k)), F.coalesce("new", empty))
    names = routed.where("action = 'rename'").groupBy("collection", "id").agg(F.max_by("value", "seq").alias("renamed"))
    state = state.select("collection", "id", "parent", merged.alias("props")).join(names, ["collection", "id"], "left")
    parents = names.groupBy(F.col("id").alias("parent")).agg(F.max("renamed").alias("__p"))
    state = state.join(parents, "parent", "left").select("collection", F.coalesce("renamed", "id").alias("id"), F.coalesce("__p", "parent").alias("parent"), "props")
    return state, unknown.unionByName(rows.where("defect is not null").select("seq", "defect"))


def drift(before: DataFrame, after: DataFrame) -> float:
    """One less the share of artifacts (collection, id) that both states have (OP-M11); zero for two empty ones."""
    keys = before.select("collection", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select("collection", "id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    both, any_ = keys.groupBy("collection", "id").agg(F.max("a").alias("a"), F.max("b").alias("b")).agg(F.sum(F.col("a") * F.col("b")), F.count("*")).first()
    return 1 - both / any_ if any_ else 0.0


def apply_admitted(items: DataFrame, admissions: DataFrame, judgments: DataFrame, deltas: DataFrame, theta: float = THETA) -> tuple[DataFrame, DataFrame, float]:
    """(items, applied, drift) after the deltas of admissions (id, judgment, delta_ids) whose judgment (id, decision) accepts (OP-M10).

    applied: (admission, delta, seq) in the order of admissions and their lists. Beyond theta, and where a delta is an
    error, nothing is applied: the items come back as they were, with no applied rows.
    """
    accepted = admissions.join(judgments.where("decision = 'Accept'").select(F.col("id").alias("judgment")), "judgment", "left_semi")
    listed = accepted.select(F.col("id").alias("admission"), F.posexplode("delta_ids").alias("pos", "delta"))
    applied = materialize(listed.withColumn("seq", F.row_number().over(Window.orderBy("admission", "pos")).cast("long") - 1), "applied")
    state, errors = apply_payloads(items, deltas.drop("seq").join(applied.select("delta", "seq"), "delta"))
    state = materialize(state, "items")
    moved = drift(items, state)
    if moved > theta or not errors.isEmpty():
        return items, applied.select("admission", "delta", "seq").limit(0), moved
    return state, applied.select("admission", "delta", "seq"), moved

"""Declarative validation rules over artifact tables; violations are rows (rule, subject, detail) (OP-R*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.graph import closure, peel, scc
from graphloom.operators.relational import KIND_SCOPES, STAGE_KINDS
from graphloom.plans.ordered import previous
from graphloom.store import materialize

Tables = Mapping[str, DataFrame]


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column | str) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


@dataclass(frozen=True)
class Unique:
    """Keys that occur more than once (OP-R1); null is a value."""

    rule: str
    table: str
    key: Sequence[str] = ("id",)

    def check(self, t: Tables) -> DataFrame:
        twice = t[self.table].groupBy(*self.key).count().where("count > 1")
        return _rows(twice, self.rule, F.concat_ws("/", *[F.col(k).cast("string") for k in self.key]), f"duplicate in {self.table}")


@dataclass(frozen=True)
class Refers:
    """Values of a column, or of a list in it, that the other table's key lacks. Nulls are no references unless required."""

    rule: str
    table: str
    column: str
    other: str
    key: str = "id"
    many: bool = False
    required: bool = False
    where: str = "true"

    def check(self, t: Tables) -> DataFrame:
        rows = t[self.table].where(self.where)
        rows = rows.select("id", (F.explode_outer if self.many else F.col)(self.column).alias("__v"))
        if not self.required:
            rows = rows.where("__v is not null")
        known = t[self.other].select(F.col(self.key).alias("__v"))
        return _rows(rows.join(known, "__v", "left_anti"), self.rule, F.col("id"), F.concat(F.lit(f"{self.column}: "), F.coalesce(F.col("__v").cast("string"), F.lit("missing"))))


@dataclass(frozen=True)
class Holds:
    """Rows for which a condition does not hold; null does not."""

    rule: str
    table: str
    test: str
    detail: str
    where: str = "true"

    def check(self, t: Tables) -> DataFrame:
        bad = t[self.table].where(self.where).where(~F.coalesce(F.expr(self.test), F.lit(False)))
        return _rows(bad, self.rule, F.col("id"), self.detail)


@dataclass(frozen=True)
class Paired:
    """Rows whose values of two columns, the second by reference, are no legal pair (OP-F10)."""

    rule: str
    table: str
    a: str
    b: str
    legal: Mapping[str, Sequence[str]]
    via: tuple[str, str, str] | None = None

    def check(self, t: Tables) -> DataFrame:
        rows = t[self.table]
        if self.via:
            column, other, value = self.via
            rows = rows.join(t[other].select(F.col("id").alias(column), F.col(value).alias(self.b)), column)
        pairs = F.array(*[F.lit(f"{k}/{v}") for k, vs in self.legal.items() for v in vs])
        here = F.concat_ws("/", self.a, self.b)
        return _rows(rows.where(~F.array_contains(pairs, here)), self.rule, F.col("id"), here)


@dataclass(frozen=True)
class SameOwner:
    """References to rows that another column's value does not match, as an impl and its struct must share a module."""

    rule: str
    table: str
    column: str
    other: str
    mine: str
    theirs: str

    def check(self, t: Tables) -> DataFrame:
        other = t[self.other].select(F.col("id").alias(self.column), F.col(self.theirs).alias("__theirs"))
        rows = t[self.table].join(other, self.column).where(~F.col(self.mine).eqNullSafe(F.col("__theirs")))
        return _rows(rows, self.rule, F.col("id"), F.concat(F.lit(f"{self.mine} differs from that of "), F.col(self.column).cast("string")))


@dataclass(frozen=True)
class NoSelf:
    """Edges from a node to itself."""

    rule: str
    table: str
    src: str
    dst: str

    def check(self, t: Tables) -> DataFrame:
        return _rows(t[self.table].where(F.col(self.src) == F.col(self.dst)), self.rule, F.col(self.src), "refers to itself")


@dataclass(frozen=True)
class Acyclic:
    """Nodes on or behind a cycle; self-loops are another rule's (OP-G7)."""

    rule: str
    table: str
    src: str
    dst: str

    def check(self, t: Tables) -> DataFrame:
        edges = t[self.table].select(F.col(self.src).alias("src"), F.col(self.dst).alias("dst")).where("src != dst and src is not null and dst is not null")
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return _rows(peel(nodes, edges).where("level is null"), self.rule, F.col("id"), "on or behind a cycle")


@dataclass(frozen=True)
class Permitted:
    """Calls between modules without a way of imports from the caller's to the callee's (OP-R3, OP-J17)."""

    rule: str
    calls: str
    functions: str
    imports: str

    def check(self, t: Tables) -> DataFrame:
        home = t[self.functions].select("id", "module")
        calls = t[self.calls].join(home.select(F.col("id").alias("caller"), F.col("module").alias("src")), "caller").join(home.select(F.col("id").alias("callee"), F.col("module").alias("dst")), "callee").where("src != dst")
        asked = calls.select(F.col("src").alias("id")).distinct()
        ways = closure(t[self.imports].select(F.col("from").alias("src"), F.col("to").alias("dst")), asked)
        return _rows(calls.join(ways, ["src", "dst"], "left_anti"), self.rule, F.col("id"), F.concat_ws(" -> ", "caller", "callee"))


@dataclass(frozen=True)
class Increasing:
    """Rows whose value is not above the one before (strict) or is below it, in an order (OP-W2, OP-W4)."""

    rule: str
    table: str
    order: str
    value: str
    by: str | None = None
    strict: bool = False
    epsilon: float = 0.0

    def check(self, t: Tables) -> DataFrame:
        if self.by:
            w = Window.partitionBy(self.by).orderBy(self.order).rowsBetween(Window.unboundedPreceding, -1)
            rows = t[self.table].withColumn("__before", F.last(self.value, ignorenulls=True).over(w))
        else:
            rows = previous(t[self.table], self.order, self.value, "__before")
        v = F.col(self.value)
        bad = (v <= F.col("__before")) if self.strict else (v < F.col("__before") - self.epsilon)
        return _rows(rows.where(bad), self.rule, F.col("id"), F.concat_ws(" after ", v.cast("string"), F.col("__before").cast("string")))


@dataclass(frozen=True)
class Exists:
    """A table must have a row that passes a test."""

    rule: str
    table: str
    test: str
    detail: str

    def check(self, t: Tables) -> DataFrame:
        none = t[self.table].agg(F.count_if(F.expr(self.test)).alias("n")).where("n = 0")
        return _rows(none, self.rule, F.lit(self.table), self.detail)


#: The kinds of node that a function's syntax tree may have.
AST_KINDS = (
    "block", "let", "if", "match", "while", "return", "call", "call_stmt", "lit", "bin", "cmp", "logical", "unary", "field", "index", "method",
    "struct_lit", "tuple", "array", "ref", "ref_expr", "range", "cast", "question", "for", "loop", "break", "continue", "assign", "compound_assign",
    "closure", "if_expr", "match_expr", "input",
)


@dataclass(frozen=True)
class KnownKinds:
    """Nodes of a JSON tree, at any depth, whose kind is none of those allowed; a row for each node (OP-R9)."""

    rule: str
    table: str
    column: str
    kinds: tuple = AST_KINDS

    def check(self, t: Tables) -> DataFrame:
        found = F.regexp_extract_all(F.col(self.column), F.lit('"kind"\\s*:\\s*"([^"\\\\]*)"'), F.lit(1))
        unknown = t[self.table].select("id", F.explode(found).alias("__kind")).where(~F.col("__kind").isin(*self.kinds))
        return _rows(unknown, self.rule, F.col("id"), F.concat(F.lit("unknown kind of node: "), "__kind"))


@dataclass(frozen=True)
class PublicCallee:
    """Calls of functions that are not public (OP-R3)."""

    rule: str = "CallGraphPublicApis"
    calls: str = "call_edges"
    functions: str = "functions"
    hidden: tuple = field(default=("public",))

    def check(self, t: Tables) -> DataFrame:
        hidden = t[self.functions].where(~F.col("visibility").isin(*self.hidden)).select(F.col("id").alias("callee"))
        return _rows(t[self.calls].join(hidden, "callee", "left_semi"), self.rule, F.col("id"), "callee is not public")


def validate(tables: Tables, rules: Sequence) -> DataFrame:
    """All violations, as rows; rules over tables that are not given are left out."""
    found = []
    for rule in rules:
        needs = [v for n in ("table", "other", "calls", "functions", "imports") if isinstance(v := getattr(rule, n, None), str)]
        if getattr(rule, "via", None):
            needs.append(rule.via[1])
        if all(n in tables for n in needs):
            found.append(rule.check(tables))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "rule string, subject string, detail string")
    return reduce(DataFrame.unionByName, found)


_COLLECTIONS = ("modules", "structs", "enums", "traits", "impls", "functions", "call_edges", "tick_graphs", "ticks", "epochs", "plans", "executions", "admissions", "applied", "deltas", "proofs", "judgments", "predicates", "learning", "proposals", "gpu_functions", "loop_policies", "goal_mutations", "rewards")

#: The rules of a program's artifact tables, by the names they are reported under.
STANDARD_RULES = [
    *(Unique("ExplicitArtifacts", c) for c in _COLLECTIONS),
    Refers("ModuleDag", "module_edges", "from", "modules", required=True),
    Refers("ModuleDag", "module_edges", "to", "modules", required=True),
    NoSelf("ModuleSelfImport", "module_edges", "from", "to"),
    Acyclic("ModuleDag", "module_edges", "from", "to"),
    Holds("ModuleDag", "module_edges", "not exists(imported_types, x -> trim(x) = '')", "empty import"),
    Refers("CallGraphPublicApis", "call_edges", "caller", "functions", required=True),
    Refers("CallGraphPublicApis", "call_edges", "callee", "functions", required=True),
    PublicCallee(),
    Permitted("CallGraphRespectsDag", "call_edges", "functions", "module_edges"),
    Acyclic("CallGraphAcyclic", "call_edges", "caller", "callee"),
    Refers("TickGraphEdgesDeclared", "tick_graph_nodes", "function", "functions", required=True),
    Refers("TickGraphEdgesDeclared", "tick_graph_edges", "from", "tick_graph_nodes", "function", required=True),
    Refers("TickGraphEdgesDeclared", "tick_graph_edges", "to", "tick_graph_nodes", "function", required=True),
    Acyclic("TickGraphAcyclic", "tick_graph_edges", "from", "to"),
    Refers("LoopContinuationJudgment", "loop_policies", "graph", "tick_graphs", required=True),
    Refers("LoopContinuationJudgment", "loop_policies", "continuation", "predicates", required=True),
    Refers("ImplBinding", "impls", "module", "modules", required=True),
    Refers("ImplBinding", "impls", "struct_id", "structs", required=True),
    Refers("ImplBinding", "impls", "trait_id", "traits", required=True),
    SameOwner("ImplBinding", "impls", "struct_id", "structs", "module", "module"),
    Unique("ImplBinding", "impls", ("struct_id", "trait_id")),
    Refers("ExecutionOnlyInImpl", "functions", "impl_id", "impls", required=True),
    Refers("ExecutionOnlyInImpl", "functions", "module", "modules", required=True),
    SameOwner("ImplBinding", "functions", "impl_id", "impls", "module", "module"),
    Holds("FunctionContracts", "functions", "total and deterministic and explicit_inputs and explicit_outputs", "contract flags"),
    Holds("FunctionContracts", "functions", "size(outputs) > 0", "no output"),
    Holds("EffectsAreDeltas", "functions", "effects_are_deltas", "effects outside deltas"),
    Refers("EffectsAreDeltas", "functions", "deltas", "deltas", many=True),
    Holds("EffectsAreDeltas", "functions", "size(deltas) = size(array_distinct(deltas))", "a delta twice"),
    KnownKinds("FunctionAst", "functions", "ast"),
    Refers("StructShape", "structs", "module", "modules", required=True),
    Holds("StructShape", "structs", "size(fields) = size(array_distinct(transform(fields, f -> f.name)))", "a field twice"),
    Refers("StructShape", "enums", "module", "modules", required=True),
    Holds("StructShape", "enums", "size(variants) > 0", "no variant"),
    Refers("TraitVerbs", "traits", "module", "modules", required=True),
    Holds("TraitVerbs", "traits", "size(functions) > 0", "no function"),
    Holds("TraitVerbs", "traits", "size(functions) = size(array_distinct(functions))", "a function twice"),
    Holds("DeltaAppendOnly", "deltas", "append_only", "not append-only"),
    Paired("DeltaPipeline", "deltas", "stage", "kind", STAGE_KINDS),
    Refers("DeltaProofs", "deltas", "proof", "proofs", required=True),
    Paired("ProofScope", "deltas", "kind", "scope", KIND_SCOPES, ("proof", "proofs", "scope")),
    Refers("EffectsAreDeltas", "deltas", "related_function", "functions"),
    Refers("AdmissionBridge", "admissions", "judgment", "judgments", required=True),
    Holds("AdmissionBridge", "admission_judgments", "decision = 'Accept'", "judgment does not accept"),
    Refers("AdmissionBridge", "applied", "admission", "admissions", required=True),
    Refers("AdmissionBridge", "applied", "delta", "deltas", required=True),
    Increasing("AdmissionBridge", "applied", "seq", "order", strict=True),
    Refers("TickEpochs", "epochs", "parent", "epochs"),
    Refers("TickEpochs", "epochs", "ticks", "ticks", many=True),
    NoSelf("TickEpochs", "epochs", "id", "parent"),
    Acyclic("TickEpochs", "epochs", "id", "parent"),
    Refers("TickRoot", "ticks", "graph", "tick_graphs", required=True),
    Refers("TickRoot", "ticks", "input_state", "deltas", many=True),
    Refers("TickRoot", "ticks", "output_deltas", "deltas", many=True),
    Refers("PlanArtifacts", "plans", "judgment", "judgments", required=True),
    Refers("PlanArtifacts", "plans", "steps", "functions", many=True),
    Refers("PlanArtifacts", "plans", "expected_deltas", "deltas", many=True),
    Holds("PlanArtifacts", "plan_judgments", "decision = 'Accept'", "judgment does not accept"),
    Refers("ExecutionBoundary", "executions", "tick", "ticks", required=True),
    Refers("ExecutionBoundary", "executions", "plan", "plans", required=True),
    Refers("ExecutionBoundary", "executions", "outcome_deltas", "deltas", many=True),
    # The two reports of falling rewards carry each other's names, as their users know them.
    Increasing("RewardCollapseDetected", "rewards", "seq", "reward"),
    Increasing("RewardMonotonicity", "rewards", "seq", "snapshot", epsilon=0.05),
    Refers("GpuLawfulMath", "gpu_functions", "function", "functions", required=True),
    Holds("GpuLawfulMath", "gpu_functions", "size(inputs) > 0 and size(outputs) > 0", "no port"),
    Holds("GpuLawfulMath", "gpu_functions", "not exists(inputs || outputs, x -> x = 0)", "no lane"),
    Holds("GpuLawfulMath", "gpu_functions", "pure and no_io and no_alloc and no_branch", "unlawful"),
    Holds("ProposalDeclarative", "proposals", "size(nodes) > 0 or size(edges) > 0", "empty proposal"),
    Refers("JudgmentDecisions", "judgments", "proposal", "proposals", required=True),
    Refers("JudgmentDecisions", "judgments", "predicate", "predicates", required=True),
    Refers("LearningDeclarations", "learning", "proposal", "proposals", required=True),
    Holds("LearningDeclarations", "learning", "size(new_rules) > 0", "no rule"),
    Refers("GoalMutationRequiresJudgment", "goal_mutations", "judgment", "judgments", required=True),
    Holds("GoalMutationInvariantMissing", "goal_mutations", "invariant is not null", "no invariant"),
    Holds("ProjectEnvelope", "project", "trim(name) != '' and trim(version) != ''", "name and version"),
    Unique("ExternalDependencies", "dependencies", ("name",)),
    Holds("VersionEvolution", "project", "compatible is null or size(compatible) = size(array_distinct(compatible))", "a version twice"),
    Exists("VersionEvolution", "migration_proofs", "scope = 'Law'", "no migration proof of law scope"),
]


#: The names of defect classes.
MISSING_EMIT, WRONG_VALUE, WRONG_DIRECTION = "MissingEmit", "WrongValue", "WrongDirection"
MISSING_CONTEXT, OVER_CONSTRAINT, CYCLE = "MissingContext", "ValidatorOverConstraint", "CycleDetected"


def _defect_class(rule: str, own: DataFrame, t: Tables) -> tuple[str, DataFrame | None]:
    """The class of a rule's violations, by what the tables hold; with a cycle's class, the cycles (id, component)."""
    subjects = own.select(F.col("subject").alias("__subject")).distinct()
    failing = lambda name: t[name].join(subjects, F.col("id").cast("string") == F.col("__subject"), "left_semi")
    if rule == "VersionEvolution":
        return OVER_CONSTRAINT, None
    if rule == "ExecutionOnlyInImpl" and "functions" in t and "impls" in t:
        lone = failing("functions").where(F.col("impl_id").cast("string").endswith(".standalone"))
        return (WRONG_VALUE if lone.join(t["impls"].select(F.col("id").alias("impl_id")), "impl_id", "left_anti").isEmpty() else MISSING_EMIT), None
    if rule == "ImplBinding" and "impls" in t:
        blank = failing("impls").where(F.col("trait_id").cast("string") == "")
        about_traits = own.where(F.col("detail").contains("trait"))
        return (WRONG_VALUE if blank.isEmpty() or about_traits.isEmpty() else OVER_CONSTRAINT), None
    if rule in ("CallGraphRespectsDag", "ModuleDag") and "module_edges" in t:
        edges = t["module_edges"].select(F.col("from").alias("src"), F.col("to").alias("dst"))
        if edges.isEmpty():
            return MISSING_EMIT, None
        nodes = t["modules"].select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        parts = scc(nodes, edges)
        cycles = parts.join(parts.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
        if not cycles.isEmpty():
            return CYCLE, cycles
        callers = failing("functions").select(F.col("module").alias("id")).distinct() if "functions" in t else nodes.limit(0)
        ends = callers.join(edges.select(F.col("dst").alias("id")), "id", "left_semi").join(edges.select(F.col("src").alias("id")), "id", "left_anti")
        return (MISSING_CONTEXT if ends.isEmpty() else WRONG_DIRECTION), None
    return WRONG_VALUE, None


def diagnose(violations: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(rule, n, class, example, cycle): clusters by rule with their defect class, most frequent first (OP-R26, OP-T6, OP-Y16).

    The class follows from the rule and the tables: a function whose standalone impl is not there, or module edges that are
    not, were never emitted; impls without a trait, and versions, are judged too strictly; rules over modules
    name the cycle of the least module, else callers' modules that only receive edges point the wrong way, and all
    others lack context; whatever else is wrong is a value. There are as many jobs as rules; only flags reach the driver.
    """
    found = materialize(violations, "violations")
    clusters = found.groupBy("rule").agg(F.count("*").alias("n"), F.min("subject").alias("example"))
    out = []
    for rule in sorted(r["rule"] for r in clusters.select("rule").collect()):  # of a list of rules, so few
        name, cycles = _defect_class(rule, found.where(F.col("rule") == rule), tables or {})
        one = clusters.where(F.col("rule") == rule).withColumn("class", F.lit(name))
        if cycles is None:
            out.append(one.withColumn("cycle", F.lit(None).cast("array<string>")))
        else:
            least = cycles.groupBy("component").agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("cycle"))
            least = least.agg(F.min_by("cycle", "component").alias("cycle")).withColumn("rule", F.lit(rule))
            out.append(one.join(least, "rule").select(*one.columns, "cycle"))
    none = clusters.limit(0).withColumn("class", F.lit("")).withColumn("cycle", F.lit(None).cast("array<string>"))
    return reduce(DataFrame.unionByName, out, none).orderBy(F.desc("n"), "rule")


def layout_violations(routes: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations of a layout: routes (node, file), files (file, module), nodes (node, module) (OP-R23).

    A node twice, an unknown file, a file of another module, a node without a route.
    """
    twice = routes.groupBy("node").count().where("count > 1")
    unknown = routes.join(files.select("file"), "file", "left_anti")
    wrong = routes.join(files.withColumnRenamed("module", "fm"), "file").join(nodes, "node").where("not (fm <=> module)")
    missing = nodes.join(routes.select("node"), "node", "left_anti")
    parts = [_rows(twice, "LayoutDuplicate", F.col("node"), "assigned twice"), _rows(unknown, "LayoutUnknownFile", F.col("node"), F.col("file")), _rows(wrong, "LayoutModule", F.col("node"), F.col("file")), _rows(missing, "LayoutMissing", F.col("node"), "no file")]
    return reduce(DataFrame.unionByName, parts)


def snapshot_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of a graph snapshot: keys twice, edges twice, edges without an end (OP-R24, OP-R25)."""
    known = nodes.select(F.col("id").alias("__id"))
    ends = edges.select(F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")).alias("e"), F.explode(F.array("src", "dst")).alias("__id"))
    parts = [
        _rows(nodes.groupBy("id").count().where("count > 1"), "UniqueNode", F.col("id"), "duplicate"),
        _rows(edges.groupBy("src", "dst", "kind").count().where("count > 1"), "UniqueEdge", F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")), F.col("kind")),
        _rows(ends.join(known, "__id", "left_anti"), "Endpoint", F.col("e"), F.col("__id")),
    ]
    return reduce(DataFrame.unionByName, parts)

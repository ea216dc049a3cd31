"""Text and record extraction (OP-X12 to OP-X21, OP-M22, OP-M28, OP-Y6 to OP-Y8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a patch names what it does to a file.
PATCH_OPS = (("*** Add File: ", "add"), ("*** Update File: ", "update"), ("*** Delete File: ", "delete"))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def code_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns but text, with (block, language, content) for each fenced block (OP-X12).

    One fold over a text's lines: a fence opens a block, the next closes it; a fence with a language right after an
    opening one names the language instead; an empty block is none; a block that never closes counts if it has a line.
    """
    block = "struct(cast(null as string) as language, cast(null as string) as content)"
    start = F.expr(f"struct(false as open, cast(null as string) as lang, cast(array() as array<string>) as body, filter(array({block}), x -> false) as done)")

    def step(s: Column, line: Column) -> Column:
        fence = line.startswith("```")
        lang = F.nullif(F.trim(F.regexp_replace(line, "^`+", "")), F.lit(""))
        none = F.array().cast("array<string>")
        made = F.struct(s["lang"].alias("language"), F.array_join(s["body"], "\n").alias("content"))
        make = lambda o, g, b, d: F.struct(o.alias("open"), g.alias("lang"), b.alias("body"), d.alias("done"))
        relabel = (F.size(s["body"]) == 0) & (F.trim(line) != "```")
        closed = make(F.lit(False), F.lit(None).cast("string"), none, F.when(F.array_join(s["body"], "\n") != "", F.array_append(s["done"], made)).otherwise(s["done"]))
        return (
            F.when(fence & ~s["open"], make(F.lit(True), lang, none, s["done"]))
            .when(fence & relabel, make(F.lit(True), F.coalesce(lang, s["lang"]), s["body"], s["done"]))
            .when(fence, closed)
            .when(s["open"], make(s["open"], s["lang"], F.array_append(s["body"], line), s["done"]))
            .otherwise(s)
        )

    def finish(s: Column) -> Column:
        last = F.struct(s["lang"].alias("language"), F.array_join(s["body"], "\n").alias("content"))
        return F.when(s["open"] & (F.size(s["body"]) > 0), F.array_append(s["done"], last)).otherwise(s["done"])

    found = df.withColumn("__b", F.aggregate(lines(F.coalesce(F.col(text), F.lit(""))), start, step, finish)).drop(text)
    return found.select("*", F.posexplode("__b").alias("block", "__x")).select(*[c for c in found.columns if c != "__b"], "block", "__x.language", "__x.content")


def classify_block(language: Column, content: Column) -> Column:
    """A block's type by its language, else by how it begins (OP-X13)."""
    lang, body = F.lower(F.coalesce(language, F.lit(""))), F.ltrim(content)
    return (
        F.when(lang.contains("diff") | lang.contains("patch"), "patch")
        .when(lang.isin("sh", "bash") | lang.contains("shell"), "shell")
        .when(lang == "plan", "plan")
        .when(lang.isin("rs", "rust"), "rust")
        .when(lang.isin("py", "python"), "python")
        .when(lang.isin("jl", "julia"), "julia")
        .when(lang == "json", "json")
        .when(content.startswith("*** Begin Patch"), "patch")
        .when(content.startswith("#!"), "shell")
        .when(body.startswith("{") | body.startswith("["), "json")
        .otherwise("other")
    )


def patch_target(content: Column) -> Column:
    """The operation and path of the first line that names them, else update of PATCH (OP-X14)."""
    named = F.get(F.filter(lines(content), lambda x: x.rlike(r"^\*\*\* (Add|Update|Delete) File: ")), 0)
    op = F.lower(F.regexp_extract(named, r"^\*\*\* (\w+) File: ", 1))
    path = F.trim(F.regexp_replace(named, r"^\*\*\* \w+ File: ", ""))
    return F.struct(F.coalesce(op, F.lit("update")).alias("op"), F.coalesce(path, F.lit("PATCH")).alias("path"))


def is_structured_patch(text: Column) -> Column:
    return text.contains("*** Begin Patch") & text.contains("*** End Patch")


def gate_patches(df: DataFrame, text: str) -> DataFrame:
    """df with a decision for each patch (OP-M22)."""
    return df.withColumn("decision", F.when(is_structured_patch(F.col(text)), "accept").otherwise("reject"))


def patch_id(text: Column, *meta: Column) -> Column:
    """SHA-256 of a patch and its metadata (OP-X14)."""
    return F.sha2(F.concat(text, *[F.coalesce(m, F.lit("")) for m in meta]).cast("binary"), 256)


def plan_steps(content: Column) -> Column:
    """(status, step) of lines like `1. [pending] text`; lines with another status or without text are left out (OP-X15)."""
    def parsed(line: Column) -> Column:
        rest = F.trim(F.regexp_extract(line, r"^[^.]*\.(.*)$", 1))
        status = F.lower(F.trim(F.regexp_extract(rest, r"^[^\[]*\[([^\]]*)\]", 1)))
        return F.struct(F.when(status == "in progress", "in_progress").otherwise(status).alias("status"), F.trim(F.regexp_extract(rest, r"^[^\]]*\](.*)$", 1)).alias("step"))

    steps = F.transform(F.filter(F.transform(lines(content), lambda x: F.trim(x)), lambda x: (x != "") & ~F.upper(x).startswith("EXPLANATION:")), parsed)
    return F.filter(steps, lambda s: s["status"].isin("pending", "in_progress", "completed") & (s["step"] != ""))


def plan_explanation(content: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(content, r"(?im)^\s*explanation:(.*)$", 1)), F.lit(""))


def clean_shell(content: Column) -> Column:
    """Shell text without fences, empty lines and white space at ends of lines (OP-X16). It is only text: nothing runs it."""
    kept = F.filter(F.transform(lines(content), lambda x: F.rtrim(F.substring_index(x, "```", 1))), lambda x: x != "")
    return F.array_join(kept, "\n")


def shell_words(content: Column) -> Column:
    """The words of a single line; several lines are one argument of `sh -lc` (OP-X16)."""
    text = F.trim(clean_shell(content))
    return F.when(text == "", F.array().cast("array<string>")).when(text.contains("\n"), F.array(F.lit("sh"), F.lit("-lc"), text)).otherwise(F.split(text, r"\s+"))


def folded_text(ops: Column) -> Column:
    """The text that patches (structs of path, op, value, in order) leave at the first content part (OP-X17)."""
    here = F.filter(ops, lambda p: (p["path"] == "/message/content/parts/0") & p["op"].isin("append", "replace") & p["value"].isNotNull())
    return F.aggregate(here, F.lit(""), lambda text, p: F.when(p["op"] == "replace", p["value"]).otherwise(F.concat(text, p["value"])))


def frame_text(raw: Column) -> Column:
    """The text that a streaming frame adds, null for control frames (OP-X18)."""
    data = F.trim(F.regexp_replace(raw, "^data: ", ""))
    get = lambda p: F.get_json_object(data, p)
    items = F.from_json(F.get_json_object(data, "$.v"), "array<struct<o:string,p:string,v:string>>")
    appended = F.array_join(F.transform(F.filter(items, lambda i: (i["o"] == "append") & F.coalesce(i["p"], F.lit("")).contains("parts")), lambda i: F.coalesce(i["v"], F.lit(""))), "")
    bare = get("$.type").isNull() & get("$.c").isNull() & get("$.p").isNull()
    text = F.when(get("$.o") == "append", F.when(F.coalesce(get("$.p"), F.lit("")).contains("parts"), get("$.v"))).when(get("$.o") == "patch", F.nullif(appended, F.lit(""))).when(get("$.o").isNull() & bare, F.nullif(get("$.v"), F.lit("")))
    return F.when((data != "") & (data != "[DONE]"), text)


def frame_done(raw: Column) -> Column:
    """Whether a frame ends the message (OP-X18)."""
    data = F.trim(F.regexp_replace(raw, "^data: ", ""))
    return (data == "[DONE]") | F.coalesce(F.get_json_object(data, "$.type") == "message_stream_complete", F.lit(False))


def module_path(path: Column) -> Column:
    """`crate::a::b` for src/a/b.rs; mod.rs, lib.rs and main.rs stand for their folder (OP-X19)."""
    bare = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"(^|/)(mod|lib|main)\.rs$", "")
    bare = F.regexp_replace(bare, r"\.[^./]*$", "")
    return F.when(bare == "", "crate").otherwise(F.concat(F.lit("crate::"), F.replace(bare, F.lit("/"), F.lit("::"))))


def module_dir(name: Column) -> Column:
    return F.when(name.contains("::"), F.regexp_replace(name, "::(?:(?!::).)*$", "")).otherwise("")


def sanitized(name: Column) -> Column:
    """An identifier: everything but ASCII letters and digits becomes `_` (OP-X20)."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def is_word(name: Column) -> Column:
    return F.trim(name).rlike("^[A-Za-z][A-Za-z0-9_]*$")


def _unquoted(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
    double = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(value.rlike("(?s)^'.*'$") & (F.length(value) >= 2), inner).when(value.rlike('(?s)^".*"$') & (F.length(value) >= 2), double).otherwise(value)


def _assignments(text: Column, prefix: str) -> Column:
    own = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.startswith(prefix))
    pair = lambda x: F.struct(F.substring_index(F.regexp_replace(x, f"^{prefix}", ""), "=", 1).alias("k"), F.when(x.contains("="), _unquoted(F.trim(F.regexp_replace(x, "^[^=]*=", "")))).otherwise("").alias("v"))
    entries = F.transform(own, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def declares(text: Column) -> Column:
    """Exported variables of a shell dump, the last of a name (OP-X21)."""
    return _assignments(text, "declare -x ")


def aliases(text: Column) -> Column:
    return _assignments(text, "alias ")


def shopts(text: Column) -> Column:
    """Shell options, set or not (OP-X21)."""
    own = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.rlike("^shopt -[pu] "))
    return F.map_from_arrays(F.transform(own, lambda x: F.substring(x, F.lit(10), F.length(x))), F.transform(own, lambda x: x.startswith("shopt -p ")))


def source_symbols(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, kind, name, public) of items that begin a line of source text, by pattern (OP-M28, OP-Y7)."""
    item = r"^\s*(pub(?:\([^)]*\))?\s+)?(?:unsafe\s+|async\s+|const\s+)*(fn|struct|enum|trait|mod|type|const|static|macro_rules!)\s+([A-Za-z_][A-Za-z0-9_]*)"
    rows = df.select(F.col(path).alias("path"), F.posexplode(lines(F.col(text))).alias("i", "t")).where(F.col("t").rlike(item))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("t", item, 2).alias("kind"), F.regexp_extract("t", item, 3).alias("name"), (F.regexp_extract("t", item, 1) != "").alias("public"))


def source_dependencies(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, dep): what `use` and `mod` lines name; `super` is left out (OP-Y6)."""
    uses = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:crate::)?([A-Za-z_][A-Za-z0-9_:]*)"), 1)
    mods = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*;"), 1)
    deps = df.select(F.col(path).alias("path"), F.explode(F.concat(uses, mods)).alias("dep")).select("path", F.regexp_replace("dep", "::$", "").alias("dep"))
    return deps.where(~F.col("dep").startswith("super") & (F.col("dep") != "self")).distinct()


def symbol_uses(files: DataFrame, symbols: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, nth, name): identifiers of source text that are among the symbols (name), with their place among the
    identifiers of their line (OP-Y7). Symbols are looked up by a join, so neither side needs to fit a task."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(lines(F.col(text))).alias("i", "t"))
    words = rows.select("path", (F.col("i") + 1).alias("line"), F.posexplode(F.regexp_extract_all("t", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("nth", "name"))
    return words.join(symbols.select("name").distinct(), "name", "left_semi").select("path", "line", (F.col("nth") + 1).alias("nth"), "name")


def proposal(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, a, b, pos) of a plan language: `module a imports b, c`, `goal g: x -> y -> z` (OP-Y8).

    Modules, imports as edges, goals, and a goal's steps as edges in order; each once.
    """
    rows = df.select(F.posexplode(F.transform(lines(F.col(text)), lambda x: F.trim(x))).alias("pos", "t"))
    mod, goal = r"^module\s+(\w+)(?:\s+imports\s+(.*))?$", r"^goal\s+(\w+)\s*:\s*(.*)$"
    modules = rows.where(F.col("t").rlike(mod)).select("pos", F.regexp_extract("t", mod, 1).alias("a"), F.regexp_extract("t", mod, 2).alias("rest"))
    goals = rows.where(F.col("t").rlike(goal)).select("pos", F.regexp_extract("t", goal, 1).alias("a"), F.split(F.regexp_extract("t", goal, 2), r"\s*->\s*").alias("steps"))
    none = F.lit(None).cast("string")
    out = modules.select(F.lit("module").alias("kind"), "a", none.alias("b"), "pos")
    out = out.unionByName(modules.select(F.lit("import").alias("kind"), "a", F.explode(F.split("rest", r"[\s,]+")).alias("b"), "pos").where("b != ''"))
    out = out.unionByName(goals.select(F.lit("goal").alias("kind"), "a", none.alias("b"), "pos"))
    steps = goals.select("pos", F.explode(F.expr("transform(sequence(1, greatest(size(steps) - 1, 1)), i -> struct(steps[i - 1] as a, get(steps, i) as b))")).alias("s"))
    out = out.unionByName(steps.select(F.lit("step").alias("kind"), F.trim("s.a").alias("a"), F.trim("s.b").alias("b"), "pos").where("b is not null"))
    return out.groupBy("kind", "a", "b").agg(F.min("pos").alias("pos"))


def replace_word(text: Column, old: str, new: str) -> Column:
    """One identifier renamed where it stands alone (OP-M26)."""
    return F.regexp_replace(text, rf"\b{old}\b", new)


def rendered(kind: Column, name: Column, visibility: Column, type_: Column, value: Column, parts: Column) -> Column:
    """Source text of an item by its kind (OP-M27): constants and statics with type and value, aliases with their type, uses with an
    alias for a value, modules as declarations, structs and enums with their parts, functions by their signature and body.

    visibility: `pub ` or nothing; parts: lines of a body, a field or variant each. Kinds of another name give null.
    """
    head = lambda word: F.concat(visibility, F.lit(f"{word} "), name)
    block = lambda end: F.concat(F.lit(" {\n"), F.array_join(F.transform(parts, lambda x: F.concat(F.lit("    "), x, F.lit(end))), "\n"), F.when(F.size(parts) > 0, "\n").otherwise(""), F.lit("}"))
    typed = F.concat(F.lit(": "), type_, F.lit(" = "), value, F.lit(";"))
    alias = F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(" as "), value))
    return (
        F.when(kind == "Const", F.concat(head("const"), typed))
        .when(kind == "Static", F.concat(head("static"), typed))
        .when(kind == "TypeAlias", F.concat(head("type"), F.lit(" = "), type_, F.lit(";")))
        .when(kind == "Use", F.concat(F.lit("use "), name, alias, F.lit(";")))
        .when(kind == "Module", F.concat(F.lit("pub mod "), name, F.lit(";")))
        .when(kind == "Struct", F.concat(head("struct"), block(",")))
        .when(kind == "Enum", F.concat(head("enum"), block(",")))
        .when(kind == "Function", F.concat(head("fn"), type_, F.when(parts.isNull(), F.lit(";")).otherwise(block(""))))
    )


def repo_map(symbols: DataFrame) -> DataFrame:
    """(path, text, tokens) of `source_symbols`: a file's items in the order of their lines under its path, and a token for each
    four bytes (OP-M28)."""
    line = F.concat(F.lit("  "), F.when(F.col("public"), "pub ").otherwise(""), "kind", F.lit(" "), "name")
    files = symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", line.alias("t")))).alias("l"))  # a file's items
    text = F.concat("path", F.lit(":\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n"))
    return files.select("path", text.alias("text"), F.floor(F.octet_length(text) / 4).alias("tokens"))

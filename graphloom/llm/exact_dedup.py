"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialize, text_bytes

#: Bytes of a block.
BLOCK = 4096


def _named(rows: DataFrame, *content: str) -> DataFrame:
    """Rows (content..., __name) of distinct contents, named by their places, from 0, in the sorted order of all of them.

    The order is dealt into ranges; a place is that in its range and the rows of the ranges before, of which there are as
    many as partitions. So names depend on the contents alone, not on how many partitions there are.
    """
    placed = rows.orderBy(*content).select(*content, F.monotonically_increasing_id().alias("__at"))
    placed = materialize(placed.select(*content, F.shiftright("__at", 33).alias("__part"), (F.col("__at") % (1 << 33)).alias("__at")), "places")
    sizes = materialize(placed.groupBy("__part").agg(F.count("*").alias("__n")), "sizes")
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return materialize(placed.join(F.broadcast(before), "__part").select(*content, (F.col("__before") + F.col("__at")).alias("__name")), "names")


def _block_names(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Names of distinct blocks under a two-word key that is checked to tell all of them apart.

    Blocks are sorted by the key, which keeps their contents out of the sort and of the join back to documents. Should
    two blocks share it, another salt is taken.
    """
    for salt in range(1, 100, 2):
        keys = materialize(blocks.distinct().select(*_keys(salt)), "keys")
        if keys.groupBy("__k1", "__k2").count().where("count > 1").isEmpty():
            return _named(keys, "__k1", "__k2"), salt
    raise RuntimeError("no key tells the blocks apart")


def _keys(salt: int) -> list:
    return [F.xxhash64(F.lit(salt + j), F.col("__block")).alias(f"__k{j + 1}") for j in range(2)]


def block_identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Return (doc_id, text_sha256, n_blocks, identity, copies): two texts are equal iff n_blocks and identity are.

    The text's bytes are cut into fixed-size blocks; distinct blocks are sorted and numbered; adjacent names are paired
    and the distinct pairs numbered again until one name is left, after log2(blocks) rounds over the longer documents
    only. Null counts as empty, which is one block. Rows that repeat an id and its text are one row here, with their
    number as copies; other columns are ignored; an empty table gives an empty result.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("__bytes"))
    whole = whole.withColumn("__n", F.greatest(F.lit(1), F.ceil(F.octet_length("__bytes") / block)).cast("int"))
    cut = whole.select("doc_id", F.sha2("__bytes", 256).alias("text_sha256"), "__n", "__bytes", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i"))
    cut = cut.withColumn("__block", F.expr(f"substring(__bytes, __i * {block} + 1, {block})"))
    names, salt = _block_names(whole.select("__bytes", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i")).select(F.expr(f"substring(__bytes, __i * {block} + 1, {block})").alias("__block")))
    level = cut.select("doc_id", "text_sha256", "__n", "__i", *_keys(salt)).join(names, ["__k1", "__k2"]).select("doc_id", "text_sha256", "__n", "__i", "__name", F.lit(1).cast("long").alias("__copies"))
    level = materialize(level.withColumn("__left", F.col("__n")), "level")
    done = level.where("__left = 1")
    most = level.agg(F.max("__left")).first()[0] or 1
    while most > 1:
        pairs = level.where("__left > 1").groupBy("doc_id", "text_sha256", "__n", "__left", F.expr("__i div 2").cast("int").alias("__i")).agg(F.max(F.expr("if(__i % 2 = 0, __name, null)")).alias("__a"), F.coalesce(F.max(F.expr("if(__i % 2 = 1, __name, null)")), F.lit(-1)).alias("__b"), F.sum(F.expr("if(__i % 2 = 0, __copies, 0)")).alias("__copies"))
        pairs = materialize(pairs, "pairs")
        named = _named(pairs.select("__a", "__b").distinct(), "__a", "__b")
        level = pairs.join(named, ["__a", "__b"]).select("doc_id", "text_sha256", "__n", "__i", "__name", "__copies", F.expr("cast((__left + 1) div 2 as int)").alias("__left"))
        most = (most + 1) // 2
        done = done.unionByName(level.where("__left = 1"))
    return done.groupBy("doc_id", "text_sha256", F.col("__n").alias("n_blocks"), F.col("__name").alias("identity")).agg(F.sum("__copies").alias("copies"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the largest id stays.

    Rows that repeat an id and its text count each and share their fate. Ids may be null (such a row stays only if its
    group has no other id). Null texts are empty; other columns are ignored; an empty table gives an empty result.
    """
    named = materialize(block_identities(docs, doc_id, text, block), "identities")
    # A table, so that both sides of the join come by a plain exchange, which a hot group's rows can be split on.
    groups = materialize(named.groupBy("n_blocks", "identity").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    every = named.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.join(groups, ["n_blocks", "identity"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which `exact_dedup` keeps the document; a repeated row stays once."""
    kept = exact_dedup(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.withColumn("__sha", F.sha2(text_bytes(text), 256))
    joined = rows.join(kept, rows[doc_id].eqNullSafe(kept["__id"]) & (rows["__sha"] == kept["__sha"]), "left_semi")
    return joined.dropDuplicates([doc_id, "__sha"]).select(*docs.columns)

"""Mixing sources to target weights by iterative proportional fitting, in built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import WORD, materialize, whole_text

#: Relative error of a margin at which fitting ends, sweeps over all margins between two looks at it, and sweeps after which
#: margins that no cells can meet together are given up; the power of its share that a value is to have.
TOLERANCE, WRITTEN, MOST, TEMPER = 1e-10, 4, 400, 0.5
#: Share of all tokens that the mix is to have, and steps to the scale of probabilities that gives it.
KEEP, STEPS = 0.7, 12
#: Cells that are broadcast to the documents, at some 100 bytes each.
FEW = 100_000


#: Topics in the order in which a text is tried for them: the characters that tell it, and the hundredths of a text that are to
#: be such characters.
TOPICS = (("numbers", "0123456789", 12), ("tables", "|\t", 3), ("code", "{}();=<>", 5), ("contacts", "@+/", 1), ("lists", "\n*•", 3), ("dialogue", "?!\"«»“”", 2))
#: What most of a text is, and tells no topic.
PLAIN = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def topic_of(text: str = "text") -> Column:
    """A coarse topic: the first of TOPICS whose characters make up their share of a text, else prose; null counts as empty.

    One pass takes the plain letters out; the topics' characters are counted in the little that is left.
    """
    t = whole_text(text)
    signs = F.translate(t, PLAIN, "")
    topic = F
    for name, chars, share in TOPICS:
        topic = topic.when((F.length(signs) - F.length(F.translate(signs, chars, ""))) * 100 > F.length(t) * share, name)
    return topic.otherwise("prose")


def n_words(text: str = "text") -> Column:
    """Words, and one for the document's end."""
    return (F.regexp_count(whole_text(text), F.lit(WORD)) + 1).cast("long")


def uniform(doc_id: str) -> Column:
    """A number from 0 to 1 that the id fixes."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """cells (dims..., tokens) with raked, whose sums by each dim's value are that value's target share of all tokens.

    Targets come for each dim as shares by value; a dim without takes its values' shares of the tokens to the power of
    `temper`. Values without a target get none; shares are scaled to add up to one over the values there are. Sweeps go
    on until every margin is within `tolerance` of its target; `error` is the largest distance that is left, which
    stays larger after `most` sweeps only where cells are missing that the targets call for together.
    """
    few, wanted = cells.limit(FEW + 1).count() <= FEW, cells
    for d in dims:
        if targets and d in targets:
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], f"{d} string, __t_{d} double")
            margin = cells.select(d).distinct().join(F.broadcast(given), d, "left").na.fill(0.0, [f"__t_{d}"])
        else:
            margin = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(temper))).alias(f"__t_{d}"))
        margin = materialize(margin, "margin")
        total = margin.agg(F.sum(f"__t_{d}")).first()[0] or 1.0
        wanted = wanted.join(margin.withColumn(f"__t_{d}", F.col(f"__t_{d}") / F.lit(total)), d)
    w, left = wanted.withColumn("raked", F.col("tokens").cast("double")), 1.0
    for _ in range(0, most, WRITTEN):
        w = w.coalesce(1) if few else w  # few cells are swept in one place, without an exchange
        for d in dims * WRITTEN:
            held = F.sum("raked").over(Window.partitionBy(d))
            w = w.withColumn("raked", F.when(held > 0, F.col("raked") * F.col(f"__t_{d}") / held).otherwise(0.0))
        w = materialize(w, "cells")
        off = [w.groupBy(d).agg(F.sum("raked").alias("s"), F.first(f"__t_{d}").alias("t")).agg(F.max(F.when(F.col("t") > 0, F.abs(F.col("s") / F.col("t") - 1)))).first()[0] for d in dims]
        left = max((x or 0.0 for x in off), default=0.0)
        if left <= tolerance:
            break
    return w.select(*dims, "tokens", "raked", F.lit(left).alias("error"))


def _scale(cells: DataFrame, keep: float, total: float) -> float:
    """The c for which min(1, c weight) of each cell's tokens are `keep` of all tokens.

    From below: what is left for the cells that are not taken whole sets c, which may fill more cells. The driver sees
    two sums a step.
    """
    cells, scale = materialize(cells, "cells"), keep
    for _ in range(STEPS):
        whole = F.col("weight") * F.lit(scale) >= 1
        full, rest = cells.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight") * F.col("tokens")))).first()
        now = (keep * total - (full or 0)) / rest if rest else scale
        if now <= scale:
            break
        scale = now
    return scale


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER, tolerance: float = TOLERANCE, keep: float = KEEP) -> DataFrame:
    """Return doc_id, source, lang, topic, n_tokens, weight, probability, kept, margins_met, one row per input row.

    weight: how much more of its cell's tokens the raked mix has than the corpus. probability: the weight, scaled so that the
    expected mix has `keep` of all tokens, one at most: a cell that would need its documents more than once is taken
    whole. kept: the id's own number is below it, at any size and in any order. Null sources and languages are the value ''; null texts are empty and
    count one token; repeated rows share their fate; an empty table gives an empty result; other columns are ignored.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), value(source).alias("source"), value(lang).alias("lang"), topic_of(text).alias("topic"), n_words(text).alias("n_tokens"))
    rows = materialize(rows, "rows")
    dims = ["source", "lang", "topic"]
    cells = materialize(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, dims, targets, temper, tolerance)
    total, n = raked.agg(F.sum("tokens"), F.count("*")).first()
    raked = raked.withColumn("weight", F.col("raked") * F.lit(float(total or 0)) / F.col("tokens"))
    scale = _scale(raked, keep, float(total or 0))
    rates = raked.select(*dims, "weight", "error", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("probability"))
    # Few cells go to every task; else the join splits a hot cell's rows.
    joined = rows.join(F.broadcast(rates) if n <= FEW else materialize(rates, "rates"), dims)
    return joined.select("doc_id", *dims, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), (uniform("doc_id") < F.col("probability")).alias("kept"), (F.col("error") <= F.lit(1e-6)).alias("margins_met"))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that `mix` keeps."""
    kept = mix(docs, doc_id, text, **how).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["__id"]), "left_semi")


def mix_sql(temper: float = TEMPER, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = 60) -> str:
    """DuckDB SQL for `mix` of documents."""
    dims = ("source", "lang", "topic")
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    topic = " ".join(f"WHEN (length(signs) - length(translate(signs, {quote(chars)}, ''))) * 100 > length(t) * {share} THEN '{name}'" for name, chars, share in TOPICS)
    ctes = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, translate(coalesce(text, ''), '{PLAIN}', '') AS signs,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS n_tokens FROM documents)""",
            f"rows AS (SELECT doc_id, source, lang, n_tokens, CASE {topic} ELSE 'prose' END AS topic FROM d)",
            "cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM rows GROUP BY ALL)"]
    for d in dims:
        if targets and d in targets:
            given = " ".join(f"WHEN {quote(k)} THEN {float(v)}" for k, v in targets[d].items())
            ctes.append(f"m_{d} AS (SELECT DISTINCT {d}, (CASE {d} {given} ELSE 0 END)::DOUBLE AS m FROM cells)")
        else:
            ctes.append(f"m_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {temper}) AS m FROM cells GROUP BY {d})")
        ctes.append(f"t_{d} AS (SELECT {d}, m / sum(m) OVER () AS t_{d} FROM m_{d})")
    swept = "w"
    for d in dims:
        swept = f"(SELECT * REPLACE (CASE WHEN sum(raked) OVER (PARTITION BY {d}) > 0 THEN raked * t_{d} / sum(raked) OVER (PARTITION BY {d}) ELSE 0 END AS raked) FROM {swept})"
    ctes.append(f"""w AS (SELECT 0 AS k, tokens::DOUBLE AS raked, * FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
            UNION ALL SELECT * REPLACE (k + 1 AS k) FROM {swept} WHERE k < {sweeps})""")
    ctes.append(f"rates AS (SELECT source, lang, topic, tokens, raked * (SELECT sum(tokens)::DOUBLE FROM cells) / tokens AS weight FROM w WHERE k = {sweeps})")
    ctes.append(f"c0 AS (SELECT {KEEP}::DOUBLE AS c)")
    for k in range(STEPS):
        whole = f"weight * (SELECT c FROM c{k}) >= 1"
        left = f"({KEEP} * sum(tokens)::DOUBLE - coalesce(sum(tokens) FILTER ({whole}), 0)) / nullif(sum(weight * tokens) FILTER (NOT ({whole})), 0)"
        ctes.append(f"c{k + 1} AS (SELECT greatest((SELECT c FROM c{k}), coalesce({left}, 0)) AS c FROM rates)")
    return f"""WITH RECURSIVE {', '.join(ctes)}
        SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, weight * (SELECT c FROM c{STEPS})), 6) AS probability,
               ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < least(1.0, weight * (SELECT c FROM c{STEPS})) AS kept, true AS margins_met
        FROM rows JOIN rates USING (source, lang, topic)"""

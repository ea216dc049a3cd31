"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, text_bytes

#: Labelled documents that the text model is fitted on, and hash buckets of byte trigrams.
SAMPLE, BUCKETS = 20_000, 1 << 16
#: Languages that the model tells apart: the most frequent labels of the sample.
LANGUAGES = 200
#: Trigrams whose evidence a text gives at most, as neighbours overlap and repeat: it has their mean.
EVIDENCE = 60
#: Rows that a host's prior is worth, and a domain's; count that each value of other evidence starts from.
KAPPA, ALPHA = 4.0, 0.5
#: No language: byte trigrams are as likely as any.
NONE = "und"
CHUNK = 1 << 20

_HIDDEN = re.compile(rb"<(script|style)\b", re.I)
_CLOSING = {name: re.compile(rb"</" + name + rb"\s*+>", re.I) for name in (b"script", b"style")}
#: A tag ends at the next bracket of either kind, so that brackets that open nothing cost one look each.
_TAG = re.compile(rb"<[^<>]*+>")
#: Words with a digit (numbers, keys, addresses) are in no language.
_NUMBER = re.compile(rb"(?<!\S)[^\s0-9]*+[0-9]\S*")


def _buckets(text: bytes) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text, A-Z lower-cased, with a space at either end."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets by class; the last class is NONE."""

    langs: tuple[str, ...]
    table: np.ndarray

    def evidence(self, text: bytes) -> np.ndarray:
        total, n, text = np.zeros(len(self.langs)), 0, _NUMBER.sub(b"", text)
        for k in range(0, max(1, len(text)), CHUNK):
            h = _buckets(text[k : k + CHUNK])
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total * (min(n, EVIDENCE) / n) if n else total


def strip_markup(html: bytes) -> bytes:
    """Text without tags, scripts and styles, in one pass; what is never closed stays."""
    parts, at, ends = [], 0, {}
    for m in _HIDDEN.finditer(html):
        name = m[1].lower()
        if m.start() < at or ends.get(name, 0) is None:
            continue
        if ends.get(name, -1) < m.end() and (close := _CLOSING[name].search(html, m.end())) is None:
            ends[name] = None  # nor does any later one end
            continue
        elif ends.get(name, -1) < m.end():
            ends[name] = close.end()
        parts += [html[at : m.start()], b" "]
        at = ends[name]
    return _TAG.sub(b" ", b"".join([*parts, html[at:]]))


def fit_text(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> TextModel:
    """Smoothed trigram frequencies by language from at most about `sample` labelled rows, whose ids hash lowest.

    Counts come to the driver by (language, bucket), at most BUCKETS for each of the `languages` most frequent labels.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.xxhash64(doc_id).alias("h"), F.col(lang).cast("string").alias("lang"), text_bytes(text).alias("text"))
    low = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, np.ndarray] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = by.setdefault(name, np.zeros(BUCKETS, np.int64))
                data = _NUMBER.sub(b"", t.as_py())
                for k in range(0, len(data), CHUNK):
                    counts += np.bincount(_buckets(data[k : k + CHUNK]), minlength=BUCKETS)
            for name, counts in by.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    chosen = rows.where(F.col("h") <= F.lit(low)).select("lang", "text")
    names = [r["lang"] for r in chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang").collect()]
    got = chosen.where(F.col("lang").isin(names)).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(set(got["lang"]))) if len(got) else ()
    table = np.full((BUCKETS, len(langs) + 1), -np.log(BUCKETS))
    for k, name in enumerate(langs):
        own = got[got["lang"] == name]
        counts = np.full(BUCKETS, 0.05)
        counts[own["bucket"].to_numpy()] += own["n"].to_numpy()
        table[:, k] = np.log(counts / counts.sum())
    return TextModel((*langs, NONE), table.astype(np.float32))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host, which hosts of one owner mostly share."""
    return F.substring_index(host, ".", -2)


def identify(rows: DataFrame, key: list[str], model: TextModel, text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, domain: str | None = None, markup: bool = False) -> DataFrame:
    """Return key columns, lang, probability, accepted, text_lang for each row.

    The score of a class is the log of P(text | class) P(declared | class) P(suffix | class) P(class | host). The last is
    a host's share of a class by what its other rows' texts say, drawn to its domain's share, and that to the share
    over all rows, by KAPPA rows each; the shares, and the frequencies of declared languages and suffixes by class,
    are sums over all rows by host, domain and so on. Evidence that is null or not given counts for
    nothing. A row is accepted if a language, not NONE, has at least half of the probability.
    Null texts are empty and decided by the rest; repeated rows count and are returned each; an empty table
    gives an empty result; other columns are ignored.
    """
    n = len(model.langs)
    ps = [f"p{k}" for k in range(n)]
    given = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}
    columns = [F.lower(F.col(c).cast("string")).alias(e) if c else F.lit(None).cast("string").alias(e) for e, c in given.items()]
    base = rows.select(F.struct(*key).alias("key"), text_bytes(text).alias("text"), *columns)
    # Arrow carries the key as it is.
    schema = base.drop("text").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(1))
            got = np.array([model.evidence(strip_markup(t) if markup else t) for t in texts]).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, 6)), *(pa.array(got[:, k]) for k in range(n))], ["key", *given, *(f"e{k}" for k in range(n))])

    fields = ", ".join(x.replace(":", " ", 1) for x in _split_fields(schema))
    read = base.mapInArrow(run, fields + "".join(f", e{k} double" for k in range(n)))
    top = F.greatest(*[F.col(f"e{k}") for k in range(n)]) if n > 1 else F.col("e0")
    read = read.withColumn("top", top)
    whole = sum((F.exp(F.col(f"e{k}") - F.col("top")) for k in range(1, n)), F.exp(F.col("e0") - F.col("top")))
    read = read.withColumn("whole", whole).select("key", *given, *[f"e{k}" for k in range(n)], *[(F.exp(F.col(f"e{k}") - F.col("top")) / F.col("whole")).alias(f"p{k}") for k in range(n)])
    seen = materialize(read, "evidence")
    sums = seen.agg(F.count("*"), *[F.sum(p) for p in ps]).first()
    total, by = sums[0], [(s or 0.0) for s in sums[1:]]
    share = [(s + 1.0) / (total + n) for s in by]
    scored = seen
    score = [F.col(f"e{k}") for k in range(n)]
    for e in ("declared", "suffix"):
        if given[e]:
            values = materialize(seen.where(F.col(e).isNotNull()).groupBy(F.col(e).alias(f"{e}_v")).agg(*[F.sum(p).alias(f"{e}_{p}") for p in ps]), e)
            kinds = values.count()
            scored = scored.join(values, F.col(e) == F.col(f"{e}_v"), "left")
            for k in range(n):
                score[k] = score[k] + F.coalesce(F.log((F.col(f"{e}_p{k}") + ALPHA) / F.lit(by[k] + ALPHA * (kinds + 1))), F.lit(0.0))
    prior = [F.lit(s) for s in share]
    for e in ("domain", "host"):
        if given[e]:
            values = materialize(seen.where(F.col(e).isNotNull()).groupBy(F.col(e).alias(f"{e}_v")).agg(F.count("*").alias(f"{e}_n"), *[F.sum(p).alias(f"{e}_{p}") for p in ps]), e)
            scored = scored.join(values, F.col(e) == F.col(f"{e}_v"), "left")
            # The row's own text counts in its likelihood, so not here again.
            prior = [F.when(F.col(f"{e}_n").isNull(), prior[k]).otherwise((F.greatest(F.col(f"{e}_p{k}") - F.col(f"p{k}"), F.lit(0.0)) + KAPPA * prior[k]) / (F.col(f"{e}_n") - 1 + KAPPA)) for k in range(n)]
    scored = scored.select("key", *[(score[k] + F.log(prior[k])).alias(f"s{k}") for k in range(n)], *ps)
    order = lambda c: F.array_max(F.array(*[F.struct(F.col(f"{c}{k}").alias("v"), F.lit(-k).alias("k")) for k in range(n)]))
    names = F.array(*[F.lit(x) for x in model.langs])
    scored = scored.withColumn("best", order("s")).withColumn("read", order("p"))
    odds = sum((F.exp(F.col(f"s{k}") - F.col("best.v")) for k in range(1, n)), F.exp(F.col("s0") - F.col("best.v")))
    scored = scored.withColumn("lang", names[-F.col("best.k")]).withColumn("probability", 1 / odds)
    return scored.select("key.*", "lang", F.round("probability", 6).alias("probability"), ((F.col("lang") != NONE) & (F.col("probability") >= 0.5)).alias("accepted"), names[-F.col("read.k")].alias("text_lang"))


def _split_fields(schema: str) -> list[str]:
    """Top-level fields of a struct's simple string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[at:i])
            at = i + 1
    return out


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", model: TextModel | None = None) -> DataFrame:
    """`identify` for documents: the given language is the declared one, the source stands for the host."""
    model = model or fit_text(docs, doc_id, text, lang)
    return identify(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("declared"), F.col(source).alias("host")), ["doc_id"], model, declared="declared", host="host")


def identify_pages(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`identify` for web pages: the lang attribute, the host's last label, the host and its domain are evidence."""
    host = F.nullif(host_of(F.col(url)), F.lit(""))
    declared = F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("text"), declared.alias("declared"), host.alias("host"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", domain_of(F.col("host")))
    return identify(rows, ["page_id"], model, declared="declared", suffix="suffix", host="host", domain="domain", markup=True)


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, but for those that are in no language that the labels name; rows without an id stay."""
    rejected = identify_documents(docs, doc_id, text, lang, source).where("not accepted").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(rejected, docs[doc_id] == rejected["__id"], "left_anti")

"""Queries of the training-data operators, one for each, over the whole of their tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language_id, mixing, ngram_lm, order_minhash, packing, pii, simhash, token_counts, url_filter
from graphloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and documents with their source for a host; the text model comes from labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit_text(docs)
    found = language_id.identify_documents(docs, model=model).withColumn("page_id", F.lit(None).cast("long"))
    return found.unionByName(language_id.identify_pages(pages, model).withColumn("doc_id", F.lit(None).cast("long")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.ngram_scores(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Target weights of the mix's languages; sources and topics have the roots of their shares.
TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), targets=TARGETS)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_simhash_dedup, op3_pii, op4_ngram_lm, op5_exact_dedup, op6_mixing, op7_url_filter, op8_order_minhash, op9_token_counts, op10_packing)
}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_sql() -> str:
    """The site rules, longest first, then the patterns, as CASE branches."""
    quote = lambda s: s.replace("'", "''")
    sites = sorted(url_filter.SITE_RULES, key=lambda r: -len(r.name))
    fits = []
    for r in sites:
        host, _, path = r.name.partition("/")
        fits.append((f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}')", r.name, r.verdict))
    rule = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    patterns = " ".join(f"WHEN regexp_matches(url, '{quote(r.pattern)}') THEN '{r.verdict}'" for r in url_filter.PATTERN_RULES)
    return f"""
        WITH parts AS (
            SELECT page_id, coalesce(url, '') AS url, {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} {patterns} ELSE 'allow' END AS verdict FROM parts"""


ORACLE_SQL = {
    "op6_mixing": mixing.mix_sql(targets=TARGETS),
    "op7_url_filter": _url_sql(),
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

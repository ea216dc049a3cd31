"""A training corpus from `documents`: language ID, exact and near deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, language_id, mixing, packing, similar
from graphloom.llm.common import scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language ID", identify), ("exact dedup", drop_exact), ("SimHash near-dedup", drop_near), ("mixing", mix), ("packing", pack)]

#: Fitted language models and Hamming links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage has written goes once its rows are
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

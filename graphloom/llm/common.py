"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.store import drop_table, materialize, own_dir, scratch  # noqa: F401

#: Separators of words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_bytes(text: str = "text"):
    """The whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))

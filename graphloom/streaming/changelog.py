"""A change log as a stream: deduplication, stale epochs, and a version for each micro-batch (OP-D9, OP-M6, OP-M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.versions import VersionStore


def first_seen(changes: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Changes whose key did not come before, within the watermark in a stream, so that state is bounded."""
    if changes.isStreaming:
        return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return changes.dropDuplicates(key)


def not_stale(changes: DataFrame, epoch: int) -> DataFrame:
    return changes.where(F.col("epoch") >= epoch)


def to_versions(changes: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch as a version of a store, once: a batch that is run again finds its number taken."""

    def write(batch: DataFrame, number: int) -> None:
        store = VersionStore(batch.sparkSession, store_path)
        if store.version() < number:
            store.append(batch, expected=number - 1)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming ingest: slots that arrive over time, each payload kept once. An addition of ours; first-seen means by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def new_blobs(slots: DataFrame) -> DataFrame:
    """Of a streaming table of slots (h, size), the first row of each key. The state is the set of keys, which is the catalog."""
    return slots.where(F.col("h").isNotNull()).dropDuplicates(["h"])


def append_to(slots: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append new blobs to a Parquet table; a restart goes on from the checkpoint and appends nothing twice."""
    return new_blobs(slots).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table_path)

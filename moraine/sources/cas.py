"""A folder of payloads by content key (xx/yy/key), which the driver and all executors see."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

PLACE = r"([0-9a-f]{2})/([0-9a-f]{2})/([0-9a-f]{64})$"


def place(folder: str, key: str) -> str:
    return os.path.join(folder, key[:2], key[2:4], key)


def put(payloads: DataFrame, folder: str) -> DataFrame:
    """Write payloads (h, bytes); returns h and written (false where it was there). Executors write; a key is written at most once, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for h, data in zip(batch.column("h").to_pylist(), batch.column("bytes")):
                target = place(folder, h)
                new.append(not os.path.exists(target))
                if new[-1]:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    partial = f"{target}.{os.getpid()}.tmp"
                    with open(partial, "wb") as out:
                        out.write(data.as_buffer())
                    os.replace(partial, target)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(new, pa.bool_())], names=["h", "written"])

    return payloads.where("h is not null and bytes is not null").select("h", "bytes").dropDuplicates(["h"]).mapInArrow(run, "h string, written boolean")


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    """The folder's files: h, size, bytes. Columns that aren't asked for aren't read."""
    if not any(len(x) == 2 for x in (os.listdir(folder) if os.path.isdir(folder) else [])):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load("file:" + os.path.abspath(folder))
    h = F.regexp_extract("path", PLACE, 3)
    return files.select(h.alias("h"), F.col("length").alias("size"), F.col("content").alias("bytes")).where("h != ''")


def get(keys: DataFrame, folder: str) -> DataFrame:
    """h, size, bytes of the keys (h) that the folder has."""
    spark = keys.sparkSession
    found = _files(spark, folder)
    if found is None:
        return spark.createDataFrame([], "h string, size long, bytes binary")
    return found.join(keys.select("h").distinct(), "h", "left_semi")


def exists(keys: DataFrame, folder: str) -> DataFrame:
    """keys with `exists`; no payload is read."""
    found = _files(keys.sparkSession, folder)
    if found is None:
        return keys.withColumn("exists", F.lit(False))
    return keys.join(found.select("h", F.lit(True).alias("exists")), "h", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))

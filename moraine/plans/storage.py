"""Tables in the shared folder, and ordinals that don't go through one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors see; where that is unset, a temporary folder if all run on one machine."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="moraine-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    return reader(df, label)()


def reader(df: DataFrame, label: str) -> Callable[[], DataFrame]:
    """df, written; each call gives a DataFrame of its own, so that parts of df can be joined with each other."""
    spark, schema, path = df.sparkSession, df.schema, f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return lambda: spark.read.schema(schema).parquet(path)


def streamed(df: DataFrame, by: str, values: int, size: int, part: int = 16 << 20, order: str | None = None) -> Iterator[Row]:
    """df in the order of `order` (or `by`) to the driver, which holds about `part` of its `size` bytes at a time.

    `by` counts from 0 to values - 1 and rises with the order; runs of it are the partitions, which come one after the other.
    """
    parts = max(1, min(values, -(-size // part)))
    run = F.floor(F.col(by) * parts / max(1, values)).cast("int")
    return df.repartitionById(parts, run).sortWithinPartitions(order or by).toLocalIterator()


def with_ordinal(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of the columns `by`, which should be unique.

    Rows are range-sorted and numbered within partitions; a partition's offset is the sum of the counts before it.
    """
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    local = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftrightunsigned("_at", 33)
    counts = {r["p"]: r["n"] for r in local.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number for each partition
    offset, pairs = 0, []
    for p in sorted(counts):
        pairs += [F.lit(p).cast("long"), F.lit(offset).cast("long")]
        offset += counts[p]
    base = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0).cast("long")
    return local.withColumn(name, base + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")

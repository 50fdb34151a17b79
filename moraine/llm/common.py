"""Helpers that the operators of this subpackage share: tables, shared storage, bounded samples."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where that is unset, a temporary one if all run on one machine."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="moraine-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: the lineage is cut, and any executor can read it after a loss.

    So operators run most of their jobs when they are called. They delete what nothing reads any more; the tables that a result
    still reads stay in the folder until whoever owns it clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner drop the files of finished shuffles, which it does once the driver has collected their plans as garbage.

    Python lets go of a plan first, then the JVM can; the second round catches what the first has set free.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def bounded_sample(labelled: DataFrame, key: str, label: str, per_label: int, total: int = 24_000) -> DataFrame:
    """At most per_label rows (key, label) of every label, by hash of the key; fewer of each where that would pass total rows.

    No label is left out: each has one row at least (by a draw that leaves out a label once in 1e17). Rows are drawn by hash at a rate that gives about
    twice the rows wanted, before the first of them are picked, so that no task gets all rows of a label; only the number of labels comes to the driver.
    Rows without a key or label are left out.
    """
    rows = labelled.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = stored(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_rows")), "labels")
    most = max(1, min(per_label, total // max(1, counts.count())))
    drawn = F.xxhash64(F.lit("bounded sample"), F.col(key))
    unit = F.pmod(drawn, F.lit(1 << 40)) / float(1 << 40)
    some = rows.join(counts, label).where(unit * F.col("_rows") < 2 * most + 40).withColumn("_unit", unit)
    order = Window.partitionBy(label).orderBy("_unit", key)
    picked = some.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).select(key, label)
    out = stored(picked, "sample")
    discard(counts)
    return out


def bounded_texts(rows: DataFrame, label: str, most_bytes: int = 200_000_000) -> list:
    """rows (doc_id, text and a label) for the driver: of each label, by hash of doc_id, those whose texts together fit its share of most_bytes.

    Texts over a hundredth of that share come last; of every label one row is taken, whatever its size.
    """
    share = most_bytes // max(1, rows.select(label).distinct().count())
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    order = Window.partitionBy(label).orderBy(size * 100 > share, F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.withColumn("_so_far", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(order))
    kept = rows.where((F.col("_so_far") <= share) | (F.col("_place") == 1)).drop("_so_far", "_place").collect()
    return sorted(kept, key=lambda r: (r["doc_id"], str(r[label]), r["text"] or ""))


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of df and, behind it, the columns that the DDL text names."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])

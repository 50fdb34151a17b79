"""Content dedup: first-seen blobs with reference counts, statistics and order digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.scalar import dedup_ratio
from moraine.plans.storage import with_ordinal


def blobs(slots: DataFrame, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per content key h (in each group `by`): size, ref_count, and `first`, the order columns where it was first seen.

    Payload-less rows (null h) are left out. Only keys, sizes and order columns are shuffled, after a partial sum in each task.
    """
    first = F.min(F.struct(*order)).alias("first")
    return slots.where(F.col("h").isNotNull()).groupBy(*by, "h").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("ref_count"), first)


def catalog(slots: DataFrame, order: list[str]) -> DataFrame:
    """blobs with first_seen_ord: their place (from 0) in first-seen order."""
    flat = blobs(slots, order).select("h", "size", "ref_count", *(F.col(f"first.{c}").alias(c) for c in order))
    return with_ordinal(flat, order, "first_seen_ord")


def statistics(slots: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and sums over containers, slots and blobs, and the dedup ratio; one row (or one for each group)."""
    zero = F.lit(0).cast("long")
    unique = slots.groupBy(*by, "h").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    has = F.col("h").isNotNull()
    unique = unique.select(
        *by,
        zero.alias("jars"),
        F.col("n"),
        F.when(has, F.col("n")).otherwise(0).alias("files"),
        has.cast("long").alias("u"),
        F.when(has, F.col("n") * F.col("size")).otherwise(0).alias("bytes"),
        F.when(has, F.col("size")).otherwise(0).alias("unique_bytes"),
    )
    containers = slots.select(*by, "container").distinct().select(*by, F.lit(1).cast("long").alias("jars"), *(zero.alias(c) for c in ("n", "files", "u", "bytes", "unique_bytes")))
    total = lambda c: F.coalesce(F.sum(c), zero)
    out = unique.unionByName(containers).groupBy(*by).agg(
        total("jars").alias("jar_count"),
        total("n").alias("entry_count"),
        total("files").alias("file_entry_count"),
        total("u").alias("unique_blob_count"),
        total("bytes").alias("bytes_uncompressed_entries"),
        total("unique_bytes").alias("bytes_unique_blobs"),
    )
    return out.withColumn("dedup_ratio", dedup_ratio("bytes_unique_blobs", "bytes_uncompressed_entries"))


def order_digest(rows: DataFrame, order: list[str], by: list[str], key: str = "h") -> DataFrame:
    """SHA-256 of the keys of each group, one after the other in order.

    A hash chain has an order, so a group is one stream; it is read batch by batch and never held. Without groups, the
    digest of all rows is one stream through one task; what comes before, such as an aggregation, is not in that task.
    """
    source = rows.select(*by, *order, key)
    dealt = (source.repartition(*by) if by else source.repartition(1)).sortWithinPartitions(*by, *order).select(*by, key)
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.select(*by).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, done = None, None, []
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            for group, h in zip(groups, batch.column(key).to_pylist()):
                if chain is None or group != now:
                    if chain is not None:
                        done.append((*now, chain.hexdigest()))
                    now, chain = group, hashlib.sha256()
                chain.update((h or "").encode())
            if len(done) >= 10_000:
                yield out(done)
                done = []
        if chain is not None:
            done.append((*now, chain.hexdigest()))
        if done:
            yield out(done)

    schema = ", ".join([*types, "digest string"])
    fields = [source.schema[c] for c in by]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = list(zip(*rows))
        arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(columns, fields)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.string())], names=[*by, "digest"])

    return dealt.mapInArrow(run, schema)


def shared(slots: DataFrame, least: int = 2) -> DataFrame:
    """Keys that occur in several containers: containers, refs."""
    pairs = slots.where("h is not null").groupBy("h", "container").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("h").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("refs")).where(F.col("containers") >= least)


def content_only(slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """Number and bytes of the blobs that are slots' payloads; directories, headers and pads of containers don't count."""
    used = slots.where("blob is not null").select(F.col("blob").alias("h")).distinct()
    return blobs.join(used, "h", "left_semi").agg(F.count(F.lit(1)).alias("content_blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("content_bytes"))


def input_dedupe(rows: DataFrame, keys: list[str], order: Column | str, name: str) -> DataFrame:
    """The first row of equal inputs: keys and the smallest order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(name))

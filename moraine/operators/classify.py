"""Which slots and containers can be restored byte for byte, and by which writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The writers' names.
EXACT, REBUILD, SEEK, CONCAT, PLAIN = "exact", "rebuild", "skip_exact_seek_synthetic_cd", "skip_exact_concat_synthetic_cd", "skip_exact_zipwriter"


def exact_slot() -> Column:
    """Whether a slot of its own (not an expanded container) is exact, from its columns.

    It has recorded compressed data or a codec, or is a directory without any bytes, or is stored at its own size. A slot that
    names both a payload and an expanded container is never exact.
    """
    plain = F.col("zip_index").isNull()
    kept = F.col("cdata_blob").isNotNull() | F.col("cdata_codec").isNotNull()
    empty_dir = F.col("is_dir") & (F.col("uncompressed_size") == 0) & (F.col("compressed_size") == 0)
    stored = ~F.col("is_dir") & (F.col("method_code") == 0) & F.col("blob").isNotNull() & (F.col("compressed_size") == F.col("uncompressed_size"))
    return plain & (kept | empty_dir | stored)


def with_exact(slots: DataFrame, nested: DataFrame) -> DataFrame:
    """Outer slots with slot_exact and keeps_size.

    slots: rows of container, nested_ord (null for outer ones) and the columns of exact_slot(). nested: container,
    nested_ord, tail_blob. An expanded slot is exact if its nested container has a tail and only exact slots.
    """
    own = slots.withColumn("_exact", exact_slot())
    children = own.where("nested_ord is not null").groupBy("container", "nested_ord").agg(F.bool_and("_exact").alias("_all"))
    sound = nested.join(children, ["container", "nested_ord"], "left")
    sound = sound.select("container", F.col("nested_ord").alias("zip_index"), (F.col("tail_blob").isNotNull() & F.coalesce("_all", F.lit(True))).alias("_child"))
    outer = own.where("nested_ord is null").join(sound, ["container", "zip_index"], "left")
    expanded = F.col("zip_index").isNotNull()
    exact = F.when(expanded & F.col("blob").isNotNull(), F.lit(False)).when(expanded, F.coalesce("_child", F.lit(False))).otherwise(F.col("_exact"))
    outer = outer.withColumn("slot_exact", exact)
    keeps = F.col("slot_exact") & (~expanded | (F.col("compressed_size") == F.col("uncompressed_size")))
    return outer.withColumn("keeps_size", keeps).drop("_exact", "_child")


def backend(containers: DataFrame, slots: DataFrame, nested: DataFrame) -> DataFrame:
    """containers (container, tail_blob, raw_zip_blob) with exact and backend; no slots count as all slots."""
    header = F.col("local_header_hex").isNotNull() | F.col("local_header_blob").isNotNull()
    every = with_exact(slots, nested).groupBy("container").agg(
        F.bool_and("slot_exact").alias("_exact"), F.bool_and("keeps_size").alias("_keeps"), F.bool_and(header).alias("_headers")
    )
    out = containers.join(every, "container", "left")
    true = F.lit(True)
    exact = F.col("raw_zip_blob").isNotNull() | (F.col("tail_blob").isNotNull() & F.coalesce("_exact", true))
    arm = F.when(~F.coalesce("_headers", true), PLAIN).when(F.coalesce("_keeps", true), SEEK).otherwise(CONCAT)
    out = out.withColumn("exact", exact)
    return out.withColumn("backend", F.when(F.col("exact"), EXACT).when(F.col("tail_blob").isNotNull(), REBUILD).otherwise(arm)).drop("_exact", "_keeps", "_headers")


def misses(slots: DataFrame) -> DataFrame:
    """Deflated files without a codec, by container."""
    miss = ~F.col("is_dir") & (F.col("method_code") == 8) & F.col("cdata_codec").isNull()
    return slots.groupBy("container").agg(F.count_if(miss).alias("misses"))


def codec_totals(slots: DataFrame) -> DataFrame:
    """Of each container: its slots, and the deflated files with and without a codec."""
    deflated = ~F.col("is_dir") & (F.col("method_code") == 8)
    known = F.col("cdata_codec").isNotNull()
    return slots.groupBy("container").agg(F.count(F.lit(1)).alias("slots"), F.count_if(deflated & known).alias("hits"), F.count_if(deflated & ~known).alias("misses"))


def listing(containers: DataFrame, slots: DataFrame, nested: DataFrame) -> DataFrame:
    """One row for each container: entries, signed, size, backend, misses."""
    outer = slots.where("nested_ord is null")
    counts = outer.groupBy("container").agg(F.count(F.lit(1)).alias("entries"))
    out = backend(containers, slots, nested).join(counts, "container", "left").join(misses(outer), "container", "left")
    return out.select("container", F.coalesce("entries", F.lit(0)).alias("entries"), "signed", "source_size", "backend", F.coalesce("misses", F.lit(0)).alias("misses"))

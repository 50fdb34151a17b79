"""Integrity checks of a catalog against its payloads, as DataFrames of violations.

Every check gives (check, container, slot, detail); verify() is the union of all of them, so that a damaged pack is
reported in full and not just by its first fault. `severity` orders the checks as they would be met one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ["severity", "check", "container", "slot", "detail"]


def violation(rows: DataFrame, severity: int, check: str, container: Column | str | None, slot: Column | str | None, detail: Column) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else (F.col(x) if isinstance(x, str) else x).cast("string")
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), text(container).alias("container"), text(slot).alias("slot"), text(detail).alias("detail"))


def missing(refs: DataFrame, blobs: DataFrame, key: str = "h") -> DataFrame:
    """References to keys that blobs doesn't have."""
    return refs.where(F.col(key).isNotNull()).join(blobs.select(key), key, "left_anti")


def wrong_sizes(refs: DataFrame, blobs: DataFrame, key: str = "h") -> DataFrame:
    """References (with `expected`) whose payload has another size: with `actual`."""
    return refs.join(blobs.select(key, F.col("size").alias("actual")), key).where(F.col("expected").isNotNull() & (F.col("expected") != F.col("actual")))


def reference_counts(slots: DataFrame, blobs: DataFrame) -> DataFrame:
    """Blobs whose recorded count isn't the number of their references: h, recorded, recomputed."""
    counted = slots.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("recomputed"))
    out = blobs.select("h", F.col("ref_count").alias("recorded")).join(counted, "h", "full")
    return out.select("h", F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("recomputed", F.lit(0)).alias("recomputed")).where("recorded != recomputed")


def sequence_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places (ord, h) that only one of two sequences has, with `side`; empty if and only if the sequences are equal."""
    both = left.select("ord", "h", F.lit(1).alias("l")).unionByName(right.select("ord", "h", F.lit(-1).alias("l")))
    out = both.groupBy("ord", "h").agg(F.sum("l").alias("d")).where("d != 0")
    return out.select("ord", "h", F.when(F.col("d") > 0, "left").otherwise("right").alias("side"))


def identity(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two maps: status changed, only_left or only_right."""
    l, r = left.select(key, F.col(value).alias("_l"), F.lit(1).alias("_in_l")), right.select(key, F.col(value).alias("_r"), F.lit(1).alias("_in_r"))
    out = l.join(r, key, "full")
    status = F.when(F.col("_in_r").isNull(), "only_left").when(F.col("_in_l").isNull(), "only_right").when(~F.col("_l").eqNullSafe(F.col("_r")), "changed")
    return out.select(key, status.alias("status")).where("status is not null")


def blob_references(catalog: dict[str, DataFrame]) -> DataFrame:
    """Every place that names a payload: container, slot, kind, h, expected (size, where it is recorded)."""
    slots, containers, nested = catalog["slot"], catalog["container"], catalog["nested"]
    none = F.lit(None).cast("long")
    name = F.concat_ws("/", F.col("nested_ord").cast("string"), F.col("name"))
    parts = [slots.select("container", name.alias("slot"), F.lit(k).alias("kind"), F.col(k).alias("h"), (F.col("uncompressed_size") if k == "blob" else none).alias("expected")) for k in ("blob", "cdata_blob", "local_header_blob", "pad_blob")]
    for table, kinds in ((containers, ("prefix", "leading_pad", "tail", "raw_zip")), (nested, ("prefix", "leading_pad", "tail"))):
        slot = F.col("nested_ord").cast("string") if table is nested else F.lit(None).cast("string")
        parts += [table.select("container", slot.alias("slot"), F.lit(f"{k}_blob").alias("kind"), F.col(f"{k}_blob").alias("h"), F.col(f"{k}_size").alias("expected")) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("h is not null").withColumn("h", F.lower("h"))


def verify(catalog: dict[str, DataFrame], payloads: DataFrame) -> DataFrame:
    """All violations. catalog: container, slot, nested, blob; payloads: h, size, key (recomputed), sha256, crc32."""
    slots, blobs = catalog["slot"], catalog["blob"].withColumn("h", F.lower("h"))
    refs = blob_references(catalog)
    slot = F.concat_ws("/", F.col("nested_ord").cast("string"), F.col("name"))
    has = payloads.select("h", F.col("size").alias("actual"), F.col("sha256").alias("actual_sha"))
    listed = blobs.join(has, "h", "left")
    twice = blobs.groupBy("h").count().where("count > 1")
    nested_count = catalog["nested"].groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    indexed = slots.where("zip_index is not null and nested_ord is null").join(nested_count, "container", "left")
    crc = slots.where("not is_dir and blob is not null").join(payloads.select(F.col("h").alias("blob"), F.col("crc32").alias("actual")), "blob")
    c = catalog["container"]
    checks = [
        violation(payloads.where(F.col("key") != F.col("h")), 1, "payload_hash", None, None, F.col("h")),
        violation(twice, 2, "blob_repeated", None, None, F.col("h")),
        violation(listed.where("actual is null"), 3, "blob_missing", None, None, F.col("h")),
        violation(listed.where("size != actual"), 4, "blob_size", None, None, F.col("h")),
        violation(listed.where("lower(sha256) != actual_sha"), 5, "blob_sha256", None, None, F.col("h")),
        violation(missing(refs, payloads), 6, "reference_missing", "container", "slot", F.concat_ws(" ", "kind", "h")),
        violation(wrong_sizes(refs.where("kind != 'blob'"), payloads), 7, "reference_size", "container", "slot", F.concat_ws(" ", "kind", "h")),
        violation(slots.where("blob is not null and zip_index is not null"), 8, "payload_and_nested", "container", slot, F.col("blob")),
        violation(slots.where("nested_ord is not null and zip_index is not null"), 9, "nested_too_deep", "container", slot, F.col("zip_index")),
        violation(indexed.where(F.col("zip_index") >= F.coalesce("n", F.lit(0))), 10, "nested_index", "container", slot, F.col("zip_index")),
        violation(slots.where("not is_dir and zip_index is null and blob is null"), 11, "payload_absent", "container", slot, F.col("name")),
        violation(crc.where("crc32 != actual"), 12, "crc32", "container", slot, F.col("blob")),
        violation(c.groupBy("container").count().where("count > 1"), 13, "container_repeated", "container", None, F.col("count")),
        violation(c.where(F.col("prefix_blob").isNull() != F.col("prefix_size").isNull()), 14, "prefix_half", "container", None, F.col("prefix_blob")),
        violation(slots.where("local_header_hex is not null and local_header_blob is not null"), 15, "header_twice", "container", slot, F.col("local_header_blob")),
        violation(slots.where("pad_zeros is not null and pad_blob is not null"), 16, "pad_twice", "container", slot, F.col("pad_blob")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out

"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A fingerprint holds the k smallest distinct hashes (40 bits) of a text's shingles of `length` words, in order; a text with
fewer words is one shingle, a text without words has an empty fingerprint. Fingerprints of parts merge into that of the
whole (the k smallest of both), and two of them estimate resemblance (the share of the k smallest of their union that both
hold), containment and the number of distinct shingles. As text, a fingerprint is its hashes in hex, 10 digits each.

Equal texts have equal fingerprints. Two empty fingerprints resemble each other with 1, an empty and a filled one with 0.
Null text is empty. In the order by id, null ids come first and rows with equal ids follow their texts' hashes (an id that
many rows have, null among them, is dealt to several tasks by that hash); an only document follows itself. Repeated rows give equal fingerprints.
A very long text is one row: some 50 bytes of memory for each of its words. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import partitions, stored

K, LENGTH, HASH_BITS = 128, 5, 40
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, length: int = LENGTH) -> Column:
    """The bottom-k sketch of a text: an array of at most k ascending longs."""

    def of_words(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    def of_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        run = lambda i: F.xxhash64(*(F.element_at(hashes, (i + j).cast("int")) for j in range(length)))
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), run)
        every = F.when(n == 0, F.array().cast("array<long>")).when(n < length, F.array(F.xxhash64(hashes))).otherwise(many)
        short = F.transform(every, lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS))
        return F.slice(F.sort_array(F.array_distinct(short)), 1, k)

    return let(F.filter(F.split(text, SPACES), lambda w: w != ""), of_words)


def merge(x: Column, y: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(x, y)), 1, k)


def resemblance(x: Column, y: Column, k: int = K) -> Column:
    """An estimate of the Jaccard similarity."""
    both = lambda union: F.size(F.array_intersect(F.array_intersect(union, x), y))
    return let(merge(x, y, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both(union) / F.size(union)))


def distinct_shingles(x: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below k, else estimated by the k-th smallest hash."""
    span = float(1 << HASH_BITS)
    return F.when(F.size(x) < k, F.size(x).cast("double")).otherwise((k - 1) * span / F.element_at(x, k))


def containment(x: Column, y: Column, k: int = K) -> Column:
    """An estimate of the share of x's shingles that y holds."""
    shared = resemblance(x, y, k) * distinct_shingles(merge(x, y, k), k)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(x, k)))


def as_text(x: Column) -> Column:
    return F.concat_ws("", F.transform(x, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))))


def range_buckets(rows: DataFrame, column: str, tie: Column, buckets: int) -> Column:
    """Which of about `buckets` ranges of equal counts a row's (value, tie) lies in, nulls first; tie is a hash as long.

    A value that fills ranges alone (as nulls may) is split by tie. Only bounds come to the driver; they are searched in two
    steps, as many comparisons as twice the root of their number.
    """
    at = [k / buckets for k in range(1, buckets)]
    own = F.percentile_approx(column, at, 10 * buckets) if at else F.lit(None).cast("array<long>")
    found, nulls, total = rows.agg(own, F.count_if(F.col(column).isNull()), F.count(F.lit(1))).first()
    times = Counter(found or [])
    bounds, most = sorted(times), max(times.values(), default=1)
    split = lambda n: F.least(F.floor((tie / float(1 << 64) + 0.5) * n), n - 1).cast("int")
    null_parts = max(1, -(-buckets * nulls // max(1, total)))
    if not bounds:
        return F.when(F.col(column).isNull(), split(F.lit(null_parts))).otherwise(null_parts)
    side = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + side] for k in range(0, len(bounds), side)]
    value = F.coalesce(F.col(column), F.lit(bounds[0]))
    longs = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs))
    count = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    group = F.greatest(count(longs([g[0] for g in groups])), F.lit(1))
    place = (group - 1) * side + count(F.element_at(F.array(*map(longs, groups)), group))
    heavy = [b for b in bounds if times[b] > 1]
    inner = F.lit(most)
    if heavy:
        # Of a range, the value that it begins with comes first, in as many parts as ranges begin with it.
        parts = F.element_at(F.map_from_arrays(longs(heavy), longs(times[b] for b in heavy)), value)
        inner = F.when(parts.isNotNull(), split(parts)).otherwise(most)
    return F.when(F.col(column).isNull(), split(F.lit(null_parts))).otherwise(null_parts + place * (most + 1) + inner)


def fingerprints(docs: DataFrame, k: int = K, length: int = LENGTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text: the last half (rounded down) replaced by as much of the beginning of the next document by id, or all of
    it if that is shorter; after the last document comes the first.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # Documents are dealt by ranges of ids, once with their texts; all but a range's last row find the next one there.
    docs = docs.withColumn("part", range_buckets(docs, "doc_id", F.xxhash64("text"), 4 * partitions(docs.sparkSession)))
    key = F.struct("doc_id", F.xxhash64("text").alias("tie"))
    leads = docs.groupBy("part").agg(F.min(key).alias("key"))
    leads = stored(leads.select(F.col("part").alias("lead_part"), "key.*"), "leads")  # a row for each range
    same = F.col("lead_part") == F.col("part")
    same &= docs["doc_id"].eqNullSafe(leads["doc_id"]) & (F.xxhash64(docs["text"]) == leads["tie"])
    heads = docs.join(F.broadcast(leads), same).groupBy("part").agg(F.min("text").alias("head"))
    order = Window.orderBy("part")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(around)).alias("head"))
    heads = stored(heads, "heads").withColumn("head_sketch", sketch(F.col("head"), k, length))

    rows = docs.repartition("part").withColumn("tie", F.xxhash64("text")).withColumn("sketch", sketch(F.col("text"), k, length))
    own = Window.partitionBy("part").orderBy("doc_id", "tie")
    rows = rows.withColumn("following", F.lead(F.struct("text", "sketch")).over(own)).join(heads, "part")
    last = F.col("following").isNull()
    rows = rows.withColumn("next_text", F.when(last, F.col("head")).otherwise(F.col("following.text")))
    rows = rows.withColumn("next_sketch", F.when(last, F.col("head_sketch")).otherwise(F.col("following.sketch")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k, length))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )

"""Mixing sources to target weights: equal-word blocks by Sainte-Lague apportionment, then seeded selection.

Sizes are words. Targets: the sources' weights share a total; no source takes more than `repeats` times its size, and what
it can't take is shared among the others by weight until none is above. The total is then dealt out in blocks of equal
size: each next block goes to the source with the highest quotient target / (2 * blocks so far + 1), up to what it holds.
A source is split into shards by hash of the document's id and text (so a source with a third of all rows is many shards, however
large it is), the shards lie in groups, about as many as a group has shards, and its blocks are apportioned to its groups and then to their shards
in the same way, which gives every shard an integer quota; so no task orders more than the root of a source's shards. In a shard, documents lie
in a seeded order, and the quota is a run of blocks that starts at a seeded place and goes round, up to `repeats` times:
`taken` is how many words of a document lie in that run.

Only DataFrame functions are used. The highest-quotient rule isn't simulated block by block: a divisor under which the
rounded quotients can't exceed the total gives all but a few blocks at once, and the rest are ranked (a few for each
source or shard).

Null text is empty; null source is a source of its own, after all others; null and repeated ids are rows like others
(rows with equal id and text share a place in the order). Texts are counted whole, however long. Empty tables give empty results. Other columns are not
carried. Sources go through one task, a row each: their number is taken to be bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, stored

#: Words in a block at most; fewer where the smallest source is small, so that each has 64 blocks at least.
BLOCK = 64
SHARD_WORDS = 1 << 16


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_level(rows: DataFrame, name: str, total: Column, cap: Column, weight: Column, within: list[str], tie: list[str]) -> DataFrame:
    """rows with the level L at which the sum of min(cap, L * weight) over a group is total; infinite where caps are below it."""
    rows = rows.withColumn("_weight", weight.cast("double")).withColumn("_cap", F.when(F.col("_weight") > 0, cap).otherwise(0))
    rows = rows.withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(0.0))
    group = Window.partitionBy(*within)
    below = group.orderBy("_ratio", *tie).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    # If all rows before this one are capped, and this one isn't, the level is what is left over the weights that are left.
    rest = F.sum("_weight").over(group) - before("_weight")
    rows = rows.withColumn("_level", F.when(rest > 0, (total - before("_cap")) / rest))
    # The first such row in the order; rows of equal ratio have levels of their own.
    reached = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", *tie, "_level"))).over(group)["_level"]
    return rows.withColumn(name, F.coalesce(reached, F.lit(float("inf")))).drop("_weight", "_cap", "_ratio", "_level")


def water_fill(sources: DataFrame) -> DataFrame:
    """sources with `target`: shares of all sizes by weight, none above `most`. One row per source goes through one task."""
    total = F.sum("source_size").over(Window.partitionBy("all"))
    sources = with_level(sources.withColumn("_total", total), "_at", F.col("_total"), F.col("most"), F.col("weight"), ["all"], ["source_key"])
    return sources.withColumn("target", F.least(F.col("most").cast("double"), F.col("_at") * F.col("weight"))).drop("_at", "_total")


def apportion(rows: DataFrame, votes: Column, seats: Column, room: Column, within: list[str], tie: list[str]) -> DataFrame:
    """rows with `quota`: seats (the same for all rows of a group `within`) dealt out by highest quotients votes / (2q + 1).

    No row gets more than its room; ties go to the row that `tie` sorts first.
    """
    group = Window.partitionBy(*within)
    rows = rows.withColumn("_votes", votes.cast("double")).withColumn("_seats", F.greatest(seats, F.lit(0)).cast("double")).withColumn("_room", F.when(votes > 0, room).otherwise(0))
    # Rounded at the level of half a seat for each row less than all, quotas sum to no more than the seats; at half a seat more, to no fewer.
    half = F.count(F.lit(1)).over(group) / 2
    rows = rows.withColumn("_less", F.greatest(F.col("_seats") - half, F.lit(0.0))).withColumn("_more", F.col("_seats") + half)
    rows = with_level(rows, "_low", F.col("_less"), F.col("_room"), F.col("_votes"), within, tie)
    rows = with_level(rows, "_high", F.col("_more"), F.col("_room"), F.col("_votes"), within, tie)
    rounded = lambda level: F.when(F.col("_room") > 0, F.least(F.col("_room").cast("double"), F.floor(F.col("_votes") * F.col(level) + 0.5))).otherwise(0).cast("long")
    rows = rows.withColumn("_sure", F.greatest(rounded("_low") - 1, F.lit(0))).withColumn("_most", F.least(rounded("_high") + 1, F.col("_room")).cast("long"))
    rows = rows.withColumn("_left", F.greatest(F.col("_seats") - F.sum("_sure").over(group), F.lit(0)))
    bids = rows.where("_most > _sure").select(*within, *(t for t in tie if t not in within), "_votes", "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_q"))
    best = group.orderBy(F.desc(F.col("_votes") / (2 * F.col("_q") + 1)), *tie, "_q")
    won = bids.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left")
    keys = list(dict.fromkeys([*within, *tie]))
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    out = rows.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_votes", "_seats", "_room", "_less", "_more", "_low", "_high", "_sure", "_most", "_left")


def mix(docs: DataFrame, weights: list[int] | None = None, repeats: int = 3, seed: int = 17, shard_words: int = SHARD_WORDS, block: int = BLOCK, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, for every row of docs; with carry, the row itself as `row`.

    weights repeat over the sources in code-point order. The sum of all sizes is what the mix takes.
    """
    weights = weights or [5, 2, 1]
    def with_size(*more: Column) -> DataFrame:
        out = docs.select("doc_id", "source", words("text").alias("size"), F.xxhash64("text").alias("tie"), *more)
        out = out.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
        return out.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "tie"))

    # Words are counted once; all that follows reads these thin rows.
    sized = stored(with_size(), "mix-sizes")
    place = F.row_number().over(Window.orderBy("source_key"))
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))) + 1).cast("long"))
    sources = water_fill(sources.withColumn("all", F.lit(0)).withColumn("most", F.col("source_size") * repeats))
    every = Window.partitionBy("all")
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 64))).cast("long"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = sources.withColumn("blocks", F.round(F.sum("source_size").over(every) / F.col("block")).cast("long"))
    sources = apportion(sources, F.col("target"), F.col("blocks"), F.floor(F.col("most") / F.col("block")), ["all"], ["source_key"])
    # A row for each source; written, its size is known, so that the joins below are broadcast only if it is small.
    sources = stored(sources.select("source_key", "source_size", "target", "block", "shards", F.col("quota").alias("source_quota")), "mix-sources")

    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), F.col("shards"))
    by, group = ["source_key", "shard"], F.pmod(F.col("shard"), F.ceil(F.sqrt("shards"))).alias("group")
    shards = sized.join(sources, "source_key").withColumn("shard", shard)
    shards = shards.groupBy(*by, "block", "source_quota", "shards").agg(F.sum("size").alias("length"))
    shards = stored(shards.select("*", group, F.floor(F.col("length") * repeats / F.col("block")).alias("room")), "mix-shards")
    groups = shards.groupBy("source_key", "group", "source_quota").agg(F.sum("length").alias("length"), F.sum("room").alias("room"))
    groups = apportion(groups, F.col("length"), F.col("source_quota"), F.col("room"), ["source_key"], ["source_key", "group"])
    # Written, as are the quotas of shards: apportioning reads its rows twice, and what is planned at once takes the driver's memory.
    groups = stored(groups.select("source_key", "group", F.col("quota").alias("group_quota")), "mix-groups")
    shards = apportion(shards.join(groups, ["source_key", "group"]), F.col("length"), F.col("group_quota"), F.col("room"), ["source_key", "group"], ["source_key", "group", "shard"])
    shards = stored(shards.select(*by, "quota", "length"), "mix-quotas")
    rows = (with_size(F.struct(*docs.columns).alias("row")) if carry else sized).join(sources, "source_key").withColumn("shard", shard)

    order = Window.partitionBy(*by).orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0))).join(shards, by)
    run = F.col("quota") * F.col("block")
    rest = F.when(F.col("length") > 0, run % F.col("length")).otherwise(0)
    first = F.when(F.col("length") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source_key", "shard"), F.col("length"))).otherwise(0)
    end = F.col("begin") + F.col("size")
    inside = lambda shift: F.greatest(F.lit(0), F.least(end, first + rest - shift) - F.greatest(F.col("begin"), first - shift))
    taken = F.when(F.col("length") > 0, F.floor(run / F.col("length")) * F.col("size")).otherwise(0) + inside(F.lit(0)) + inside(F.col("length"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The columns of documents, each row as many times as the mix takes it whole; a part of half or more counts as whole."""
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(0).cast("int")
    mixed = mix(docs, carry=True, **how).select("row", times.alias("times")).where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")

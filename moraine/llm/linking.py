"""From buckets of possibly similar items to connected components, without all pairs of a bucket.

Only components matter, so an item needs one link into its group. First every item of a bucket meets two pivots of the
bucket, its smallest id and one that is random for the bucket: rows stay in proportion to the bucket's size. Buckets that then
still hold several components are settled exactly: each item outside the bucket's largest component is compared with all of
its items that are of other components, first by short signatures, then in full. Where items lie in many buckets, buckets that
share items are first gathered into regions, so that an item is sent once and not with each bucket. That is done in cells of bounded blocks of items, which give only true links, so that a cell's memory is bounded
and no rows are made for pairs; and no pair is left out that could still connect two components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stored
from .components import components

#: Items in a block of a cell, about.
BLOCK = 1024
#: Ids up to which a semi-join may broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000


def semi_join(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key is among the (stored, distinct) ids, or with left_anti is not; broadcast only if these are few."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, key, how)


def sizes_fit(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can have a Jaccard similarity of percent / 100."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]


def _cells(left: pa.Table, right: pa.Table, percent: int, share: float) -> pa.Table:
    """Links between items of two tables (region, o, m, id, component, hashes, keys), of one cell (region, o, m) and of
    other components, more than a share of whose keys are equal.

    Of all links only enough are given to join what they join: items joined by a link found before aren't compared again.
    """
    found: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        values, at = zip(*(_lists(t, "hashes") for t in (left, right)))
        keys = [_lists(t, "keys")[0].reshape(t.num_rows, -1) for t in (left, right)]
        ids, groups = ([t.column(c).to_numpy().copy() for t in (left, right)] for c in ("id", "component"))
        size = [np.diff(x) for x in at]
        cells = [np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("region", "o", "m")], axis=1) for t in (left, right)]
        _, number = np.unique(np.concatenate(cells), axis=0, return_inverse=True)
        number = number.ravel()
        number = [number[: left.num_rows], number[left.num_rows :]]
        order = [np.argsort(x, kind="stable") for x in number]
        bounds = [np.searchsorted(x[o], np.arange(max(map(np.max, number)) + 2)) for x, o in zip(number, order)]
        for c in range(len(bounds[0]) - 1):
            here, there = (o[b[c] : b[c + 1]] for o, b in zip(order, bounds))
            if not len(here) or not len(there):
                continue
            own = [groups[0][here], groups[1][there]]
            n, m = size[0][here], size[1][there]
            for start in range(0, len(here), max(1, 4096 // len(there))):
                part = slice(start, start + max(1, 4096 // len(there)))
                may = np.minimum(n[part, None], m) * 100 >= np.maximum(n[part, None], m) * percent
                may &= own[0][part, None] != own[1]
                i, j = np.nonzero(may)
                near = (keys[0][here[part][i]] == keys[1][there[j]]).mean(axis=1) > share
                for k, j in zip(i[near] + start, j[near]):
                    if own[0][k] == own[1][j]:
                        continue
                    x, y = (v[p[r] : p[r + 1]] for v, p, r in zip(values, at, (here[k], there[j])))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((ids[0][here[k]], ids[1][there[j]]))
                        joined = own[1][j]
                        for g in own:
                            g[g == joined] = own[0][k]
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _settled(rest: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, by_region: bool, share: float) -> DataFrame:
    """Links (a, b) across components in unsettled buckets. rest: key, id, component, low (the bucket's smallest id)."""
    if by_region:
        regions = components(rest.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
        items = stored(rest.select("id", "component").distinct().join(regions.select("id", F.col("component").alias("region")), "id"), "items")
    else:
        items = rest.select(F.col("key").alias("region"), "id", "component")
    sizes = items.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("region").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("region", F.col("top.component").alias("main"), "n", blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("top.n")).alias("out"))
    sizes = stored(sizes.where("out > 0"), "regions")
    ids = stored(items.select("id").distinct(), "ids")
    full = stored(items.join(sizes, "region").join(sets(ids), "id"), "sets")
    # Regions of one block share tasks' groups: about BLOCK items of many regions are one group, which keeps them apart.
    few = sizes.where(F.col("all") == 1).agg(F.ceil(F.sum("n") / BLOCK)).first()[0] or 1
    block = lambda n: F.pmod(F.xxhash64(F.lit(9), "id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    carry = ["region", "id", "component", "hashes", "keys", "all"]
    outside = full.where("component != main").select(*carry, block(F.col("out")).alias("o"), every(F.col("all")).alias("m"))
    inside = full.select(*carry, block(F.col("all")).alias("m"), every(F.col("out")).alias("o"))
    group = F.when(F.col("all") == 1, F.pmod(F.xxhash64(F.lit(3), "region"), F.lit(few))).otherwise(F.xxhash64("region", "o", "m"))
    dealt = lambda rows: rows.withColumn("cell", group).drop("all").groupBy("cell")
    found = stored(dealt(outside).cogroup(dealt(inside)).applyInArrow(lambda x, y: _cells(x, y, percent, share), "a long, b long"), "links")
    discard(sizes, ids, full, items)
    return found


def connect(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, by_region: bool = True, share: float = 0.0) -> DataFrame:
    """id, component for the ids of verified pairs.

    buckets: key, id, size. verify: takes distinct pairs (a, b), a < b, and returns those that are links. sets: takes ids and
    returns id, hashes (the sorted distinct elements) and keys (as many for each, place by place); pairs of which no more than
    a share of keys is equal are not links.
    """
    low = F.struct("id", "size")
    at_random = F.struct(F.xxhash64("key", "id").alias("h"), "id", "size")
    pivots = buckets.groupBy("key").agg(F.min(low).alias("low"), F.max("id").alias("high"), F.min(at_random).alias("any"))
    pivots = pivots.where("low.id != high").select("key", "low", F.struct("any.id", "any.size").alias("any"))
    members = stored(buckets.join(pivots, "key"), "members")
    met = members.select("id", "size", F.explode(F.array("low", "any")).alias("p")).where((F.col("id") != F.col("p.id")) & sizes_fit("size", "p.size", percent))
    pairs = stored(met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct(), "pairs")
    links = stored(verify(pairs), "links")
    labels = components(links)
    discard(pairs, links)
    known = members.select("key", "id", F.col("low.id").alias("low")).join(labels, "id", "left")
    known = known.select("key", "id", "low", F.coalesce("component", "id").alias("component"))
    split = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    rest = stored(known.join(split, "key"), "unsettled")
    discard(members)
    if not rest.limit(1).count():
        discard(rest)
        return labels
    more = _settled(rest, sets, percent, by_region, share)
    # Old labels are links to their component's smallest id.
    out = components(more.union(labels.where("component != id").select(F.col("component").alias("a"), F.col("id").alias("b"))))
    discard(rest, more, labels)
    return out

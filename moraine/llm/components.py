"""Connected components of a table of links.

Many links are contracted in rounds: each node points to the neighbour (or itself) that comes first in a random order of
ids, and links are redrawn between what their ends point to, so a star is gone in two rounds and a path of n nodes in about
log n. As soon as no more than IN_ONE_TASK links are left, one task joins them by union-find: that bound, not the input,
limits its memory. Rounds are written to the shared folder, so a lost executor costs at most a round; nothing but a count
comes to the driver. A node with many links is summed up before shuffling, and joins on it may be split by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored

#: Links that one task may join: about 100 MB.
IN_ONE_TASK = 500_000


def _joined(links: DataFrame) -> DataFrame:
    """id, to for the ids of few links, in one task; `to` is the smallest id of the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        ids = list(parent)
        for at in range(0, len(ids), 50_000):
            part = ids[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], names=["id", "to"])

    return links.coalesce(1).mapInArrow(run, "id long, to long")


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """id, component (the smallest id reachable) for every id in a link (a, b). Null ends and self-links are left out."""
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    steps: list[DataFrame] = []
    while links.limit(in_one_task + 1).count() > in_one_task:
        first = F.struct(F.xxhash64(F.lit(len(steps)), "to").alias("h"), "to")
        ends = links.select(F.col("a").alias("id"), F.explode(F.array("a", "b")).alias("to")).union(links.select(F.col("b").alias("id"), F.explode(F.array("a", "b")).alias("to")))
        points = stored(ends.groupBy("id").agg(F.min(first)["to"].alias("to")), "points")
        lower = links.join(points.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
        both = lower.join(points.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b").where("ta != tb")
        redrawn = stored(both.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        discard(links)
        links = redrawn
        steps.append(points)
    joined = _joined(links)
    if not steps:
        return stored(joined.select("id", F.col("to").alias("component")), "labels")
    few = label = stored(joined, "labels")
    discard(links)
    # Follow the rounds' pointers backwards; then the smallest id of all that end at the same place names the component.
    for points in reversed(steps):
        onward = label.select(F.col("id").alias("to"), F.col("to").alias("end"))
        label = points.join(onward, "to", "left").select("id", F.coalesce("end", "to").alias("to"))
    label = stored(label, "labels")
    names = label.groupBy("to").agg(F.min("id").alias("component"))
    out = stored(label.join(names, "to").select("id", "component"), "components")
    discard(few, label, *steps)
    return out

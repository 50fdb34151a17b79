"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt by hash of a row number into blocks; a block sorts each of its dimensions once for a group of queries. For a
query, the lists are read in the direction that its component's sign prefers, a stretch of ranks at a time; every vector seen for
the first time is scored in full. The bound on any vector not yet seen is the sum over dimensions of the query's component times
the list's value at the current rank; reading stops when the k-th best score is above the bound (not when equal: a tie may
have a smaller id). A first block gives every query a k-th best score that the other blocks start from. The best of each block
are merged, so the result is exact.

Queries meet every block, a group of queries at a time, so that no task holds all queries or all candidates: a task holds
block_rows candidates and query_rows queries. Vectors that are null, or hold a null or a non-finite component, take no part.
Vectors are compared with those of the same length (an inner product of others isn't defined); the score of two empty ones is
0. A row isn't its own candidate; other rows with its id are, and query rows with one id give a list each. A row with a
null id is a candidate, behind others of its score; it is a query if `queries` is true for it. Ties go to the smaller id.
Repeated rows are candidates like others. An empty table gives an empty result. Components whose inner products pass 63 bits
aren't supported. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

RESULT = "query long, query_id long, vec_id long, score long"


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component as double; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def threshold_search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ties: np.ndarray, k: int, stretch: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, places in the block, scores) of the k best of a block for every query.

    own, rows: row numbers of the queries and the block; least: a score that k candidates elsewhere reach; ties: the rows' order among equal scores.
    """
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # ascending lists
    lists = np.take_along_axis(vectors, order, axis=0)
    # Inner products of less than 53 bits are exact as doubles, and faster.
    small = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, dims) < 1 << 53
    wide = vectors.astype(np.float64) if small else vectors
    for place, q in enumerate(queries):
        live = np.flatnonzero(q)
        up = q[live] > 0
        seen = np.zeros(n, bool)
        best, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, stretch
        while depth < n:
            stop = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[order[n - stop : n - depth, live[up]]] = True
            fresh[order[depth:stop, live[~up]]] = True
            if not len(live):
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            score = np.rint(wide[new] @ q.astype(wide.dtype)).astype(np.int64)
            keep = rows[new] != own[place]
            best, found = np.concatenate((best, new[keep])), np.concatenate((found, score[keep]))
            if len(found) > k:
                top = np.lexsort((ties[best], -found))[:k]
                best, found = best[top], found[top]
            depth, step = stop, step * 2
            if not len(live):
                break
            if depth < n:
                bound = int(np.where(up, lists[n - depth, live], lists[depth - 1, live]) @ q[live])
                if least[place] > bound or len(found) >= k and found[-1] > bound:
                    break
        yield place, best, found


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding", block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores for every row that the condition `queries` picks."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), quantised(vector, scale).alias("x"))
    rows = rows.where(F.col("x").isNotNull()).select("vec_id", "is_query", "x", F.size("x").alias("d"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors")  # which fixes the row numbers
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    sizes = rows.groupBy("d").agg(parts(F.count(F.lit(1)), block_rows).alias("blocks"), F.count_if("is_query").alias("asked"))
    # A row for each length of vectors; written, its size is known, so that the join is broadcast only if it is small.
    sizes = stored(sizes.where("asked > 0").select("d", "blocks", parts(F.col("asked"), query_rows).alias("parts")), "lengths")
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), n).cast("int")
    every = lambda n, name, first=0: F.explode(F.sequence(F.lit(first), n - 1)).alias(name)
    known = rows.join(sizes, "d")
    candidates = known.select("d", "row", "vec_id", "x", place(F.col("blocks"), 1).alias("block"), every(F.col("parts"), "part"))
    asking = known.where("is_query").select(*(F.col(c).alias(c) for c in ("d", "row", "vec_id", "x", "blocks")), place(F.col("parts"), 2).alias("part"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def wide(t: pa.Table) -> np.ndarray:
            return np.array(t.column("x").combine_chunks().flatten(), np.int64).reshape(t.num_rows, t.column("d")[0].as_py())

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id")
            none = ids.is_null().to_numpy()
            ties = np.empty(len(none), np.int64)
            ties[np.lexsort((ids.fill_null(0).to_numpy(), none))] = np.arange(len(none))
            # The lexsort above breaks ties of equal ids by place; such rows give equal results either way.
            for at, best, scores in threshold_search(wide(right), right.column("row").to_numpy(), right.column("least").to_numpy(), wide(left), left.column("row").to_numpy(), ties, k):
                out.append((np.full(len(best), at), best, scores))
        asked, found, score = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
        pick = lambda t, c, at: t.column(c).take(pa.array(at, pa.int64())) if t.num_rows else pa.array([], pa.int64())
        columns = [pick(right, "row", asked), pick(right, "vec_id", asked), pick(left, "vec_id", found), pa.array(score, pa.int64())]
        return pa.table(dict(zip(("query", "query_id", "vec_id", "score"), columns)))

    cell = ["d", "block", "part"]
    meet = lambda some, asked: some.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, RESULT)
    lowest = F.lit(-(2**63)).cast("long")
    first = stored(meet(candidates.where("block = 0"), asking.select("*", F.lit(0).alias("block"), lowest.alias("least"))), "first-block")
    least = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(lowest).alias("least")).withColumnRenamed("query", "row")
    further = asking.where("blocks > 1").join(least, "row", "left").withColumn("least", F.coalesce("least", lowest))
    found = first.union(meet(candidates.where("block > 0"), further.select("*", every(F.col("blocks"), "block", 1))))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Ordered folds: running offsets, next distinct offsets, greedy frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FRAME_LIMIT = 4 << 20


def running_offset(length: Column | str, by: list[str], order: list[str]) -> Column:
    """The total length of the rows before this one."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))


def next_distinct(offset: str, by: list[str], otherwise: Column) -> Column:
    """The smallest offset of the group that is greater than this one; rows with equal offsets share it."""
    after = Window.partitionBy(*by).orderBy(offset).rangeBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.min(offset).over(after), otherwise)


def extent(rows: DataFrame, by: list[str], end: Column, least: Column) -> DataFrame:
    """Where the directory of each container starts: behind all slots, and not before `least`."""
    return rows.groupBy(*by).agg(F.greatest(F.max(end), F.max(least)).alias("cd_start"))


def frames(records: DataFrame, order: list[str], length: str, limit: int = FRAME_LIMIT, by: list[str] = []) -> DataFrame:  # noqa: B006
    """records with frame_id and rec_off, by the writer's greedy rule, for each pack `by`.

    A record that would make a frame longer than limit starts the next one, unless the frame is empty: an oversized
    record lies alone, and a frame may hold exactly limit. The rule has a state, so a pack (one file) is one stream, read batch
    by batch; packs go side by side.
    """
    dealt = (records.repartition(*by) if by else records.repartition(1)).sortWithinPartitions(*by, *order)
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*dealt.schema.fields, StructField("frame_id", LongType()), StructField("rec_off", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame, used = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * n
            ids, offs = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k, (group, size) in enumerate(zip(groups, batch.column(length).to_pylist())):
                if group != now:
                    now, frame, used = group, 0, 0
                if used and used + size > limit:
                    frame, used = frame + 1, 0
                ids[k], offs[k] = frame, used
                used += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids), pa.array(offs)], names=[*batch.schema.names, "frame_id", "rec_off"])

    return dealt.mapInArrow(run, schema)


def frame_summary(framed: DataFrame, length: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """blob_count, record_bytes and the offset of each frame."""
    out = framed.groupBy(*by, "frame_id").agg(F.count(F.lit(1)).alias("blob_count"), F.sum(length).alias("record_bytes"))
    return with_frame_offsets(out, "record_bytes", by)


def with_frame_offsets(frames: DataFrame, length: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """frames with frame_off, the length of the frames before. There is a row for each frame (4 MiB of a pack), and a pack's go through one task."""
    return frames.withColumn("frame_off", running_offset(length, by or [F.lit(0)], ["frame_id"]))

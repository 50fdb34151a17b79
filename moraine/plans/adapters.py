"""The driver's tables seen as containers, slots and payloads; no data is copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moraine.functions.scalar import content_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(rows: DataFrame, container: Column | str, slot: Column | str, name: Column, payload: Column | str, *more: str) -> DataFrame:
    """container, slot_ord, name, h, size and further columns; the payload itself is not carried, so it isn't shuffled."""
    p = F.col(payload) if isinstance(payload, str) else payload
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(col(container).alias("container"), col(slot).alias("slot_ord"), name.alias("name"), content_key(p).alias("h"), F.octet_length(p).cast("long").alias("size"), *more)


def docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return slots(rows, "source", "doc_id", F.concat_ws("/", F.col("lang"), F.col("doc_id").cast("string")), "text", *more)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"), "props")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return slots(table(spark, sf_dir, "pages"), host, "page_id", F.col("url"), "html", "page_id", "url")

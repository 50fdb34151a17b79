"""From raw documents to packed training sequences: filter, two kinds of dedup, mix, pack.

Each stage is (name, function of spark, docs and the tables' folder); all but the last return the columns of documents, and
each works on all rows that the stage before it kept. Stages handle nulls, empty texts and empty tables as their operators
say; rows with a null id are filtered, mixed and packed, and no duplicates of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import mixing, near_dup, packing, quality, substring_dup
from moraine.llm.common import discard, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8) stays: the smallest id."""
    return near_dup.one_of_each(docs, length=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all documents but the first that has them."""
    return substring_dup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # which leaves the table of documents as it is
    return STAGES[-1][1](spark, docs, sf_dir)

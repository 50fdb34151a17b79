"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of `length` words (A-Z lower-cased; a shorter text is one shingle; a text
without words has none and links with nothing). Documents with equal sets are one class, found by a 128-bit digest, so
that copies, however many, are one row from there on. Class representatives (the smallest id) are sketched into registers;
runs of registers are band keys; classes that share a key are candidates. A pair is dropped if its similarity by maximum
likelihood over the registers lies six standard deviations under the threshold; the others are confirmed on the full sets.

Null text is empty. A row with a null id links with nothing and has a null component. Rows with equal ids are one
document for the components; repeated rows give equal rows. Of equal sets the smallest id stands for all, so there are no ties. A very long text is one
batch: about 100 bytes of memory for each of its words. Input columns other than doc_id and text are not used. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import setsketch
from .common import discard, stored
from .linking import connect, semi_join
from .words import U, Texts, chunks, distinct, mix, shingles, signed

FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"


def _sets(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    texts = Texts(batch.column("text"))
    return distinct(*shingles(texts.word_hashes(lower=True), texts.doc, texts.per_doc, length), texts.n)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def features(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = _sets(batch, length)
            n = np.diff(at)
            h1, h2 = _sums(mix(hashes + U(1)), at), _sums(mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)), at)
            sketch = [x.tobytes() for x in setsketch.registers(hashes, at)]
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(h1), pa.int64(), mask=empty), pa.array(signed(h2), pa.int64(), mask=empty), pa.array(sketch, pa.binary(), mask=empty)],
                names=["doc_id", "n_shingles", "h1", "h2", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def bands(reps: DataFrame) -> DataFrame:
    """key, id, size for every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, setsketch.M)
            key = setsketch.band_keys(registers)
            repeat = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), setsketch.BANDS), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(key).ravel()), pa.int64()), repeat("id"), repeat("size")], names=["key", "id", "size"])

    return reps.select("id", "size", "sketch").mapInArrow(run, "key long, id long, size long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of percent / 100 or more. sets: id, hashes, sketch."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("hashes").alias(f"{s}_hashes"), F.col("sketch").alias(f"{s}_sketch"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    slack = 6 * np.sqrt(percent / 100 * (1 - percent / 100) / setsketch.M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = [np.frombuffer(b"".join(batch.column(f"{s}_sketch").to_pylist()), np.uint16).reshape(-1, setsketch.M) for s in "ab"]
            column = [batch.column(f"{s}_hashes") for s in "ab"]
            values = [c.flatten().to_numpy() for c in column]
            at = [np.r_[0, np.cumsum(c.value_lengths().to_numpy())] for c in column]
            likely = setsketch.likely_jaccard(*sketch, *(np.diff(x) for x in at)) >= percent / 100 - slack
            kept = []
            for k in np.flatnonzero(likely):
                x, y = (v[p[k] : p[k + 1]] for v, p in zip(values, at))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(k)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (the row has that id), a row for each row of docs."""
    rows = stored(features(docs, length), "features")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("h1", "h2", F.col("n_shingles").alias("size")).agg(F.min("doc_id").alias("id"), F.any_value("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    made: list[DataFrame] = []  # tables that are read until the labels are there

    def sets(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                hashes, at = _sets(batch, length)
                sketch = setsketch.registers(hashes, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(hashes), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(list(sketch.view(np.int16)), pa.list_(pa.int16()))], names=["id", "hashes", "sketch", "keys"])

        wanted = semi_join(docs.select(F.col("doc_id").cast("long"), "text"), ids.withColumnRenamed("id", "doc_id"), "doc_id")
        return wanted.mapInArrow(run, "id long, hashes array<long>, sketch binary, keys array<short>")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        made.append(ids)
        return confirm(pairs, sets(ids).drop("keys"), percent)

    # Registers are equal with about the similarity as probability.
    share = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / setsketch.M)
    labels = connect(bands(classes), verify, lambda ids: sets(ids).drop("sketch"), percent, share=share)
    named = classes.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    named = stored(named, "classes")
    discard(classes, labels, *made)
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller id in their component; null ids stay."""
    found = near_duplicates(docs, **how).where(F.col("doc_id").isNotNull())
    gone = stored(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "gone")
    return semi_join(docs, gone, "doc_id", "left_anti").select(*docs.columns)

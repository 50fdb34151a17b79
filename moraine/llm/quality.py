"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Every word gives two tokens: itself, and its form (which kinds of characters it holds, and whether it repeats the word
before). Unigrams, bigrams and trigrams of both are hashed into 2**bits weights. A row's value for a feature is the feature's share of the text's words, times a scale; a score is the sparse dot
product of those shares and the weights, through the logistic function.

Training reads at most `per_label` rows of each label (chosen by hash of doc_id) and 200 MB of their texts: those bounds are the
only sample. Every row is scored by its whole text; a very long text is one batch, about 150 bytes of memory a word. Null and
empty texts have only the bias, and get a score from it. Repeated rows, and ties, are scored alike: a score depends on the
text alone. Null ids are scored and never learned. Without training rows every score is 0.5; empty tables give empty results.
Input columns named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, bounded_texts, discard, id_remainder, widened
from .ftrl import Ftrl
from .words import U, Texts, chunks, mix

BITS = 18
#: Kinds of bytes: lower-case letters and all beyond ASCII 1, upper-case 2, digits 4, then marks.
KIND = np.full(256, 64, np.uint16)
KIND[0x80:] = 1
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 4
KIND[[ord(c) for c in ",.;:'-\"()"]] = 8
KIND[ord("!")] = 16
KIND[ord("|")] = 32


def features(texts: Texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of all texts, and the text of each, in no order. Place 0 is the bias and not among them."""
    words, doc = texts.word_hashes(lower=True), texts.doc
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    form = np.bitwise_or.reduceat(KIND[texts.data], np.column_stack((texts.start, texts.stop)).ravel()[: 2 * len(words) - (texts.stop[-1] == len(texts.data))])[::2].astype(U)
    second = np.zeros(len(words), U)
    long = texts.stop - texts.start > 1
    second[long] = KIND[texts.data[texts.start[long] + 1]]
    form = form | (second << U(8))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    form = form | (same.astype(U) << U(20))
    two = doc[1:] == doc[:-1]
    three = two[1:] & two[:-1]
    parts = []
    for key in (mix(words ^ U(11)), mix(form + U(1))):
        parts += [(key, doc), (mix(key[:-1] * U(3) + key[1:])[two], doc[1:][two])]
        if len(words) > 2:
            parts.append((mix(mix(key[:-2] * U(3) + key[1:-1]) * U(5) + key[2:])[three], doc[2:][three]))
    place = np.concatenate([p for p, _ in parts])
    return (place % U((1 << bits) - 1)).astype(np.int64) + 1, np.concatenate([d for _, d in parts])


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = 4, scale: float = 4.0, seed: int = 7) -> np.ndarray:
    """Weights from (text, 0 or 1) rows, on the driver; the caller bounds the rows."""
    model = Ftrl(1 << bits)
    sparse = []
    for text, label in rows:
        texts = Texts(pa.array([text], pa.string()))
        place, _ = features(texts, bits)
        index, count = np.unique(place, return_counts=True)
        value = scale * count / max(1, texts.per_doc[0])
        sparse.append((np.r_[0, index], np.r_[1.0, value], np.array([float(label)])))
    order = np.random.default_rng(seed)
    for _ in range(epochs if rows else 0):
        for k in order.permutation(len(sparse)):
            model.step(*sparse[k])
    return model.weights()[:, 0]


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, scale: float = 4.0) -> DataFrame:
    """docs with a column `score` (0 to 1); an input column of that name is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in chunks(batches):
            texts = Texts(batch.column("text"))
            place, doc = features(texts, bits)
            total = np.bincount(doc, w[place], minlength=texts.n)
            x = float(w[0]) + scale * total / np.maximum(1, texts.per_doc)
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, widened(docs, "score double"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> np.ndarray:
    """Fit on labelled rows with crc32(doc_id) mod 5 other than 0. Of several labels for an id, the highest counts."""
    known = labels.where(id_remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1))
    picked = bounded_sample(known, "doc_id", "quality", per_label)  # at most 2 * per_label rows
    rows = bounded_texts(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "quality")
    discard(picked)
    return fit([(r["text"], r["quality"]) for r in rows])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold, else 0)."""
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns as they were."""
    clash = {c: f"moraine_input_{c}" for c in docs.columns if c.lower() in ("score", "predicted")}
    kept = classify(docs.withColumnsRenamed(clash), labels, threshold).where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})

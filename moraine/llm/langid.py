"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 4 characters (code points, with one space for any white space, in lower case),
weighted by term frequency (share of the text's n-grams) times inverse document frequency of the
training rows. Training is follow-the-regularised-leader with L1 and L2 penalties; a tenth of the training rows is kept
aside to fit one temperature, which makes the score of the predicted class a calibrated probability.

Training reads at most `per_label` rows of each language, 24,000 of all (no language is left out), and 200 MB of their texts:
those bounds are the only sample. Every row is predicted from its whole text; a very long text is one batch, about 60 bytes of memory
for each of its characters. A null text, and one without a letter, is `und` with score 0. Without training rows, or from an
empty table, every text is `und`. Ties go to the language that sorts first. Repeated rows are predicted alike; of rows
with one id and several languages the sample takes all. Input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, bounded_texts, discard, id_remainder, widened
from .ftrl import Ftrl, temperature
from .words import BASE, U, Texts, chunks

BITS, SCALE, LENGTHS = 16, 60.0, (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


def _folded(code: int) -> int:
    """The code of a character in lower case, if that is one character; of white space, that of a space."""
    x = chr(code)
    return 0x20 if x.isspace() else ord(x.lower()) if not 0xD800 <= code < 0xE000 and len(x.lower()) == 1 else code


FOLD = np.array([_folded(c) for c in range(1 << 16)], np.uint32)


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, and where each text's begin (texts.n + 1 places)."""
    data = texts.data
    if not (data & 0x80).any():
        return FOLD[data], texts.at
    start = np.flatnonzero((data & 0xC0) != 0x80)
    more = np.diff(np.r_[start, len(data)]) - 1
    lead = data[start].astype(np.uint32)
    code = np.where(more == 0, lead, lead & (0x3F >> more))
    for k in range(1, 4):
        some = np.flatnonzero(more >= k)
        code[some] = (code[some] << 6) | (data[start[some] + k] & 0x3F)
    small = code < 1 << 16
    code[small] = FOLD[code[small]]
    return code, np.searchsorted(start, texts.at)


def grams(texts: Texts, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """For every n-gram length, the place of the n-gram that ends at each character; and where each text's begin.

    An n-gram that would begin in the text before reads its first character there as a space.
    """
    folded, at = characters(texts)
    folded = folded.astype(U)
    key, places = np.zeros(len(folded), U), []
    since = np.arange(len(folded)) - np.repeat(at[:-1], np.diff(at))
    for n in LENGTHS:
        earlier = np.full(len(folded), U(0x20))
        earlier[n - 1 :] = folded[: len(folded) - n + 1]
        earlier[since < n - 1] = U(0x20)
        key = key * U(0x110001) + earlier + U(1)
        places.append((((key + U(n)) * U(BASE)) >> U(64 - bits)).astype(np.int64))
    return places, at


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


class Model:
    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, heat: float):
        """table: for each place, idf times the weights of all languages."""
        self.names, self.table, self.bias, self.heat = names, table, bias, heat

    def logits(self, texts: Texts) -> np.ndarray:
        places, at = grams(texts)
        total = np.zeros((texts.n, len(self.names)))
        filled = np.flatnonzero(np.diff(at))
        if len(filled):
            for k in range(len(self.names)):
                column = self.table[k]
                value = column[places[0]]
                for p in places[1:]:
                    value = value + column[p]
                total[filled, k] = np.add.reduceat(value, at[filled], dtype=np.float64)
        count = np.maximum(1, len(LENGTHS) * np.diff(at))[:, None]
        return (total * SCALE / count + self.bias) / self.heat


def fit(rows: list[tuple[str, str]], epochs: int = 3, seed: int = 5) -> Model | None:
    """A model from (text, language) rows, on the driver; the caller bounds the rows."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    names = sorted({y for _, y in rows})
    if not rows:
        return None
    counts, seen = [], np.zeros(1 << BITS)
    for text, _ in rows:
        places, _ = grams(Texts(pa.array([text])))
        index, count = np.unique(np.concatenate(places), return_counts=True)
        counts.append((index, count / count.sum()))
        seen[index] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    model = Ftrl((1 << BITS) + 1, len(names), alpha=0.3, l1=0.02, l2=0.05)
    sparse = [(np.r_[i, 1 << BITS], np.r_[SCALE * v * idf[i], 1.0]) for i, v in counts]
    truth = np.array([names.index(y) for _, y in rows])
    one_hot, order = np.eye(len(names)), np.random.default_rng(seed)
    aside = order.permutation(len(rows))[: len(rows) // 10]
    learn = np.setdiff1d(np.arange(len(rows)), aside)
    if len(names) > 1:
        for _ in range(epochs):
            for k in order.permutation(learn):
                model.step(*sparse[k], one_hot[truth[k]])
    w = model.weights()
    held = np.array([sparse[k][1] @ w[sparse[k][0]] for k in aside]).reshape(len(aside), len(names))
    return Model(names, np.ascontiguousarray((w[:-1] * idf[:, None]).T.astype(np.float32)), w[-1], temperature(held, truth[aside]))


def train(docs: DataFrame, per_label: int = 800) -> Model | None:
    """Fit on rows with a language whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where((id_remainder("doc_id", 4) != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    picked = bounded_sample(known.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", "lang", per_label)  # 24,000 rows, or one a language
    rows = bounded_texts(known.join(F.broadcast(picked.select("doc_id")), "doc_id"), "lang")
    discard(picked)
    return fit([(r["text"], r["lang"]) for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; input columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in chunks(batches):
            lettered = np.array([has_letter(x) for x in batch.column("text").to_pylist()], bool)
            names, best = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if m is not None:
                x = m.logits(Texts(batch.column("text")))
                x = np.exp(x - x.max(axis=1, keepdims=True))
                p = x / x.sum(axis=1, keepdims=True)
                top = p.argmax(axis=1)
                best = np.where(lettered, p[np.arange(len(p)), top], 0.0)
                names = [m.names[k] if ok else "und" for k, ok in zip(top, lettered)]
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, "lang_pred string, score double"))

"""Words, shingles and character n-grams of many texts at once, as 64-bit hashes in numpy arrays.

Texts come as Arrow string arrays; the UTF-8 bytes are worked on directly. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which never occur inside a multi-byte character. A hash depends on nothing but the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: An odd multiplier and its inverse modulo 2**64, for the prefix sums below.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
BYTE_LOWER = BYTE[LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            step = np.full(n, base, U)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0], _powers[1]


def give_back() -> None:
    """Return freed memory to the system: a worker process lives on, and so would what one task has used for a moment."""
    pa.default_memory_pool().release_unused()
    if trim is not None:
        trim(0)


try:
    trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    trim = None


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about limit bytes of text; a longer text stays whole, alone in its run."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        lengths = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        while start < n:
            base = lengths[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(lengths, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


class Texts:
    """The bytes of a run of texts, and where its words are. Null texts are empty."""

    def __init__(self, column: pa.Array):
        array = pc.fill_null(column.cast(pa.string()), "")
        _, offsets, data = array.buffers()
        self.n = len(array)
        at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        solid = ~SPACE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.at[1:-1][(self.at[1:-1] > 0) & (self.at[1:-1] < len(self.data))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n)

    def word_hashes(self, lower: bool) -> np.ndarray:
        return span_hashes(self.data, self.start, self.stop, lower)


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes of every span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))


def chain(items: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """A hash of items[first : first + length], for every first."""
    out = np.full(len(first), (length * BASE) & (2**64 - 1), U)
    for j in range(length):
        out = mix(out * U(3) + items[first + j])
    return out


def shingles(items: np.ndarray, doc: np.ndarray, per_doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of length items within a document, and their documents, in order; a shorter document is one run."""
    begin = np.cumsum(per_doc) - per_doc
    full = np.flatnonzero(doc[length - 1 :] == doc[: len(doc) - length + 1]) if len(doc) >= length else np.zeros(0, np.int64)
    parts, owners = [chain(items, full, length)], [doc[full]]
    for n in range(1, length):
        short = np.flatnonzero(per_doc == n)
        if len(short):
            parts.append(chain(items, begin[short], n))
            owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of every owner, one after the other, and where each owner's begin (n + 1 places)."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    out = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) for x in out], out=at[1:])
    return (np.concatenate(out) if out else np.zeros(0, U)), at


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

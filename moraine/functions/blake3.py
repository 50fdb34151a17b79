"""BLAKE3, after its published specification: chunks of 1024 bytes, a binary tree of parents, 32 bytes out.

The chunks of many values are compressed side by side in numpy, so neither long nor many values are hashed byte by byte in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
COLUMNS_THEN_DIAGONALS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (lanes x 8) from old ones, message words (lanes x 16), counters, block lengths and flags."""
    lanes = len(value)
    fixed = lambda x: np.broadcast_to(np.asarray(x, np.uint32), lanes)
    low, high = (np.asarray(counter, np.uint64) >> np.uint64(s) for s in (0, 32))
    v = [value[:, k] for k in range(8)] + [fixed(IV[k]) for k in range(4)] + [fixed((low & np.uint64(0xFFFFFFFF)).astype(np.uint32)), fixed(high.astype(np.uint32)), fixed(length), fixed(flags)]
    m = [words[:, k] for k in range(16)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(COLUMNS_THEN_DIAGONALS):
            for word, left, right in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], left)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], right)
        m = [m[p] for p in PERMUTATION]
    return np.stack([v[k] ^ v[k + 8] for k in range(8)], axis=1)


def _parents(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    n = len(left)
    start = np.broadcast_to(IV, (n, 8))
    return compress(start, np.concatenate((left, right), axis=1), np.zeros(n), np.full(n, 64), np.where(root, PARENT | ROOT, PARENT))


def digests(values: list[bytes]) -> list[bytes]:
    """The 32-byte hashes of values, whose chunks are all compressed side by side."""
    if not values:
        return []
    sizes = np.array([len(x) for x in values], np.int64)
    chunks = np.maximum(1, -(-sizes // 1024))
    first = np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(values)), chunks)
    padded = np.zeros(int(chunks.sum()) * 1024, np.uint8)
    for x, at in zip(values, first * 1024):
        padded[at : at + len(x)] = np.frombuffer(x, np.uint8)
    words = padded.view("<u4").reshape(-1, 16, 16)
    number = np.arange(len(owner)) - first[owner]
    length = np.where(number == chunks[owner] - 1, sizes[owner] - 1024 * number, 1024)
    blocks = np.maximum(1, -(-length // 64))
    value = np.broadcast_to(IV, (len(owner), 8)).astype(np.uint32)
    for b in range(16):
        live = np.flatnonzero(blocks > b)
        if not len(live):
            break
        ending = blocks[live] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * ending + ROOT * (ending & (chunks[owner[live]] == 1))
        value[live] = compress(value[live], words[live, b].astype(np.uint32), number[live], np.where(ending, length[live] - 64 * b, 64), flags)
    # Neighbours pair up; one left over moves up unchanged, which gives the largest power of two to every left subtree.
    while (chunks > 1).any():
        of = chunks[owner]
        pair = np.flatnonzero((number % 2 == 0) & (number + 1 < of))
        stay = number % 2 == 0
        up = value.copy()
        up[pair] = _parents(value[pair], value[pair + 1], of[pair] == 2)
        value, owner, number, chunks = up[stay], owner[stay], number[stay] // 2, (chunks + 1) // 2
    return [x.tobytes() for x in value.astype("<u4")]


def digest(data: bytes) -> bytes:
    """The 32-byte hash of one value."""
    return digests([data])[0]


def hex_digests(values: pd.Series, limit: int = 4 << 20) -> pd.Series:
    """Hashes as hex, null for null, of runs of about limit bytes at a time."""
    out, run, size = [None] * len(values), [], 0

    def done() -> None:
        for (k, _), h in zip(run, digests([x for _, x in run])):
            out[k] = h.hex()
        run.clear()

    for k, x in enumerate(values):
        if x is not None:
            run.append((k, bytes(x)))
            size += max(1024, len(run[-1][1]))
            if size >= limit:
                done()
                size = 0
    done()
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def _hex(values: pd.Series) -> pd.Series:
    return hex_digests(values)


def blake3(payload: Column | str) -> Column:
    """The hash as lower-case hex; null for null. A text counts as its UTF-8."""
    return _hex((F.col(payload) if isinstance(payload, str) else payload).cast("binary"))

"""SetSketch registers of shingle sets: exponentially spaced, truncated minima that merge by maximum.

An element gives m points, one from each of m equally likely slices of an exponential distribution with rate RATE, to the
registers in a pseudo-random order (an affine walk). A register keeps floor(1 - log_b(smallest point)), cut to 0..LIMIT + 1.
Two sets' registers are equal with a probability that grows with their Jaccard similarity (for the small base here, nearly
equal to it), so runs of registers serve as band keys; and the counts of registers that are greater, equal and smaller
give the similarity by maximum likelihood, with both sizes known.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

M, BASE, RATE, LIMIT = 128, 1.001, 20.0, (1 << 16) - 2
#: Rows of a band, and bands: a pair at similarity 0.8 shares no band with a probability of (1 - 0.8**4)**32 = 5e-8.
ROWS, BANDS = 4, 32


def registers(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The registers (sets x M, uint16) of sets that lie one after the other, from at[k] to at[k + 1]; zeros for none."""
    n = len(at) - 1
    least = np.full(n * M, np.inf)
    owner = np.repeat(np.arange(n), np.diff(at))
    seed = mix(elements ^ U(0x5851F42D4C957F2D))
    start, stride = (seed & U(M - 1)).astype(np.int64), (((seed >> U(8)) & U(M - 1)) | U(1)).astype(np.int64)
    state = mix(seed + U(1))
    for j in range(M):
        unit = ((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        point = -np.log((M - j - unit) / M) / RATE
        np.minimum.at(least, owner * M + ((start + j * stride) & (M - 1)), point)
        if j + 1 == M:
            break
        # The next slice begins here; sets whose registers all lie below it are done.
        edge = -np.log((M - j - 1) / M) / RATE
        open_sets = least.reshape(n, M).max(axis=1) > edge
        keep = open_sets[owner]
        if not keep.any():
            break
        owner, start, stride, state = owner[keep], start[keep], stride[keep], mix(state[keep] + U(0x9E3779B97F4A7C15))
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, level), 0, LIMIT + 1).astype(np.uint16).reshape(n, M)


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(x, y)


def band_keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit key for every set and band; the band's number is part of it."""
    rows = x.reshape(len(x), BANDS, ROWS).astype(U)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U))[None, :], (len(x), BANDS))
    for k in range(ROWS):
        key = mix(key * U(3) + rows[:, :, k])
    return key


def likely_jaccard(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, steps: int = 100) -> np.ndarray:
    """The similarity under which each pair's counts of greater, equal and smaller registers are likeliest."""
    greater, smaller = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - greater - smaller
    total = np.maximum(1, n_x + n_y).astype(float)
    u, v = n_x / total, n_y / total
    top = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    chance = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, best_j = np.full(len(x), -np.inf), np.zeros(len(x))
    for step in range(steps + 1):
        j = top * step / steps
        more, less = chance(u - v * j), chance(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = [np.where(c > 0, c * np.log(np.maximum(p, 1e-300)), 0.0) for c, p in ((greater, more), (smaller, less), (equal, 1 - more - less))]
        value = sum(terms)
        better = value > best
        best, best_j = np.where(better, value, best), np.where(better, j, best_j)
    return best_j

"""Vectorised hashing of the words and n-grams of one text's UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hashes (fixed value) and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, grown by doubling and kept."""
    while len(_powers[0]) < n:
        for k, base in enumerate((P, P_INVERSE)):
            size = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, size, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, a run of bytes that aren't ASCII white space."""
    gap = np.concatenate([[True], IS_SPACE[x], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; it depends on the word alone. Sums of blocks that reach from the text's start are
    differenced, so any length takes one pass."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(x) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])])
    return mixed((total[ends] - total[starts]) * down[starts])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(P) + h[k : len(h) - n + 1 + k]
    return mixed(out)

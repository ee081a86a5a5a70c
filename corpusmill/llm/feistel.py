"""Keyed permutations of 0 .. n-1 without a table: balanced Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

from corpusmill.llm.text_stats import mix

ROUNDS = 6


def _once(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where the permutation of ``key`` on ``0 .. n-1`` puts each index.

    The network permutes the next even power of two, at most ``4 * n`` values;
    an index that leaves the range is sent through again until it is back, so
    the result is a permutation of the range itself.
    """
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
    out = _once(index.astype(np.uint64), half, keys)
    away = np.flatnonzero(out >= n)
    while len(away):
        out[away] = _once(out[away], half, keys)
        away = away[out[away] >= n]
    return out.astype(np.int64)

"""Hashes of a text's words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of UTF-8 bytes, parted by ``[\\x20\\x09-\\x0D]``."""
    solid = ~BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    solid = np.flatnonzero(~BLANK[data])
    within = solid - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), M1, np.uint64))
    values = (data[solid].astype(np.uint64) + np.uint64(1)) * power[within]
    return mix(np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1]))))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    if n < size:
        return mix(np.array([np.bitwise_xor.reduce(words * np.arange(1, 2 * n, 2, dtype=np.uint64)) + np.uint64(n)], np.uint64))
    h = words[: n - size + 1].copy()
    for i in range(1, size):
        h = h * M1 + words[i : n - size + 1 + i]
    return mix(h)

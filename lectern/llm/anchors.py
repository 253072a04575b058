"""Anchors: positions of a sequence that equal windows choose alike."""

from __future__ import annotations

import numpy as np

#: Low bits of a packed value hold the position, so a sequence is taken in pieces below this length.
POSITION_BITS = 24
MOST = 1 << 23


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` values (a power of two), by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    step = 1
    while step < size:
        h = (h[:-step] * np.uint64(0xD6E8FEB86659FD93)) ^ ((h[step:] << np.uint64(31)) | (h[step:] >> np.uint64(33)))
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def anchors(h: np.ndarray, w: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Positions of the leftmost least hash of every ``w`` consecutive ones, or of the windows that are asked for.

    Equal windows choose the same place in them. About one hash in w / 2 is chosen.
    """
    if len(h) > MOST + w:
        parts = [anchors(h[i : i + MOST + w - 1], w, None if asked is None else asked[i : i + MOST]) + i for i in range(0, len(h) - w + 1, MOST)]
        return np.unique(np.concatenate(parts))
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    blocks = -(-n // w)
    packed = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    grid = packed.reshape(blocks, w)
    # Least of each w: running minima from block starts on and from block ends back.
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    if asked is not None:
        least = least[asked]
        if not len(least):
            return np.zeros(0, np.int64)
    changed = np.concatenate(([True], least[1:] != least[:-1]))
    return np.unique((least[changed] & low).astype(np.int64))

"""Winnowed anchors: positions that any two texts with a long enough common run choose alike."""

from __future__ import annotations

import numpy as np

from storyloom.llm import textkit as T


#: Low bits of a key that hold a place; the bits above are the hash's.
PLACE = 34


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive hashes, the position of the one that is smallest in its upper 30 bits (of
    equals, the last). Hash and place are one key, and windows of 1, 2, 4, ... keys are joined to the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = T.U((1 << PLACE) - 1)
    key, size = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=T.U)), 1
    while 2 * size <= width:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    return (mask - (np.minimum(key[:n], key[width - size :][:n]) & mask)).astype(np.int64)


def owned(grams: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts given as hashes of runs of `gram` words or bytes, one text after the other: hash, position, and the
    first and last start of the windows of `window` items that chose the anchor (each window chooses one)."""
    width = window - gram + 1
    chosen = winnow(grams, width)
    n = np.maximum(0, np.diff(bounds) - window + 1)
    starts = np.repeat(bounds[:-1] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    if not len(starts):
        return np.zeros(0, T.U), starts, starts, starts
    at = chosen[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return grams[at[new]], at[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]

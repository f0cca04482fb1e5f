"""Suffix sorting by a difference cover modulo 3, in array operations.

The suffixes at positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named; if names repeat, the
names' own suffixes are sorted by recursion. Each other suffix is one symbol and a sampled suffix, which sorts it, and
the two sorted lists are merged by counting. The recursion stops once names stand for `depth` symbols: suffixes that
agree so far may share a rank, and all others are ranked in the order of their first `depth` symbols at least.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _names(key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Integers from 1 in the order of the keys, and how many differ."""
    if bits <= 24:
        there = np.zeros(1 << bits, bool)
        there[key] = True
        name = np.cumsum(there, dtype=np.int32)
        return name[key], int(name[-1])
    distinct, name = np.unique(key, return_inverse=True)
    return (name + 1).astype(np.int32), len(distinct)


def _less(sorted_: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array, how many entries are smaller."""
    n = len(sorted_)
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def ranks(s: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each position of s (symbols from 1; 0 ends a text) the number of suffixes below its own.

    wanted: positions whose ranks matter; the others' may then be left 0.
    """
    n = len(s)
    if depth <= 1 or n < 3:
        if n < 3 and n:
            tails = np.array([tuple(s[i:]) + (0,) * i for i in range(n)], np.int64)
            return np.unique(tails, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int32)
        return np.searchsorted(np.sort(s), s).astype(np.int32)
    top = int(s.max())
    t = np.zeros(n + 3, np.int32)
    t[:n] = s
    wide_ = lambda p: t[p].astype(np.int64)
    bits = max(1, top.bit_length())
    one, two = np.arange(1, n + 1, 3, dtype=np.int32), np.arange(2, n + 1, 3, dtype=np.int32)
    at = np.concatenate([one, two])
    if 3 * bits <= 63:
        name, count = _names((wide_(at) << (2 * bits)) | (wide_(at + 1) << bits) | wide_(np.minimum(at + 2, n + 2)), 3 * bits)
    else:
        pair = np.unique((wide_(at) << 32) | wide_(at + 1), return_inverse=True)[1]
        name, count = _names((pair << 32) | wide_(np.minimum(at + 2, n + 2)), 63)
    rank = np.zeros(n + 3, np.int32)
    if count < len(at):
        inner = np.zeros(len(at) + 1, np.int32)
        inner[: len(one)], inner[len(one) + 1 :] = name[: len(one)], name[len(one) :]
        del name
        r = ranks(inner, -(-depth // 3))
        rank[one], rank[two] = r[: len(one)] + 1, r[len(one) + 1 :] + 1
    else:
        rank[at] = name
    zero = np.arange(0, n, 3, dtype=np.int32)
    if wanted is not None:
        use = np.zeros(n + 3, bool)
        use[wanted] = True
        zero, one, two = zero[use[zero]], one[use[one]], two[use[two]]
    one, two = one[one < n], two[two < n]
    size = max(1, int(rank.max())).bit_length()
    key1 = lambda p: (wide_(p) << size) | rank[p + 1]
    wide = 2 * bits + size > 63
    if wide:
        base = np.unique((t[:-1].astype(np.int64) << 32) | t[1:], return_inverse=True)[1]
        key2 = lambda p: (base[p] << size) | rank[p + 2]
    else:
        key2 = lambda p: (wide_(p) << (bits + size)) | (wide_(p + 1) << size) | rank[p + 2]
    own1 = key1(zero)
    order = np.argsort(own1)
    zero, own1 = zero[order], own1[order]
    own2 = key2(zero)
    out = np.zeros(n, np.int32)
    sample = np.concatenate([one, two])
    order = np.argsort(rank[sample])
    ordered = sample[order]
    below = _less(rank[ordered])
    kind = ordered % 3 == 1
    first, second = ordered[kind], ordered[~kind]
    k1, k2 = key1(first), key2(second)
    sorted2 = np.sort(own2)
    out[zero] = _less(own1) + np.searchsorted(np.sort(k1), own1) + np.searchsorted(np.sort(k2), own2)
    out[first] = below[kind] + np.searchsorted(own1, k1)
    out[second] = below[~kind] + np.searchsorted(sorted2, k2)
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts begin `length` symbols that begin at another of the starts too. text: bytes + 1, 0 between
    texts; the symbols of each start lie within its text."""
    if not len(starts):
        return np.zeros(0, bool)
    rank = ranks(text, length, starts)[starts]
    order = np.argsort(rank, kind="stable")
    p = starts[order]
    # Adjacent prefixes are compared eight symbols at a time, for as long as they agree.
    b = np.zeros(len(text) + length + 8, np.uint8)
    b[: len(text)] = text
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)
    alike = np.arange(len(p) - 1)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x, y = eight[p[alike] + k].copy().view(U), eight[p[alike + 1] + k].copy().view(U)
        alike = alike[x[:, 0] == y[:, 0]]
    hit = np.zeros(len(p), bool)
    hit[alike] = hit[alike + 1] = True
    out = np.zeros(len(p), bool)
    out[order] = hit
    return out

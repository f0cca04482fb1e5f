"""Vectorised text primitives over Arrow string columns.

Texts are read as UTF-8 bytes straight from Arrow buffers. A word is a maximal run of bytes other than
space, tab, LF, VT, FF and CR; none of these bytes occurs inside a UTF-8 sequence, so byte words are character
words. Work proceeds in slices of a few MB, so memory follows the slice and the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of a slice of short texts, and of a step inside a long one.
SLICE = 1 << 20

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random 64-bit number for each byte value.
CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
#: Keeps the first 0 .. 8 bytes of a little-endian lane.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_salts = np.zeros(0, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salts(n: int) -> np.ndarray:
    """A fixed random number for each of the places 0 .. n-1, kept for the next call."""
    global _salts
    if len(_salts) < n:
        _salts = mix(np.arange(max(n, 4096), dtype=U) * U(0x9E3779B97F4A7C15) + U(0xA24BAED4963EE407))
    return _salts[:n]


def _sums(lane, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of some spans of n lanes (one at least) and `sizes` items. lane(i, j, of, place) gives the lanes of
    the spans i..j-1 by span and place. Each lane is scrambled with its place before the lanes are added, so no regular
    pattern of values cancels out, as it can in a polynomial modulo a power of two."""
    out = np.zeros(len(n), U)
    total = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + (SLICE >> 2), "right")) - 1)
        first = total[i:j] - total[i]
        of = np.repeat(np.arange(i, j), n[i:j])
        place = np.arange(int(total[j] - total[i])) - np.repeat(first, n[i:j])
        out[i:j] = np.add.reduceat(mix(lane(of, place) ^ salts(int(n[i:j].max()))[place]), first)
        i = j
    return mix(out + sizes.astype(U) * U(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes of data, which may overlap; fold: A-Z count as a-z."""
    if not len(s):
        return np.zeros(0, U)
    low = int(s.min())
    text = np.zeros(int(e.max()) - low + 8, np.uint8)
    text[:-8] = LOWER[data[low : low + len(text) - 8]] if fold else data[low : low + len(text) - 8]
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))  # the eight bytes from each place on

    def lane(of: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = s[of] + 8 * place
        return eight[at - low] & LANE[np.minimum(e[of] - at, 8)]

    return _sums(lane, np.maximum(1, (e - s + 7) >> 3), e - s)


def span_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the items a..b-1 (one at least) of each span."""
    return _sums(lambda of, place: hashes[a[of] + place], b - a, b - a) if len(a) else np.zeros(0, U)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * U(0xD6E8FEB86659FD93) + y
    return (z ^ (z >> U(29))) * U(0xBF58476D1CE4E5B9)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values, put together from runs of 1, 2, 4, ... of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, level, size = None, 0, values, 1
    while True:
        if width & size:
            out = level[:n] if out is None else _pair(out, level[done : done + n])
            done += size
        if 2 * size > width:
            return mix(out ^ U(width))
        level = _pair(level[:-size], level[size:])
        size *= 2


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive bytes; eight bytes are one value where the width is 8, 16, 32, ..."""
    words = width // 8
    if width % 8 or words & (words - 1):
        return windows(CODE[data], width)
    if len(data) < width:
        return np.zeros(0, U)
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    level, size = (eight ^ (eight >> U(32))) * U(0x94D049BB133111EB), 8
    while size < width:
        level, size = _pair(level[:-size], level[size:]), 2 * size
    return mix(level)


def release() -> None:
    """Gives memory of earlier batches back to the system, as Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, the start and end of each text, and whether it is there (null: empty)."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1], np.where(valid, at[1:], at[:-1]), valid


def slices(starts: np.ndarray, ends: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, one text at least."""
    i, n = 0, len(starts)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words(NamedTuple):
    """Words of some texts. data: the texts, each between separators; doc: where each text begins in data."""

    data: np.ndarray
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])


def padded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline before each and after the last, and where each begins."""
    lengths = ends - starts
    doc = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    data = np.full(int(doc[-1]), 10, np.uint8)
    for s, e, d in zip(starts.tolist(), ends.tolist(), doc.tolist(), strict=False):
        data[d : d + e - s] = raw[s:e]
    return data, doc[:-1]


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, hashed: bool = True) -> Words:
    """The words of some texts and a 64-bit hash of each; fold: A-Z count as a-z in the hash."""
    data, doc = padded(raw, starts, ends)
    edges = []
    for a in range(0, len(data) - 1, SLICE):
        sep = SEPARATOR[data[a : a + SLICE + 1]]
        edges.append(np.flatnonzero(sep[1:] != sep[:-1]) + (a + 1))
    edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    s, e = edge[0::2], edge[1::2]
    out = span_hashes(data, s, e, fold) if hashed else np.zeros(0, U)
    return Words(data, doc, s, e, out, np.append(np.searchsorted(s, doc), len(s)))


@cache
def categories() -> np.ndarray:
    """The first letter of each code point's general category, as a byte."""
    return np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points whose first bytes are at these places, and their lengths."""
    x = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(4)]
    low = [v & 0x3F for v in x]
    two, three = (x[0] & 0x1F) << 6 | low[1], (x[0] & 0x0F) << 12 | low[1] << 6 | low[2]
    four = (x[0] & 0x07) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    n = np.select([x[0] < 0x80, x[0] < 0xE0, x[0] < 0xF0], [1, 2, 3], 4)
    return np.select([n == 1, n == 2, n == 3], [x[0], two, three], four), n


def letter_starts(data: np.ndarray) -> np.ndarray:
    """Whether a letter begins at each byte."""
    out = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    wide = np.flatnonzero(data >= 0xC0)
    out[wide] = categories()[code_points(data, wide)[0]] == ord("L")
    return out

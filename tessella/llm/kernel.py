"""Vectorised text kernels: Arrow string buffers to word hashes, without a Python object per word.

A batch of texts is one byte array with offsets. Words, shingles and their 64-bit hashes are computed over the whole
array with numpy, in slices of bounded size; a document longer than a slice is a slice of its own, so memory follows
the longest text and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240521))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = BYTE_CODE.copy()
_FOLDED[65:91] = BYTE_CODE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Separator bytes: ASCII blanks, or all ASCII but digits and letters.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
NON_ALNUM = np.zeros(256, dtype=bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi at a time, of about limit bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a slice: hash, byte start and end of each; first[d] is the first word of document d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, blank: np.ndarray, fold: bool = True):
        inside = ~blank[data]
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        head = inside.copy()
        head[1:] &= ~inside[:-1] | cut[1:n]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        size = self.end - self.start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        power = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
        code = (_FOLDED if fold else BYTE_CODE)[data[inside]] * power[place]
        self.hash = mix(np.add.reduceat(code, at))
        self._code, self._place, self._at = code, place, at

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(np.where(self._place < n, self._code, np.uint64(0)), self._at) ^ np.uint64(n))


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, over the whole slice; the caller keeps those within one document."""
    if len(word) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(word) - k + 1, np.uint64)
    for j in range(k):
        out += mix(word[j : len(word) - k + 1 + j] * _GRAM[j] + _GRAM[j + 32])
    return mix(out)


class Ranges:
    """Hashes of word ranges, wherever these stand."""

    def __init__(self, w: np.ndarray):
        self.down = np.cumprod(np.full(len(w), _P_INV, np.uint64))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * np.cumprod(np.full(len(w), _P, np.uint64)))))

    def sums(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.down[start]


def short_gram(word: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer than k words; its length tells it from longer ones."""
    out = np.full(1, len(word), np.uint64) * _BASE
    for j, w in enumerate(word):
        out += mix(np.full(1, w) * _GRAM[j] + _GRAM[j + 32])
    return mix(out ^ np.uint64(0x5DEECE66D))[0]


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each document of a slice; empty where it has no word."""
    every = grams(words.hash, k)
    for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            s = np.sort(every[first : first + n - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        elif n:
            yield np.array([short_gram(words.hash[first : first + n])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signed(a: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(a, dtype=np.uint64).view(np.int64)

"""Vectorised hashing of whole Arrow text columns in NumPy, the same on every worker."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: spreads every bit of 64-bit numbers over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _spread(values: np.ndarray) -> np.ndarray:
    """Small numbers as random 64-bit numbers, as sums of plain values would be predictable."""
    return mix((values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


BYTE = _spread(np.arange(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over bytes or other numbers that give the hash of any range: see `range_hash`."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else _spread(data)) * up, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, stop); equal for equal bytes."""
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column without nulls, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if str(column.type) in ("string", "binary") else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows with about `most` bytes each, one row at least."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII blanks, row after row, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return range_hash(prefix_sums(data), start, stop), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, and each one's row; a row of fewer words gives one of all its words.

    Rows without words give the same shingle, so they are equal.
    """
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - size + 1, 1)
    row = np.repeat(np.arange(len(counts)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    left = (first + counts)[row] - at
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for i in range(size):
        total += np.where(left > i, mix(padded[at + i] + np.uint64(i)), np.uint64(0)) * np.uint64(2 * i + 3)
    return mix(total + np.minimum(left, size).clip(0).astype(np.uint64)), row

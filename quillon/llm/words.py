"""Words and shingles of whole Arrow batches of texts as numpy arrays.

A word is a maximal run of bytes other than space and \\x09-\\x0D; in UTF-8 that is the same as the pattern
``[^\\x20\\x09-\\x0D]+`` over characters. Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """odd ** 0 .. odd ** (n - 1), modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), 0x9E6C63D0676A9A99, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins (n + 1 offsets); null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Give freed memory back: workers live on between stages, and two of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text (a longer text makes a part of its own), to bound memory."""
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of each word and the first word of each row (n + 1)."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    before[edge] = True
    first = before & ~space
    begin = np.flatnonzero(first)
    if not len(begin):
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    after = np.empty_like(space)
    after[-1] = True
    after[:-1] = space[1:]
    after[edge[edge > 0] - 1] = True
    end = np.flatnonzero(after & ~space) + 1
    # the place of each byte within its word: runs of 1 with a step back at every word's first byte
    step = np.ones(len(data), np.int32)
    step[begin[0]] = 1 - begin[0] if begin[0] else 0
    if begin[0]:
        step[: begin[0]] = 0
        step[begin[0]] = 0
    step[begin[1:]] = 1 - np.diff(begin)
    place = np.cumsum(step, dtype=np.int32)
    p = powers(int(place.max()) + 1)
    value = (_LOWER if lower else _BYTE)[data]
    value *= p[place]
    return mix(np.add.reduceat(value, begin)), begin, end, np.searchsorted(begin, offsets)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, row by row, and the first of each row (n + 1).

    A row with fewer words (at least one) has the whole sequence as its only shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    if len(h) >= k:
        run = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            run *= M1
            run ^= run >> np.uint64(29)
            run += h[j : len(h) - k + 1 + j]
        run = mix(run)
        full = n >= k
        index = np.repeat(first[:-1][full] - at[:-1][full], count[full]) + np.flatnonzero(np.repeat(full, count))
        out[np.repeat(full, count)] = run[index]
    for r in np.flatnonzero((n > 0) & (n < k)):
        x = np.uint64(n[r])
        for w in h[first[r] : first[r + 1]]:
            x = mix(np.asarray([x * M2 + w], np.uint64))[0]
        out[at[r]] = x
    return out, at

"""Vectorised words and shingles of many texts at once (numpy on Arrow buffers).

A word is a run of bytes other than space, tab, LF, VT, FF and CR; A-Z count as
lower case.  Words and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
_VALUE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents below n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and where each row starts (one more
    entry than rows).  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def chunks(at: np.ndarray, most: int = 512 << 10):
    """Row ranges whose bytes come to about ``most`` (a longer row stands alone)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def release() -> None:
    """Give unused memory back to the machine, as Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(run):
    """A function over batches that releases memory when it has read them all."""
    def tidied(batches):
        yield from run(batches)
        release()
    return tidied


def prefix_sums(data: np.ndarray) -> np.ndarray:
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data) + 1)[0][:-1], dtype=np.uint64, out=s[1:])
    return s


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of places, from prefix sums."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the row of each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[data]
    space = _SPACE[low]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = True
    after[first[1:] - 1] = True
    start, end = np.nonzero(~space & before)[0], np.nonzero(~space & after)[0] + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # blocks of whole words, as a prefix sum takes many bytes for each of the text
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        base = start[i]
        out[i:j] = span_hashes(prefix_sums(low[base:end[j - 1]]), start[i:j] - base, end[i:j] - base)
        i = j
    return out, np.searchsorted(at, start, "right") - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: hashes (sorted within a row) and where each
    row starts.  A row with fewer words than ``size`` has its whole sequence as its
    one shingle, a row without words has none."""
    rows = len(at) - 1
    word, row = word_hashes(data, at)
    count = np.bincount(row, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    n = max(len(word) - size + 1, 0)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + word[k:k + n])
    out, sizes = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(h[a:b - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = np.array([b - a], np.uint64)
            for k in range(a, b):
                own = mix(own * np.uint64(0x9FB21C651E98DF25) + word[k])
        else:
            continue
        out.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)

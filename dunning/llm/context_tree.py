"""The numbers of a context tree over bytes, vectorised (numpy, inside Spark tasks).

A byte is eight binary decisions; each of the 255 nodes of that binary tree has a
context tree of its own, over the bytes before.  A row ``gram`` is a context of
``depth`` bytes followed by the byte coded: the coded byte is the lowest, the most
recent byte of the context the next.
"""

from __future__ import annotations

import numpy as np

_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """All nodes of one depth: (context, binary node) sorted, counts, ln weighted
    probability, and the weight of stopping here."""

    def __init__(self, key, zeros, ones, below=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log_weighted, self.stop = own, np.ones(len(key))
        else:
            self.log_weighted = np.logaddexp(_HALF + own, _HALF + below)
            self.stop = np.exp(_HALF + own - self.log_weighted)

    def up(self, context_bytes: int) -> tuple[np.ndarray, ...]:
        """Node keys one depth higher, and sums of counts and ln probabilities there."""
        mask = np.int64((1 << 8 * (context_bytes - 1)) - 1)
        key = ((self.key >> 8) & mask) << 8 | (self.key & 255)
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        return (key, *(np.add.reduceat(x[order], first) if len(first) else x for x in (self.zeros, self.ones, self.log_weighted)))

    def mixed(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bits at these nodes, given that of the next depth."""
        at = np.searchsorted(self.key, key)
        zeros, ones = self.zeros[at], self.ones[at]
        own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        return own if deeper is None else self.stop[at] * own + (1 - self.stop[at]) * deeper


def decisions(gram: np.ndarray):
    """For each of the eight bits of the coded byte: (binary node, bit)."""
    symbol = (gram & 255).astype(np.int64)
    for k in range(8):
        yield (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1


def levels(gram: np.ndarray, count: np.ndarray, depth: int, least: int) -> list[Level]:
    """Levels ``depth`` down to ``least`` of the subtrees that hold these grams."""
    context = (gram >> 8).astype(np.int64)
    keys, bits = zip(*decisions(gram)) if len(gram) else ((context,), (context,))
    key = np.concatenate([(context << 8) | k for k in keys])
    bit = np.concatenate(bits)
    n = np.tile(count.astype(np.float64), len(keys))
    order = np.argsort(key, kind="stable")
    key, bit, n = key[order], bit[order], n[order]
    nodes, first = np.unique(key, return_index=True)
    if not len(nodes):
        first = np.zeros(0, np.int64)
    total = np.add.reduceat(n, first) if len(first) else n[:0]
    ones = np.add.reduceat(n * bit, first) if len(first) else n[:0]
    out = [Level(nodes, total - ones, ones)]
    for d in range(depth, least, -1):
        out.append(Level(*out[-1].up(d)))
    return out


def log10_probability(gram: np.ndarray, found: list[Level], depth: int) -> np.ndarray:
    """log10 probability of each gram's byte after its context, where ``found`` are
    the levels from ``depth`` down to 0."""
    total = np.zeros(len(gram))
    context = (gram >> 8).astype(np.int64)
    for node, bit in decisions(gram):
        p = None
        for d, level in zip(range(depth, -1, -1), found):
            p = level.mixed((context & ((1 << 8 * d) - 1)) << 8 | node, bit, p)
        total += np.log10(p)
    return total


def gram_pieces(data: np.ndarray, at: np.ndarray, depth: int, most: int):
    """(first row, row after the last, where each starts, gram codes), a few rows at a
    time; a row of more than ``most`` bytes comes in pieces of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        part, own = data[at[i]:at[j]], at[i:j + 1] - at[i]
        if len(part) <= most:
            yield i, j, own, gram_codes(part, own, depth)
        else:
            for a in range(0, len(part), most):
                b, left = min(a + most, len(part)), min(a, depth)
                codes = gram_codes(part[a - left:b], np.array([0, b - a + left]), depth)[left:]
                yield i, j, np.array([0, b - a]), codes
        i = j


def gram_codes(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The gram that ends at each byte; before the start of a row stand zero bytes."""
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    code = np.zeros(len(data), np.int64)
    wide = data.astype(np.int64)
    for k in range(min(depth + 1, len(data))):
        part = wide[:len(data) - k] << (8 * k)
        code[k:] |= np.where(place[k:] >= k, part, 0) if k else part
    return code

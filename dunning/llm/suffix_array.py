"""Two-stage suffix sorting of byte segments, and the minimiser ranges that bring
segments with a common string together.  Plain numpy, used inside Spark tasks."""

from __future__ import annotations

import numpy as np

from .words import mix, prefix_sums, span_hashes

SLICES = 1 << 14


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[p:p + width]) for every p with a whole window."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:len(h)] = h
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def minimiser_ranges(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Cut the starts of all ``length``-byte windows into ranges of neighbours with the
    same minimiser, which is the least hash of a ``gram``-byte string inside the window.

    Equal windows have equal minimisers, so only ranges with one minimiser need
    to be compared.  Returns arrays over the ranges: row, first start and last
    start (in the row), key (the minimiser), places (how many strings with this hash
    the range has, at least two if that was not counted) and name (hash of all bytes
    that the range's windows cover)."""
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    size = np.diff(at)
    if len(data) < length or size.max(initial=0) < length:
        return none, none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    s = prefix_sums(data)
    x = np.arange(len(data) - gram + 1)
    h = span_hashes(s, x, x + gram)
    least = _sliding_min(h, width)
    row = np.repeat(np.arange(len(size)), size)[:len(least)]
    whole = np.arange(len(least)) + length <= at[1:][row]
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    first = np.nonzero(new & whole)[0]
    closing = np.empty(len(least), bool)
    closing[-1] = True
    closing[:-1] = new[1:] | ~whole[1:]
    last = np.nonzero(closing & whole)[0]
    key = least[first]
    # places: strings with the range's least hash, looked for among the low hashes
    low = np.uint64(min(0xFFFFFFFFFFFFFFFF, (10 << 64) // width))
    places = np.where(key >= low, 2, 0)
    at_low = np.nonzero(h < low)[0]
    value = h[at_low]
    r = np.maximum(np.searchsorted(first, at_low - width + 1, "right") - 1, 0)
    while len(r):
        inside = (first[r] <= at_low) & (at_low < last[r] + width) & (value == key[r])
        np.add.at(places, r[inside], 1)
        r = r + 1
        more = r < len(first)
        more[more] = first[r[more]] <= at_low[more]
        r, at_low, value = r[more], at_low[more], value[more]
    name = span_hashes(s, first, last + length)
    base = at[:-1][row[first]]
    return row[first], first - base, last - base, key, np.maximum(places, 1), name


def _sorted_directly(text: np.ndarray, raw: bytes, at: np.ndarray, done: int, depth: int) -> np.ndarray:
    """Places whose suffixes agree in ``done`` bytes, in the order of ``depth`` bytes.  The
    next eight bytes, as one number, cut them into stretches of at most ``SLICES`` that
    are compared as bytes; only so many slices are held at a time.  More places that
    agree in those eight bytes as well are cut by the next eight."""
    if done >= depth or len(at) < 2:
        return at
    word = np.zeros(len(at), np.uint64)
    for k in range(min(8, depth - done)):
        byte = text[np.minimum(at + done + k, len(text) - 1)].astype(np.uint64)  # behind the last byte no two are compared
        word |= byte << np.uint64(56 - 8 * k)
    by = np.argsort(word, kind="stable")
    at, word = at[by], word[by]
    edges = np.append(np.nonzero(np.append(True, word[1:] != word[:-1]))[0], len(at))
    out, i = [], 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + SLICES, "right")) - 1)
        own = at[edges[i]:edges[j]]
        if len(own) > SLICES:
            own = _sorted_directly(text, raw, own, done + 8, depth)
        elif len(own) > j - i:  # some agree in these bytes
            pieces = [raw[a + done:a + depth] for a in own.tolist()]
            own = own[sorted(range(len(pieces)), key=pieces.__getitem__)]
        out.append(own)
        i = j
    return np.concatenate(out)


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of ``text`` (a boolean for each byte) in the order of their
    suffixes, as far as ``depth`` bytes decide.  0 bytes end the segments.

    Stage one sorts the suffixes that are smaller than their successors.  Stage
    two scans the buckets of first bytes upwards: of each suffix met, the one that
    starts a byte earlier and is not smaller goes to the next free place of its
    own bucket.  A bucket is scanned as a whole, as its order is known by then."""
    n = len(text)
    change = np.nonzero(text[1:] != text[:-1])[0]
    rising = np.zeros(n, bool)  # smaller than its successor
    if len(change):
        up = np.append(text[change] < text[change + 1], True)
        rising = up[np.searchsorted(change, np.arange(n), "left")]
    rising[-1] = True
    # a suffix that is not sorted directly is induced from its successors up to the first that is
    ends = np.nonzero(rising)[0]
    last = np.nonzero(wanted & ~np.append(wanted[1:], False))[0]
    upto = ends[np.searchsorted(ends, last)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, last + 1, 1)
    np.add.at(step, upto + 1, -1)
    needed = wanted | (np.cumsum(step[:-1]) > 0)

    direct = _sorted_directly(text, text.tobytes(), np.nonzero(needed & rising)[0], 0, depth)
    first = np.searchsorted(text[direct], np.arange(257))
    induced = needed & ~rising
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        parts = []
        now = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        waiting[c] = []
        while len(now):  # runs of one byte stay in the bucket
            parts.append(now)
            now = now[now > 0] - 1
            now = now[induced[now] & (text[now] == c)]
        parts.append(direct[first[c]:first[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        marks, starts = np.unique(text[before], return_index=True)
        for m, part in zip(marks.tolist(), np.split(before, starts[1:])):
            waiting[m].append(part)
    found = np.concatenate(order) if order else direct
    return found[wanted[found]]


def repeated_starts(segments: list[bytes], several: list[bool], length: int) -> list[np.ndarray]:
    """For each segment, which of its window starts have an equal window elsewhere:
    next to it in the suffix order with a common prefix of ``length`` bytes, or in
    another copy of the segment (``several``)."""
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    text[begin[1:] - 1] = 0
    text = np.minimum(text, 255).astype(np.uint8)  # UTF-8 has no byte above 0xF4
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, begin[:-1], 1)
    np.add.at(edge, begin[:-1] + np.maximum(sizes - length + 1, 0), -1)
    wanted = np.cumsum(edge[:-1]) > 0
    order = suffix_order(text, wanted, length)
    raw = text.tobytes()
    places = order.tolist()
    equal = np.fromiter((raw[a:a + length] == raw[b:b + length] for a, b in zip(places, places[1:])), bool, max(len(places) - 1, 0))
    again = np.zeros(len(text), bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [np.ones(max(k - length + 1, 0), bool) if m else again[b:b + max(k - length + 1, 0)]
            for b, k, m in zip(begin[:-1].tolist(), sizes.tolist(), several)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.nonzero(step == 1)[0], np.nonzero(step == -1)[0] - 1

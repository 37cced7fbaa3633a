"""Lattices of a SentencePiece vocabulary and Gumbel top-k sampling of segmentations.

Plain numpy, used inside Spark tasks.  No piece holds a space mark after another
character, so a text's lattice is a chain of those of its units (space marks and what
follows up to the next); units that occur again share one lattice.
"""

from __future__ import annotations

import bisect
import itertools
import re
from dataclasses import dataclass

import numpy as np

from .words import mix

_UNIT = re.compile(" +[^ ]*|[^ ]+")
_EMPTY = np.int64(-1)
_NEAR = 64


class Trie:
    """Pieces by character, as an open-addressing table of (node, character)."""

    def __init__(self, pieces: dict[str, int]):
        nodes, piece, edges = 1, [-1], {}
        for text, i in pieces.items():
            at = 0
            for c in text:
                key = at << 21 | ord(c)
                if key not in edges:
                    edges[key] = nodes
                    piece.append(-1)
                    nodes += 1
                at = edges[key]
            piece[at] = i
        self.piece, self.longest = np.array(piece), max(map(len, pieces), default=1)
        bits = (4 * max(len(edges), 1)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.next = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int64)
        for key, to in edges.items():
            at = int(self._start(np.array([key]))[0])
            while self.key[at] != _EMPTY:
                at = (at + 1) & self.mask
            self.key[at], self.next[at] = key, to

    def _start(self, key):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where the trie ends."""
        key = node << 21 | char
        at = self._start(key)
        held = self.key[at]
        miss = np.nonzero((held != key) & (held != _EMPTY))[0]
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            held[miss] = self.key[at[miss]]
            miss = miss[(held[miss] != key[miss]) & (held[miss] != _EMPTY)]
        return np.where(held == key, self.next[at], -1)


class Vocabulary:
    """Pieces, their weights and the bytes they stand for."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        self.byte = np.zeros(256, np.int64)
        self.surface, pieces, self.weight = [b""] * len(every), {}, np.zeros(len(every))
        for i in every:
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
                self.surface[i] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[text.replace("▁", " ")] = i
                self.surface[i] = text.replace("▁", " ").encode()
                self.weight[i] = -alpha * np.log(1.0 - sp.get_score(i))
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece goes on after a space")
        self.other = -alpha * np.log(1.0 + len(every))  # of each byte of a character without a piece
        self.trie = Trie(pieces)
        self._size = np.array([len(t) for t in self.surface], np.int64)
        self._first = np.concatenate(([0], np.cumsum(self._size)))[:-1]
        self._flat = np.frombuffer(b"".join(self.surface), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after another, and where each id's end."""
        size = self._size[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._first[ids] - (ends - size), size)
        return self._flat[place], ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: the space in front that encoding added goes."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_open: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    """One vocabulary for each file and temperature in a process."""
    if (path, alpha) not in _open:
        _open[path, alpha] = Vocabulary(path, alpha)
    return _open[path, alpha]


class Lattices:
    """All units of some texts.  Nodes are the places before each character of a unit and
    after its last; the arcs from a node lie together; an arc is a piece, or a character
    in bytes."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        found = [_UNIT.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        units = list(dict.fromkeys(itertools.chain.from_iterable(found)))
        number = dict(zip(units, range(len(units)))).__getitem__
        self.units = [np.fromiter(map(number, u), np.int64, len(u)) for u in found]
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.size = np.array([len(u) for u in units], np.int64)
        first = np.concatenate(([0], np.cumsum(self.size)))
        unit = np.repeat(np.arange(len(units)), self.size)
        left = first[1:][unit] - np.arange(len(chars))  # characters up to the unit's end
        self.start = first[:-1] + np.arange(len(units))  # each unit has one node more than characters
        node_of = np.arange(len(chars)) + unit

        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for k in range(1, vocabulary.trie.longest + 1):
            node = vocabulary.trie.step(node, chars[at + k - 1])
            ok = node >= 0
            at, node = at[ok], node[ok]
            i = vocabulary.trie.piece[node]
            whole = i >= 0
            found.append((at[whole], np.full(whole.sum(), k), i[whole]))
            more = left[at] > k
            at, node = at[more], node[more]
        alone = np.ones(len(chars), bool)
        alone[found[0][0]] = False
        other = np.nonzero(alone)[0]
        found.append((other, np.ones(len(other), np.int64), -1 - chars[other]))
        place, length, piece = (np.concatenate(x) for x in zip(*found))
        # arcs of a node lie together, nodes nearest to the end of their unit first
        many = sum(np.bincount(x, minlength=len(chars)) for x, _, _ in found)
        by = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 65536 else left, kind="stable")
        heads = np.zeros(len(chars), np.int64)
        heads[by] = np.concatenate(([0], np.cumsum(many[by])))[:-1]
        to, seen = [], heads.copy()
        for x, _, _ in found:
            to.append(seen[x])
            seen[x] += 1
        order = np.empty(len(place), np.int64)
        order[np.concatenate(to)] = np.arange(len(place))
        place, length, piece = place[order], length[order], piece[order]
        weight = vocabulary.weight[np.maximum(piece, 0)]
        strange = np.nonzero(piece < 0)[0]
        code = -1 - piece[strange]
        weight[strange] = vocabulary.other * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        self.piece, self.length = piece, length
        self.source, self.target = node_of[place], node_of[place] + length

        nodes = len(chars) + len(units)
        self.first_arc, self.arcs = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.first_arc[node_of], self.arcs[node_of] = heads, many
        total = np.zeros(nodes)  # ln of the summed weights of all ways to the end
        heads, counts, steps = heads[by], many[by], left[by]
        for a, b in zip(*_ranges(steps)):
            x, y = heads[a], heads[b - 1] + counts[b - 1]
            value = weight[x:y] + total[self.target[x:y]]
            top = np.maximum.reduceat(value, heads[a:b] - x)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, counts[a:b])), heads[a:b] - x)
            total[self.source[heads[a:b]]] = top + np.log(sums)
        self.log_p = weight + total[self.target] - total[self.source]
        self.p = np.exp(self.log_p)
        run = np.concatenate(([0.0], np.cumsum(self.p)))
        self.upto = run[1:] - np.repeat(run[heads], counts) if len(heads) else run[1:]
        if len(heads):
            self.upto[heads + counts - 1] = 2.0  # rounding never leads past the last arc

    def walk(self, node: np.ndarray, until: np.ndarray, seed: np.ndarray, place: np.ndarray):
        """Random ways from nodes to the ends of their units: (owner, arc) in order."""
        owner, out = np.arange(len(node)), []
        while len(owner):
            arc = self.first_arc[node]
            u = uniform(seed, place)
            low = np.nonzero(u >= self.upto[arc])[0]
            while len(low):
                arc[low] += 1
                low = low[u[low] >= self.upto[arc[low]]]
            out.append((owner, arc))
            place, node = place + self.length[arc], self.target[arc]
            more = node < until
            owner, node, until, seed, place = owner[more], node[more], until[more], seed[more], place[more]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owners, arcs = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(owners, kind="stable")
        return owners[order], arcs[order]


def _ranges(sorted_values: np.ndarray):
    heads = np.nonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))[0] if len(sorted_values) else np.zeros(0, np.int64)
    return heads, np.append(heads[1:], len(sorted_values))


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each seed and place, always the same."""
    x = mix(seed + mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def below(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at these locations, each given that it is below the bound."""
    with np.errstate(invalid="ignore"):
        out = location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, out)


@dataclass
class _Way:
    """A complete segmentation and, for its arcs from ``own`` on, the best perturbed score
    among those that share the arcs before and leave it there (their open set)."""
    arcs: np.ndarray
    score: float
    log_p: float
    open: np.ndarray
    own: int
    out: list[int]  # arcs that are excluded at the place ``own``
    tail: bool  # whether the last open set stands for all later places


def _streams(seeds, rank: int, purpose: int) -> np.ndarray:
    """A seed of its own for each text, round and purpose."""
    own = np.array([s & 0xFFFFFFFFFFFFFFFF for s in seeds], np.uint64)
    return mix(own + np.uint64((1 + 4 * rank + purpose) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


def _stream(seed: int, rank: int, purpose: int) -> np.uint64:
    return _streams([seed], rank, purpose)[0]


def sample(texts: list[str], seeds: list[int], count: int, vocabulary: Vocabulary):
    """For each text the ``count`` segmentations with the largest Gumbel-perturbed log
    probabilities, which are a sample without replacement, best first:
    (lattices, [[(arcs, log probability, perturbed score)]], [next score]).

    Perturbed A-star search: the queue holds sets of segmentations, each with the score
    of its best member.  The root set's score is a Gumbel number; a set's best way is
    found by walking down, and what leaves the way at one place is a new set whose score
    is a Gumbel number below that of the way.  So the best set of the queue always
    yields the next sample."""
    lattice = Lattices(texts, vocabulary)
    ways: list[list[_Way]] = [[] for _ in texts]
    following = [-np.inf] * len(texts)
    begins = [np.concatenate(([0], np.cumsum(lattice.size[u]))) for u in lattice.units]
    # (text, arcs before, the text's unit to go on from, node, score, log_p before, excluded)
    todo = [(i, np.zeros(0, np.int64), 0, None, None, 0.0, []) for i in range(len(texts))]
    for rank in range(count):
        starts, ends, places, bounds = [], [], [], [0]
        for i, _, unit, node, *_ in todo:
            units = lattice.units[i][unit:]
            start, end = lattice.start[units], lattice.start[units] + lattice.size[units]
            place = begins[i][unit:-1].copy()
            if node is not None:
                place[0] += node - start[0]
                start = start.copy()
                start[0] = node
            starts.append(start)
            ends.append(end)
            places.append(place)
            bounds.append(bounds[-1] + len(units))
        if not todo:
            break
        node, until, place = (np.concatenate(x) for x in (starts, ends, places))
        seed = np.repeat(_streams([seeds[i] for i, *_ in todo], rank, 0), np.diff(bounds))
        going = node < until
        owner, arcs = lattice.walk(node[going], until[going], seed[going], place[going])
        owner = np.nonzero(going)[0][owner]
        cuts = np.searchsorted(owner, bounds)
        full = [np.concatenate((before, arcs[cuts[k]:cuts[k + 1]])) for k, (_, before, *_) in enumerate(todo)]
        for (i, *_), way in zip(todo, _ways(lattice, full, seeds, rank, todo)):
            ways[i].append(way)
        leaving = []
        for i, own in enumerate(ways):
            if len(own) <= rank:
                continue
            tops = [(w.open.max(initial=-np.inf), -j) for j, w in enumerate(own)]
            score, j = max(tops)
            following[i] = score
            if rank + 1 < count and score > -np.inf:
                leaving.append((i, own[-j], float(score)))
        todo = _leave(lattice, leaving, seeds, rank + 1, begins)
    return lattice, [[(w.arcs, w.log_p, w.score) for w in own] for own in ways], following


def _ways(lattice: Lattices, full: list[np.ndarray], seeds: list[int], rank: int, todo: list) -> list[_Way]:
    """The ways of a round, all texts at once.  The open sets stand one by one for the
    first ``_NEAR`` own places; those of all later places are one set, of the
    probability that is left there."""
    size = np.array([len(a) for a in full])
    begin = np.concatenate(([0], np.cumsum(size)))
    arcs = np.concatenate([*full, np.zeros(1, np.int64)])  # one more, so that no range starts behind the last
    log_p = lattice.log_p[arcs] if len(lattice.log_p) else np.zeros(len(arcs))
    own = np.array([max(len(t[1]) - 1, 0) for t in todo])
    total, before = _range_sums(log_p, begin[:-1], begin[1:]), _range_sums(log_p, begin[:-1], begin[:-1] + own)
    if rank:
        score = np.array([t[4] for t in todo])
    else:
        score = -np.log(-np.log(uniform(_streams([seeds[t[0]] for t in todo], 0, 3), np.zeros(len(todo), np.int64))))
    step = np.arange(_NEAR)
    held = step < (size - own)[:, None]
    at = np.where(held, (begin[:-1] + own)[:, None] + step, 0)
    near = arcs[at]
    rest = np.where(held, 1.0 - lattice.p[near], 1.0) if len(lattice.p) else np.ones(near.shape)
    excluded = np.zeros(near.shape, np.int64)
    for k, t in enumerate(todo):
        if t[6] and held[k, 0]:
            rest[k, 0] -= sum(lattice.p[t[6]].tolist())
            excluded[k, 0] = len(t[6])
    upto = before[:, None] + np.concatenate((np.zeros((len(todo), 1)), np.cumsum(np.where(held, log_p[at], 0.0), axis=1)), axis=1)
    tail = size > own + _NEAR
    with np.errstate(divide="ignore"):
        single = lattice.arcs[lattice.source[near]] <= 1 + excluded if len(lattice.source) else np.ones(near.shape, bool)
        location = np.where(single | ~held, -np.inf, upto[:, :-1] + np.log(np.maximum(rest, 1e-300)))
        last = np.where(tail, upto[:, -1] + np.log(-np.expm1(np.minimum(total - upto[:, -1], 0.0))), -np.inf)
    location = np.concatenate((location, last[:, None]), axis=1)
    stream = _streams([seeds[t[0]] for t in todo], rank, 1)
    u = uniform(np.repeat(stream, _NEAR + 1), (own[:, None] + np.arange(_NEAR + 1)).ravel()).reshape(location.shape)
    best = below(location, score[:, None], u)
    many = np.minimum(size - own, _NEAR) + tail
    return [_Way(full[k], float(score[k]), float(total[k]), best[k, :many[k]].copy(), int(own[k]), t[6], bool(tail[k])) for k, t in enumerate(todo)]


def _range_sums(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of x[a:b] for ascending ranges, each added up from its first number on."""
    both = np.stack((a, b), axis=1).ravel()
    return np.where(b > a, np.add.reduceat(x, both)[::2], 0.0) if len(a) else np.zeros(0)


def _split_tail(lattice: Lattices, way: _Way, score: float, seed: int, rank: int) -> int:
    """Open the sets of the later places one by one: the best member leaves the way at a
    place drawn by the sets' probabilities, the others' scores are below its score."""
    first = way.own + _NEAR
    arcs = way.arcs[first:]
    before = float(lattice.log_p[way.arcs[:first]].sum())
    location = before + np.concatenate(([0.0], np.cumsum(lattice.log_p[arcs])))[:-1]
    with np.errstate(divide="ignore"):
        location += np.where(lattice.arcs[lattice.source[arcs]] <= 1, -np.inf, np.log(np.maximum(1.0 - lattice.p[arcs], 1e-300)))
    share = np.cumsum(np.exp(location - location.max()))
    u = uniform(np.full(len(arcs) + 1, _stream(seed, rank, 1)), first + np.arange(len(arcs) + 1) + (1 << 40))
    k = min(int(np.searchsorted(share, u[-1] * share[-1], "right")), len(arcs) - 1)
    best = below(location, score, u[:-1])
    best[k] = -np.inf
    way.open, way.tail = np.concatenate((way.open[:_NEAR], best)), False
    return _NEAR + k


def _leave(lattice: Lattices, leaving: list, seeds: list[int], rank: int, begins: list[np.ndarray]) -> list:
    """Where the best member of each way's best open set goes on, after its first own arc."""
    places = []
    for i, way, score in leaving:
        at = int(way.open.argmax())
        if way.tail and at == _NEAR:
            at = _split_tail(lattice, way, score, seeds[i], rank)
        way.open[at] = -np.inf
        places.append(at + way.own)
    us = uniform(_streams([seeds[i] for i, *_ in leaving], rank, 2), np.array(places, np.int64)).tolist()
    todo = []
    for (i, way, score), at, u in zip(leaving, places, us):
        left = int(way.arcs[at])
        node = int(lattice.source[left])
        out = [*(way.out if at == way.own else []), left]
        first = int(lattice.first_arc[node])
        weights = lattice.p[first:first + int(lattice.arcs[node])].tolist()
        arcs = [a for a in range(first, first + len(weights)) if a not in out]
        share = list(itertools.accumulate(weights[a - first] for a in arcs))
        arc = arcs[min(bisect.bisect_right(share, u * share[-1]), len(arcs) - 1)]
        before = way.arcs[:at + 1].copy()
        before[at] = arc
        done = int(lattice.length[before[:-1]].sum())
        unit = int(np.searchsorted(begins[i], done, "right")) - 1
        todo.append((i, before, unit, lattice.target[arc], score, 0.0, out))
    return todo


def ids_of(lattice: Lattices, arcs: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian unsigned 32-bit ids of arcs one after another, and how many each arc has."""
    piece = lattice.piece[arcs] if len(arcs) else arcs
    strange = np.nonzero(piece < 0)[0]
    many = np.ones(len(piece), np.int64)
    if not len(strange):
        return piece.astype("<u4"), many
    text = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in piece[strange].tolist()]
    many[strange] = [len(t) for t in text]
    out = np.repeat(piece, many)
    out[np.repeat(piece < 0, many)] = vocabulary.byte[np.frombuffer(b"".join(text), np.uint8)]
    return out.astype("<u4"), many

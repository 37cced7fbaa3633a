"""Wagner-Fischer alignment of turns with the strings of the turn grammar ``(s?(ua)+)?``.

A turn is ``(initial, must_go, cut_off)``: its role's first character, whether it has
to be deleted, and whether it costs extra unless deleted.  The grammar's strings of
one length differ only in their start, so a run of turns is aligned with each feasible
length of the string that goes on from a state: nothing yet (0), after ``s`` (1), after
``u`` (2), after ``a`` (3).  Lengths are tried from the likeliest outwards and left out
once their least possible cost exceeds the incumbent's; within a length the table is
filled only in the Ukkonen band that the incumbent's cost leaves.  Of the alignments of
least cost the audit (one letter an edit) that is least in ASCII stays.

Inserts stand before the turn that follows them, so an audit of a run ends with the
edit of its last turn; no audit of the same turns is then the beginning of another,
and runs can be joined: the order of two joined audits is that of their first
difference.  Inserts after a conversation's last turn are ``TAIL``.
"""

from __future__ import annotations

INF = 1 << 60
RUN = 32
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
STATES = 4
#: Cost and audit of what has to follow a conversation's last turn.
TAIL = ((0, ""), (10, "II"), (5, "I"), (0, ""))


def _gap(turns: int, length: int) -> int:
    """Least cost of turning so many turns into so many characters."""
    return INSERT * (length - turns) if length > turns else DELETE * (turns - length)


def _direct(turns: list, target: str) -> int:
    """Cost of one alignment: turns that may stay take the characters in order."""
    left = [t for t in turns if not t[1]]
    extra = max(0, len(target) - len(left))
    cost = INSERT * extra + DELETE * (len(turns) - len(left))
    if "s" in target[:extra]:
        return INF
    for k, (initial, _, cut_off) in enumerate(left):
        want = target[extra + k] if extra + k < len(target) else None
        if want is None:
            cost += DELETE
        elif initial == want:
            cost += CUT_OFF * cut_off
        elif want == "s":
            return INF
        else:
            cost += REROLE + CUT_OFF * cut_off
    return cost


def align(turns: list, target: str, most: int) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that give ``target``, with no insert
    after the last turn; None if they cost more than ``most``."""
    n, m = len(turns), len(target)
    band = [d for d in range(-n, m + 1) if _gap(max(0, -d), max(0, d)) + _gap(max(0, d - (m - n)), max(0, (m - n) - d)) <= most]
    if not band:
        return None
    low, high = band[0], band[-1]
    width = high - low + 3  # a column of INF on either side of the band
    rest = [[INF] * width for _ in range(n + 1)]  # rest[i][j - i - low + 1]: cost of turns i.. against target j..
    if low <= m - n <= high:
        rest[n][m - n - low + 1] = 0
    for i in range(n - 1, -1, -1):
        initial, must_go, cut_off = turns[i]
        here, below, stay = rest[i], rest[i + 1], CUT_OFF * cut_off
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            at = j - i - low + 1
            best = below[at - 1] + DELETE
            if j < m:
                want = target[j]
                if not must_go:
                    if initial == want:
                        best = min(best, below[at] + stay)
                    elif want != "s":
                        best = min(best, below[at] + REROLE + stay)
                if want != "s":
                    best = min(best, here[at + 1] + INSERT)
            here[at] = best
    if not low <= 0 <= high or rest[0][1 - low] > most or rest[0][1 - low] >= INF:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        initial, must_go, cut_off = turns[i]
        at = j - i - low + 1
        cost, below, stay = rest[i][at], rest[i + 1], CUT_OFF * cut_off
        want = target[j] if j < m else None
        if below[at - 1] + DELETE == cost:
            audit.append("D")
            i += 1
        elif want in ("u", "a") and rest[i][at + 1] + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initial == want else "R")
            i, j = i + 1, j + 1
    return rest[0][1 - low], "".join(audit)


def _targets(state: int, n: int, has_system: bool):
    """(text, state after it) of every string of up to 2 * n + 2 characters that can go on from a state."""
    ua = "ua" * (n + 2)
    if state == 2:
        return [(ua[1:k + 1], 2 if k % 2 == 0 else 3) for k in range(2 * n + 3)]
    found = [(ua[:k], (3 if k % 2 == 0 else 2) if k else state) for k in range(2 * n + 3)]
    if state == 0 and has_system:
        found += [("s" + ua[:k], (3 if k % 2 == 0 else 2) if k else 1) for k in range(2 * n + 2)]
    return found


def align_run(turns: list, state: int, tails: tuple | None = None) -> list:
    """For each state after the turns: (cost, least audit) or None.  With ``tails`` (cost
    of what follows, by state) only the states of least total are sure to be there."""
    n = len(turns)
    stay = sum(not t[1] for t in turns)
    at_least = lambda m: DELETE * (n - stay) + INSERT * (m - stay) if m >= stay else DELETE * (n - m)
    targets = sorted(_targets(state, n, any(t[0] == "s" and not t[1] for t in turns)), key=lambda t: (at_least(len(t[0])), t[0]))
    most = [INF] * STATES
    for target, end in targets:
        if at_least(len(target)) > at_least(stay) + 2 * INSERT:
            break
        most[end] = min(most[end], _direct(turns, target))
    if tails:
        total = min(c + t for c, t in zip(most, tails))
        most = [min(c, total - t) for c, t in zip(most, tails)]
    best: list = [None] * STATES
    for target, end in targets:
        if at_least(len(target)) > max(most):
            break
        if at_least(len(target)) > most[end]:
            continue
        found = align(turns, target, most[end])
        if found and (best[end] is None or found < best[end]):
            best[end] = found
            most[end] = min(most[end], found[0])
            if tails:
                total = min(total, found[0] + tails[end])
                most = [min(c, total - t) for c, t in zip(most, tails)]
    return best


def matrix(turns: list, states=range(STATES)) -> tuple[list, list]:
    """(cost, audit) by state before and after, and the costs and places (order of the
    audits) alone as two flat lists."""
    pairs = [align_run(turns, s) if s in states else [None] * STATES for s in range(STATES)]
    return pairs, summary_of(pairs)


def summary_of(pairs: list) -> tuple[list[int], list[int]]:
    costs, places = [], []
    for row in pairs:
        order = sorted(p[1] for p in row if p)
        costs += [p[0] if p else INF for p in row]
        places += [order.index(p[1]) if p else 0 for p in row]
    return costs, places


def follow(summaries: list, state: int):
    """Joins runs from a state on: by state at the end, (cost, place among the joined
    audits, states on the way) or None."""
    now = [None] * STATES
    now[state] = (0, 0, (None, state))
    for costs, places in summaries:
        after = []
        for end in range(STATES):
            ways = [(now[s][0] + costs[s * STATES + end], now[s][1], s) for s in range(STATES) if now[s] and costs[s * STATES + end] < INF]
            after.append(min(ways) if ways else None)
        keys = sorted((w[1], places[w[2] * STATES + end]) for end, w in enumerate(after) if w)
        now = [w and (w[0], keys.index((w[1], places[w[2] * STATES + end])), (now[w[2]][2], end)) for end, w in enumerate(after)]
    return now


def way(link) -> list[int]:
    """States on the way, first to last, from the links that ``follow`` keeps."""
    out = []
    while link is not None:
        link, state = link
        out.append(state)
    return out[::-1]


def runs_of(turns: list) -> list[list]:
    return [turns[a:a + RUN] for a in range(0, len(turns), RUN)]


def solve(turns: list) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    tails = tuple(c for c, _ in TAIL)
    if len(turns) <= RUN:
        best = align_run(turns, 0, tails) if turns else [(0, ""), None, None, None]
        cost, audit, end = min((p[0] + tails[s], p[1], s) for s, p in enumerate(best) if p)
        return cost, audit + TAIL[end][1]
    pairs = [matrix(run, range(STATES) if k else (0,)) for k, run in enumerate(runs_of(turns))]
    ends = follow([s for _, s in pairs], 0)
    cost, _, end = min((e[0] + tails[s], e[1], s) for s, e in enumerate(ends) if e)
    states = way(ends[end][2])
    return cost, "".join(p[a][b][1] for (p, _), a, b in zip(pairs, states, states[1:])) + TAIL[end][1]


def repaired(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """``role:text`` of each turn that the audit leaves, for (role, text) turns."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        want = "a" if state == 2 else "u"
        name = "user" if want == "u" else "assistant"
        if edit == "I":
            out.append(f"{name}:")
        else:
            role, text = turns[i]
            i += 1
            out.append(f"{role}:{text}" if edit == "K" else f"{name}:{text}")
            if edit == "K":
                want = role[:1]
        state = {"s": 1, "u": 2, "a": 3}[want]
    return out

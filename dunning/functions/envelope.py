"""Decision tables of the attempt loop: best allowed action as an upper envelope.

For a code class, a customer band and a set of allowed actions, the expected net of
each action is a line in the amount, so the best action is an upper envelope: a few
amount intervals, each with its action.  Nets are compared as rounded to cents, so
within a cent of a crossing the order of two actions can alternate; those amounts are
evaluated one by one, in whole cents, which keeps ties in catalog order exactly.

:func:`envelope_table` has one row per (raw class, ranking class, band, allowed set,
interval) and :func:`rules_table` one per state of the static rules.  Both depend on the
catalog alone, never on data; ``MAX_ROWS`` checks their size before they are broadcast.
A look-up is an equi-join on one integer and a range of cents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C

MAX_ROWS = 50_000
CLASSES = [*C.CODE_CLASSES, "OTHER"]
BANDS = ["hi", "lo", "mid"]
BIT = {a: 1 << i for i, a in enumerate(C.AUTOMATED)}
ALL_ACTIONS = (1 << len(C.AUTOMATED)) - 1
NO_CONTACT = ALL_ACTIONS & ~sum(BIT[a] for a in C.CONTACT_ACTIONS)
_END = (1 << 63) - 1


def probability(action: str, cls: str, band: str):
    """Success probability of an automated action."""
    table, up, down, floor = C.PROBABILITY[action]
    base = table[cls]
    return min(C.BAND_CAP, base + up) if band == "hi" else max(floor, base - down) if band == "lo" else base


def _nets(p: np.ndarray, cost: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Expected nets in cents, rounded half away from zero, by action and amount."""
    exact = p[:, None] * cents[None, :] - 100 * cost[:, None]
    return np.sign(exact) * ((np.abs(exact) + 50) // 100)


def intervals(cls: str, band: str) -> dict[int, list[tuple[int, int, str]]]:
    """By allowed set: (first cent, end, best action), in order and without gaps from 0."""
    p = np.array([int(probability(a, cls, band) * 100) for a in C.AUTOMATED], np.int64)
    cost = np.array([int(C.RANK_COST[a] * 100) for a in C.AUTOMATED], np.int64)
    points = {0}
    for i in range(len(p)):
        for j in range(i):
            if p[i] != p[j]:
                gap = 100 // int(abs(p[i] - p[j])) + 2
                at = 100 * int(cost[i] - cost[j]) // int(p[i] - p[j])
                points.update(range(max(at - gap, 0), max(at + gap + 2, 0)))
    cents = np.array(sorted(points), np.int64)
    nets = _nets(p, cost, cents)
    out = {}
    for allowed in range(1, ALL_ACTIONS + 1):
        own = [i for i in range(len(p)) if allowed >> i & 1]
        best = np.array(own)[nets[own].argmax(axis=0)]  # the first of equals: catalog order
        cut = np.concatenate(([0], np.nonzero(best[1:] != best[:-1])[0] + 1))
        ends = [*cents[cut[1:]].tolist(), _END]
        out[allowed] = [(a, b, C.AUTOMATED[k]) for a, b, k in zip(cents[cut].tolist(), ends, best[cut].tolist())]
    return out


def envelope_key(raw: str, rank: str, band: str, allowed: str) -> str:
    """SQL text of the key of a state, from the numbers of its class, ranking class and band."""
    return f"(({raw} * {len(CLASSES)} + {rank}) * {len(BANDS)} + {band}) * {ALL_ACTIONS + 1} + {allowed}"


@functools.lru_cache(maxsize=None)
def _envelope_rows() -> pa.Table:
    rows = []
    for c, cls in enumerate(CLASSES):
        for b, band in enumerate(BANDS):
            best = intervals(cls, band)
            for r, raw in enumerate(CLASSES):
                base = ((r * len(CLASSES) + c) * len(BANDS) + b) * (ALL_ACTIONS + 1)
                for allowed, parts in best.items():
                    for lo, hi, a in parts:
                        rows.append((base + allowed, lo, hi, a, probability(a, cls, band), C.RANK_COST[a], probability(a, raw, band)))
    names = ["key", "lo", "hi", "action", "rank_p", "rank_cost", "p"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.decimal128(3, 2), pa.decimal128(5, 1), pa.decimal128(3, 2)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def rules_key(raw: str, band: str, optout: str, tried: str, later: str) -> str:
    return f"((({raw} * {len(BANDS)} + {band}) * 2 + {optout}) * {ALL_ACTIONS + 1} + {tried}) * 2 + {later}"


@functools.lru_cache(maxsize=None)
def _rules_rows() -> pa.Table:
    rows = []
    for c, cls in enumerate(CLASSES):
        for b, band in enumerate(BANDS):
            for optout in (0, 1):
                for tried in range(ALL_ACTIONS + 1):
                    for later in (0, 1):
                        a = C.RULES_ACTION[cls][later]
                        rule = ("SAFETY_EXIT" if a in C.EXITS else "DUPLICATE_ACTION" if tried & BIT[a]
                                else "COMMUNICATION_OPT_OUT" if optout and a in C.CONTACT_ACTIONS else "POLICY_APPROVED")
                        done = a if C.POLICY_RESULTS[rule] == "APPROVED" else C.STOP
                        p = probability(done, cls, band) if done in BIT else C.D("0.00")
                        rows.append((((((c * len(BANDS) + b) * 2 + optout) * (ALL_ACTIONS + 1)) + tried) * 2 + later, a, rule, done, p))
    names = ["key", "action", "rule", "done", "p"]
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.decimal128(3, 2)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _broadcast(spark: SparkSession, rows: pa.Table, prefix: str) -> DataFrame:
    if rows.num_rows > MAX_ROWS:
        raise ValueError(f"decision table of {rows.num_rows} rows")
    return F.broadcast(spark.createDataFrame(rows).toDF(*[f"{prefix}{c}" for c in rows.column_names]))


def best_action(df: DataFrame, key: str, cents: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>action``, ``rank_p``, ``rank_cost`` and ``p``: the best action of the
    envelope ``key`` at an amount in cents; NULLs where nothing is allowed."""
    t = _broadcast(df.sparkSession, _envelope_rows(), prefix)
    at = F.expr(f"{key} = {prefix}key AND {cents} >= {prefix}lo AND {cents} < {prefix}hi")
    return df.join(t, at, "left").drop(*[f"{prefix}{c}" for c in ("key", "lo", "hi")])


def rules_action(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>action``, ``rule``, ``done`` and ``p`` of the static rules."""
    t = _broadcast(df.sparkSession, _rules_rows(), prefix)
    return df.join(t, F.expr(f"{key} = {prefix}key"), "left").drop(f"{prefix}key")

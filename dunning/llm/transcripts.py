"""Operator 5: chat formatting by a hidden Markov model over transcript lines.

A transcript is a sequence of pieces of raw text (conv_id, turn, text); the pieces'
order is by turn, and turns need not be pieces.  Each line has a symbol made of what
can be seen in it: the speaker marker, the length, a question mark at the end, and a
blank line before it.  A state is a role and whether the line opens a turn or goes on;
a line can only go on with the role of the line before it.  Start, transition and
emission counts come from labelled transcripts, Viterbi decoding gives the roles, and
each turn is rendered in one canonical form.

How it is spread: pieces are range-partitioned by conversation and place, so a
conversation of any length is cut over as many partitions as it fills.  The parts of a
conversation that crosses partitions are joined exactly: each gives its matrix of best
scores from the state before to its last state; these rows (at most two for each
partition) fix the states at the cuts, and then every partition decodes on its own.

Defined results: null text is an empty line; a null conv_id names one conversation of
its own; a null turn comes first; equal turns keep an order of their own; a null or
unknown role teaches nothing; without labels the start values are used (markers
only); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, held_out, staged, task_count

ROLES = ("system", "user", "assistant")
#: Names that speaker markers use, by role.
NAMES = {"system": "system", "instruction": "system", "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user",
         "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant", "answer": "assistant", "a": "assistant"}
_MARKER = re.compile(r"\s{0,8}[#*\[<|]{0,4}\s?([A-Za-z]{1,11})\s?[*\]>|]{0,4}\s?(?::|>|(?<=[\]>|]))\s?[*]{0,2}\s{0,4}")
STATES, SYMBOLS = 2 * len(ROLES), 5 * 4 * 2 * 2
_LONG = T.LongType()


def read_line(line: str, after_blank: bool) -> tuple[int, int]:
    """(symbol, how many characters the speaker marker takes)."""
    found, kind, cut = _MARKER.match(line), 0, 0
    if found:
        role = NAMES.get(found[1].lower())
        kind = 1 + ROLES.index(role) if role else 4
        cut = found.end() if role else 0
    n = len(line) - cut
    size = 0 if not line.strip() else 1 if n < 40 else 2 if n < 160 else 3
    return ((kind * 4 + size) * 2 + line.rstrip().endswith("?")) * 2 + after_blank, cut


def symbols(lines: list[str]) -> np.ndarray:
    blank = [False] + [not x.strip() for x in lines[:-1]]
    return np.array([read_line(x, b)[0] for x, b in zip(lines, blank)], np.int64)


@dataclass(frozen=True)
class TranscriptModel:
    """Natural logarithms; -inf where a line cannot go on with another role."""
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def model_of(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> TranscriptModel:
    """From counts.  What was never seen has the weight of a fraction of a line, and a
    marker speaks for its role from the outset."""
    allowed = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(STATES)] for a in range(STATES)])
    marker = np.arange(SYMBOLS) // 16
    prior = np.full((STATES, SYMBOLS), 0.02)
    for s in range(0, STATES, 2):
        prior[s, marker == 1 + s // 2] = 2.0
        prior[s + 1, (marker == 0) | (marker == 4)] = 0.5
    with np.errstate(divide="ignore"):
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return TranscriptModel(norm(start + np.where(np.arange(STATES) % 2, 0.01, 0.5)), norm(np.where(allowed, step + 0.5, 0.0)), norm(emit + prior))


def spread(symbol: np.ndarray, model: TranscriptModel) -> np.ndarray:
    """Best score from each state before the first line to each state at the last."""
    best = model.step + model.emit[:, symbol[0]]
    for s in symbol[1:].tolist():
        best = (best[:, :, None] + model.step).max(axis=1) + model.emit[:, s]
    return best


def first_scores(symbol: np.ndarray, model: TranscriptModel) -> np.ndarray:
    best = model.start + model.emit[:, symbol[0]]
    for s in symbol[1:].tolist():
        best = (best[:, None] + model.step).max(axis=0) + model.emit[:, s]
    return best


def decode(symbol: np.ndarray, model: TranscriptModel, before: int | None = None, last: int | None = None) -> np.ndarray:
    """The best states, given the state before the first line and that of the last."""
    best = (model.start if before is None else model.step[before]) + model.emit[:, symbol[0]]
    came = np.zeros((len(symbol), STATES), np.int8)
    for i, s in enumerate(symbol[1:].tolist(), 1):
        ways = best[:, None] + model.step
        came[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + model.emit[:, s]
    out = np.empty(len(symbol), np.int64)
    out[-1] = best.argmax() if last is None else last
    for i in range(len(symbol) - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _number(batches):
    place = 0
    for batch in batches:
        flat = [symbols(_lines(t)) for t in batch.column("text").to_pylist()]
        where = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
        held = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(place, place + batch.num_rows))]
            + [batch.column(c) for c in ("conv_id", "turn", "role", "text")] + [pa.ListArray.from_arrays(pa.array(where), pa.array(held.astype(np.int32)))],
            names=["part", "place", "conv_id", "turn", "role", "text", "symbols"])
        place += batch.num_rows


def ordered(pieces: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = None) -> DataFrame:
    """Pieces in the order of their conversations: (part, place) numbers them."""
    bounded_batches(pieces.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    rows = pieces.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
                         (F.lower(col(role_col).cast("string")) if role_col else F.lit(None).cast("string")).alias("role"), F.monotonically_increasing_id().alias("rid"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["conv_id", "turn", "rid"]
    schema = T.StructType([T.StructField("part", _LONG), T.StructField("place", _LONG), rows.schema["conv_id"], rows.schema["turn"], rows.schema["role"],
                           rows.schema["text"], T.StructField("symbols", T.ArrayType(T.IntegerType()))])
    return staged(rows.repartitionByRange(task_count(pieces.sparkSession, size, 8 << 20, 16), *order).sortWithinPartitions(*order)
                  .select("conv_id", "turn", "role", "text").mapInArrow(_number, schema), "op5-ordered")


def _runs(table: pa.Table):
    """The table in order, and the row ranges of its conversations."""
    table = table.sort_by("place").combine_chunks()
    conv = table.column("conv_id").to_pylist()
    cuts = [0] + [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]] + [len(conv)]
    return table, list(zip(cuts[:-1], cuts[1:]))


def _symbols(table: pa.Table, a: int, b: int) -> np.ndarray:
    return table.column("symbols").slice(a, b - a).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _taught(table: pa.Table) -> pa.Table:
    """Counts (kind, a, b, n): 0 start, 1 step, 2 emission; kind 3 has the states at the edges."""
    table, runs = _runs(table)
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    roles, edge = table.column("role").to_pylist(), [-1, -1]
    sizes = table.column("symbols").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    for k, (a, b) in enumerate(runs):
        before = None
        for i in range(a, b):
            if roles[i] not in ROLES:
                before = None
                continue
            r = 2 * ROLES.index(roles[i])
            state = np.full(sizes[i], r + 1)
            symbol = _symbols(table, i, i + 1)
            opens = int(np.argmax(symbol // 4 % 4 > 0))  # the first line that is not blank
            state[opens] = r
            if opens and before is not None:
                state[:opens] = before // 2 * 2 + 1  # blank lines above belong to the turn before
            np.add.at(emit, (state, symbol), 1)
            np.add.at(step, (state[:-1], state[1:]), 1)
            if before is not None:
                step[before, state[0]] += 1
            elif i == a and k > 0:
                start[state[0]] += 1
            elif i == a:
                edge[0] = int(state[0])
            before = int(state[-1])
        if k == len(runs) - 1 and before is not None:
            edge[1] = before
    rows = [(0, a, 0, start[a]) for a in range(STATES)] + [(1, a, b, step[a, b]) for a in range(STATES) for b in range(STATES)]
    rows += [(2, a, b, emit[a, b]) for a, b in zip(*np.nonzero(emit))]
    part = table.column("part")[0].as_py()
    rows += [(3, part, edge[0], edge[1])]
    kind, a, b, n = zip(*rows)
    conv = [None] * (len(rows) - 1) + [f"{table.column('conv_id')[0].as_py()}\n{table.column('conv_id')[-1].as_py()}"]
    return pa.table({"kind": pa.array(kind, pa.int64()), "a": pa.array(np.array(a, np.int64)), "b": pa.array(np.array(b, np.int64)),
                     "n": pa.array(np.array(n, np.int64)), "conv": pa.array(conv, pa.string())})


def fit(rows: DataFrame) -> TranscriptModel:
    """From ordered pieces with roles; each labelled piece is one turn."""
    counted = staged(rows.groupBy("part").applyInArrow(_taught, "kind long, a long, b long, n long, conv string"), "op5-counts")
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    into = {0: lambda a, b: (start, a), 1: lambda a, b: (step, (a, b)), 2: lambda a, b: (emit, (a, b))}
    for kind, a, b, n in counted.where("kind < 3").groupBy("kind", "a", "b").agg(F.sum("n")).collect():  # states x symbols at most
        array, at = into[kind](a, b)
        array[at] += n
    conv, state = None, None
    for part, first, last, names in counted.where("kind = 3").orderBy("a").select("a", "b", "n", "conv").collect():  # one for each partition
        head, tail = names.split("\n")
        if first >= 0:
            if head != conv:
                start[first] += 1
            elif state is not None and state >= 0:
                step[state, first] += 1
        conv, state = tail, last
    return model_of(start, step, emit)


def _edges(model: TranscriptModel):
    """Matrices of the first and last conversation of a partition."""
    def run(table: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        rows = []
        for k in sorted({0, len(runs) - 1}):
            a, b = runs[k]
            symbol = _symbols(table, a, b)
            rows.append((table.column("part")[0].as_py(), k, len(runs), str(table.column("conv_id")[a].as_py()),
                         [*spread(symbol, model).reshape(-1).tolist(), *first_scores(symbol, model).tolist()]))
        part, k, n, conv, scores = zip(*rows)
        return pa.table({"part": pa.array(part, pa.int64()), "run": pa.array(k, pa.int64()), "runs": pa.array(n, pa.int64()),
                         "conv": pa.array(conv, pa.string()), "scores": pa.array(scores, pa.list_(pa.float64()))})
    return run


def cut_states(rows) -> dict[tuple[int, int], tuple[int | None, int | None]]:
    """(state before, last state) of each (part, run) of a conversation that crosses
    partitions, from rows (part, run, runs, conv, scores) in order."""
    chains, open_at = [], None
    for part, run, runs, conv, scores in rows:
        goes_on = open_at is not None and run == 0 and open_at == conv
        if not goes_on:
            chains.append([])
        chains[-1].append((part, run, np.array(scores)))
        open_at = conv if run == runs - 1 else None
    out = {}
    for chain in chains:
        if len(chain) < 2:
            continue
        best, came = chain[0][2][-STATES:], []
        for _, _, scores in chain[1:]:
            ways = best[:, None] + scores[:-STATES].reshape(STATES, STATES)
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        state = int(best.argmax())
        for i in range(len(chain) - 1, -1, -1):
            before = int(came[i - 1][state]) if i else None
            out[chain[i][:2]] = (before, state)
            state = before
    return out


def _rendered(model: TranscriptModel, cuts: dict):
    def run(table: pa.Table) -> pa.Table:
        table, runs = _runs(table)
        out = []
        texts = table.column("text").to_pylist()
        part = table.column("part")[0].as_py()
        for k, (a, b) in enumerate(runs):
            before, last = cuts.get((part, k), (None, None))
            state, at = decode(_symbols(table, a, b), model, before, last), 0
            for i in range(a, b):
                lines = _lines(texts[i])
                own = state[at:at + len(lines)]
                at += len(lines)
                marks = [0] + [j for j in range(1, len(lines)) if own[j] % 2 == 0] + [len(lines)]
                spans = list(zip(marks[:-1], marks[1:]))
                if len(spans) > 1 and own[0] % 2 and not any(line.strip() for line in lines[:marks[1]]):
                    spans = spans[1:]  # only blank lines above a turn
                for f, (x, y) in enumerate(spans):
                    role, opens = ROLES[own[x] // 2], bool(own[x] % 2 == 0)
                    body = [line[read_line(line, False)[1]:] if j == x and opens else line for j, line in enumerate(lines[x:y], x)]
                    text = "\n".join(body).strip("\n")
                    out.append((i, f, role, opens, y - x, f"<|{role}|>\n{text}\n" if opens else f"{text}\n" if text else ""))
        row, fragment, role, opens, n, text = zip(*out)
        take = pa.array(row, pa.int64())
        return pa.table({"conv_id": table.column("conv_id").take(take), "turn": table.column("turn").take(take), "fragment": pa.array(fragment, pa.int64()),
                         "role": pa.array(role, pa.string()), "opens": pa.array(opens, pa.bool_()), "n_lines": pa.array(n, pa.int64()),
                         "rendered": pa.array(text, pa.string())})
    return run


def render(rows: DataFrame, model: TranscriptModel) -> DataFrame:
    """Ordered pieces as canonical turns: conv_id, turn (of the piece), fragment (of the
    piece), role, opens (a turn starts here), n_lines, rendered.  The texts joined in
    this order are the conversation; a fragment that opens no turn goes on with the
    turn before it.  Blank lines above a turn make no row."""
    edges = rows.groupBy("part").applyInArrow(_edges(model), "part long, run long, runs long, conv string, scores array<double>")
    cuts = cut_states(sorted(tuple(r) for r in edges.collect()))  # at most two for each partition
    schema = T.StructType([rows.schema["conv_id"], rows.schema["turn"], T.StructField("fragment", _LONG), T.StructField("role", T.StringType()),
                           T.StructField("opens", T.BooleanType()), T.StructField("n_lines", _LONG), T.StructField("rendered", T.StringType())])
    return rows.groupBy("part").applyInArrow(_rendered(model, cuts), schema)


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as they would stand in a raw transcript: each turn below a blank
    line, with a speaker marker in a style of the conversation's, and one turn in four
    without one."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.lower(F.coalesce("role", F.lit("user")))
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap(role))
    marker = (F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("["), F.upper(role), F.lit("] ")))
              .when(style == 2, F.concat(F.lit("**"), human, F.lit(":** "))).otherwise(F.concat(F.lit("### "), human, F.lit(": "))))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    return conversations.select("conv_id", "turn", "role", F.concat(F.lit("\n"), F.when(bare, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))).alias("text"))


def chat_turns(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of ``conversations`` parsed and rendered; learns from the
    conversations whose crc32(conv_id) modulo 3 is not 1."""
    raw = raw_transcripts(conversations)
    taught = raw.withColumn("role", F.when(~held_out(F.col("conv_id"), 3, 1), F.col("role")))
    rows = ordered(taught, role_col="role")
    return render(rows, fit(rows))

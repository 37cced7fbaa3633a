"""Operator 11: repair of the structure of conversations by target alignment.

A conversation should read ``(s?(ua)+)?`` in its roles' first letters.  Its turns are
aligned by Wagner-Fischer with each feasible length of that alternating string, within
Ukkonen bands from the incumbent cost, and the backtraced audits are compared
(``turn_alignment``).  Keeping a turn costs 0, giving it the role user or assistant 1,
deleting it 2, inserting an empty turn 5, and a truncated turn that stays 5 more; blank
and duplicate turns have to go.

How it is spread: the turns are range-partitioned by conversation and place, so one
conversation may fill any number of partitions.  A conversation inside one partition is
solved there, in runs of at most ``RUN`` turns.  One that crosses partitions gives, for
each partition, its matrix of least costs between grammar states and the order of the
audits behind them (at most two such rows a partition); joined in order, these fix the
state at each cut, and every partition writes its part of the audit and of the text.
Only the digest of the repaired text, which is sequential by nature, is then computed
by one task for such a conversation, streaming over its parts.  Turns seen earlier are
found by an aggregate, combined before the shuffle, and a join.

Defined results: null roles and texts read as one space; turns are ordered by turn
(nulls first), then role, then SHA-256 of the text; repeated rows follow each other and
all but the first are duplicates; a turn's first fault of blank, duplicate, truncated
counts; a null conv_id is one conversation; a conversation without turns has zeros,
an empty audit and the digest of an empty string; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, staged, task_count
from .turn_alignment import INF, STATES, TAIL, follow, matrix, repaired, runs_of, solve, summary_of, way
from .words import tidy

WHITE = "[\\x20\\x09-\\x0D]"
LEGAL = ("su", "ua", "au")
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and gone, with the faults that crc32 of ``conv_id:turn``
    modulo 20 asks for: 0 drops the row (gone; it stays as a mark that there is such a
    conversation), 1 empties the text, 2 takes its sentence ends, 3 repeats the row, 4
    makes it a user's."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                spaced(role_col).alias("role"), spaced(text_col).alias("text"), fault.alias("fault"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("fault") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _faults(turns: DataFrame, name: str) -> DataFrame:
    """The turns with a digest of their text and the columns blank, late (role and text
    seen earlier) and cut_off, in the order that gives ``rid`` to equal rows."""
    bare = F.regexp_replace("text", f"{WHITE}+$", "")
    rows = staged(turns.select(
        "conv_id", "turn", "role", "text", "gone", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        F.monotonically_increasing_id().alias("rid")), name)
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "rid")
    first = (rows.where("NOT gone AND NOT blank").groupBy("conv_id", "role", "sha").agg(F.min(place).alias("first"))
             .select(F.col("conv_id").alias("c2"), F.col("role").alias("r2"), F.col("sha").alias("s2"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("sha") == F.col("s2"))
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "gone", "sha", "rid", "blank", "cut_off",
                                                 F.coalesce(place > F.col("first"), F.lit(False)).alias("late"))


class _Part:
    """The turns of one conversation in one partition, in order."""

    def __init__(self):
        self.rows: list[tuple] = []  # turn, role, text, fault ("" or a letter of bdt)

    def add(self, turn, role, text, gone, blank, late, cut_off) -> None:
        if not gone:
            self.rows.append((turn, role, text, "b" if blank else "d" if late else "t" if cut_off else ""))

    def turns(self) -> list[tuple]:
        return [(role[:1], fault in ("b", "d"), fault == "t") for _, role, _, fault in self.rows]

    def facts(self) -> dict:
        known = [r[0] for r in self.rows if r[0] is not None]
        initials = [r[1][:1] for r in self.rows]
        faults = [r[3] for r in self.rows]
        return {"rows": len(self.rows), "low": known[0] if known else None, "high": known[-1] if known else None,
                "turns": len(set(known)), "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
                "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))}

    def said(self, audit: str, state: int = 0) -> list[str]:
        return repaired([(r[1], r[2]) for r in self.rows], audit, state)


def _join_facts(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its parts, in order."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    filled = [p for p in parts if p["rows"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:]))
    known = [p for p in filled if p["low"] is not None]
    distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    out["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
    return out


FACTS = ["rows", "low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal"]
_FACT_TYPES = {"first": pa.string(), "last": pa.string()}


def _solved(ordered: DataFrame) -> DataFrame:
    """One row per whole conversation (``whole``: counts, audit, texts), and one for each
    part of a conversation that may go on in another partition (task, place, facts,
    costs, places, and its turns)."""
    id_type = ordered.schema["conv_id"].dataType
    schema = pa.schema(
        [("conv_id", to_arrow_type(id_type)), ("whole", pa.bool_()), ("task", pa.int64()), ("place", pa.int32())]
        + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("said", pa.list_(pa.string()))]
        + [(f"p_{c}", _FACT_TYPES.get(c, pa.int64())) for c in FACTS] + [("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
         ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.string()))])
    columns = ["turn", "role", "text", "gone", "blank", "late", "cut_off"]

    def whole(conv, part: _Part) -> dict:
        cost, audit = solve(part.turns())
        return {"conv_id": conv, "whole": True, "audit": audit, "said": part.said(audit), "cost": cost} | _join_facts([part.facts()])

    def piece(conv, part: _Part, place: int) -> dict:
        pairs = [matrix(run)[1] for run in runs_of(part.turns())]
        costs, places = [], []
        for s in range(STATES):
            ends = follow(pairs, s)
            costs += [e[0] if e else INF for e in ends]
            places += [e[1] if e else 0 for e in ends]
        return {"conv_id": conv, "whole": False, "task": TaskContext.get().partitionId(), "place": place, "costs": costs, "places": places,
                "roles": [r[1] for r in part.rows], "texts": [r[2] for r in part.rows], "faults": [r[3] for r in part.rows],
                } | {f"p_{c}": v for c, v in part.facts().items()}

    def run(batches):
        part, conv, n, out, size = None, None, 0, [], 0
        for batch in batches:
            for c, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(x).to_pylist() for x in columns)):
                if part is None or c != conv:
                    if part is not None:
                        out.append(piece(conv, part, 0) if n == 0 else whole(conv, part))
                        n += 1
                    part, conv = _Part(), c
                part.add(*row)
                size += len(row[2])
                if len(out) >= 1000 or size > 4 << 20:
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if part is not None:
            out.append(piece(conv, part, int(n > 0)))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    facts = ", ".join(f"p_{c} {'string' if c in _FACT_TYPES else 'long'}" for c in FACTS)
    return ordered.select("conv_id", *columns).mapInArrow(
        tidy(run), f"conv_id {id_type.simpleString()}, whole boolean, task long, place int, {', '.join(f'{c} long' for c in COUNTS)}, audit string, "
                   f"said array<string>, {facts}, costs array<long>, places array<int>, roles array<string>, texts array<string>, faults array<string>")


def _chained(parts: DataFrame) -> DataFrame:
    """For each part: the states before and after it that the cheapest repair of the whole
    conversation has, whether it is the last, and the conversation's counts.  A
    conversation has two rows a partition at most, of fixed size."""
    tails = tuple(c for c, _ in TAIL)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["task"], r["place"]))
        ends = follow([(r["costs"], r["places"]) for r in rows], 0)
        cost, _, end = min((e[0] + tails[s], e[1], s) for s, e in enumerate(ends) if e)
        states = way(ends[end][2])
        counts = _join_facts([{c: r[f"p_{c}"] for c in FACTS} for r in rows]) | {"cost": cost}
        out = [{"task": r["task"], "place": r["place"], "before": a, "after": b, "last": r is rows[-1]} | counts for r, a, b in zip(rows, states, states[1:])]
        schema = [("task", pa.int64()), ("place", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]
        return pa.Table.from_pylist(out, pa.schema(schema + [(c, pa.int64()) for c in COUNTS]))

    return (parts.select("conv_id", "task", "place", "costs", "places", *[f"p_{c}" for c in FACTS]).groupBy("conv_id")
            .applyInArrow(run, "task long, place int, before int, after int, last boolean, " + ", ".join(f"{c} long" for c in COUNTS)))


def _written(parts: DataFrame) -> DataFrame:
    """The audit and the repaired turns of each part, given its states."""
    keep = ["conv_id", "task", "place", *COUNTS]

    def run(batches):
        for batch in batches:
            audits, said = [], []
            for r in batch.select(["roles", "texts", "faults", "before", "after", "last"]).to_pylist():
                part = _Part()
                part.rows = [(None, *x) for x in zip(r["roles"], r["texts"], r["faults"])]
                pairs = [matrix(x)[0] for x in runs_of(part.turns())]
                states = way(follow([summary_of(p) for p in pairs], r["before"])[r["after"]][2])
                audit = "".join(p[a][b][1] for p, a, b in zip(pairs, states, states[1:])) + (TAIL[r["after"]][1] if r["last"] else "")
                audits.append(audit)
                said.append(part.said(audit, r["before"]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(audits, pa.string()), pa.array(said, pa.list_(pa.string()))],
                                             [*keep, "audit", "said"])

    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return parts.mapInArrow(tidy(run), ", ".join(f"{c} {types[c]}" for c in keep) + ", audit string, said array<string>")


def _digest(said: Column) -> Column:
    return F.sha2(F.concat_ws("\n", said).cast("binary"), 256)


def _whole_again(written: DataFrame) -> DataFrame:
    """The parts of each conversation put together: the digest runs over them in order."""
    id_type = written.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(id_type))] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, counts, audit, sha, begun = None, None, [], None, False
        done = lambda: pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()} | counts], schema)
        for batch in batches:
            for r in batch.to_pylist():
                if counts is None or r["conv_id"] != conv:
                    if counts is not None:
                        yield done()
                    conv, counts, audit, sha, begun = r["conv_id"], {c: r[c] for c in COUNTS}, [], hashlib.sha256(), False
                audit.append(r["audit"])
                for line in r["said"]:
                    sha.update((b"\n" if begun else b"") + line.encode())
                    begun = True
        if counts is not None:
            yield done()

    return (written.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place")
            .mapInArrow(tidy(run), f"conv_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``turns`` (a boolean column ``gone``, if there is one,
    marks rows that only name a conversation): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    spark = turns.sparkSession
    bounded_batches(spark)
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = _faults(turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                                spaced(role_col).alias("role"), spaced(text_col).alias("text"), gone.alias("gone")), "op11-turns")
    size = turns.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")) + 100)).first()[0] or 0
    order = ["conv_id", "turn", "role", "sha", "rid"]
    ordered = rows.repartitionByRange(task_count(spark, size, least=int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    solved = staged(_solved(ordered), "op11-solved")
    results = solved.where("whole").select("conv_id", *COUNTS, "audit", _digest(F.col("said")).alias("repaired_sha256"))
    cut = solved.where("NOT whole")
    states = _chained(cut)
    pieces = cut.select("conv_id", "task", "place", "roles", "texts", "faults").join(states, ["task", "place"])
    return results.unionByName(_whole_again(_written(pieces)))

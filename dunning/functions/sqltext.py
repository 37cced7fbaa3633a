"""SQL text of expressions made from the catalog.

A long ``F.when`` chain costs a round trip to the JVM for every node of the
expression; one SQL string is parsed there in a single call, so plans with many
catalog look-ups build in a fraction of the time.
"""

from __future__ import annotations


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names(values) -> str:
    """``('a', 'b')`` for IN."""
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def case(pairs, otherwise: str = "NULL") -> str:
    """CASE over (condition, value) texts, first match wins."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def lookup(value: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    """CASE of a value over literal keys; the results are SQL texts."""
    return f"CASE {value} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def filled(template: str, **parts: str) -> str:
    """``concat`` of a text template whose ``{name}`` slots are SQL texts; NULL parts
    read ``None``."""
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += ([quoted(head)] if head else []) + [f"coalesce(CAST({parts[name]} AS STRING), 'None')"]
    out += [quoted(rest)] if rest else []
    return f"concat({', '.join(out)})"

"""Formatting helpers shared by reasons, signals and display tables (SX-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_text(x: Column) -> Column:
    """Thousands separators, 2 decimals (``1,234.50``)."""
    return F.format_number(x, 2)


def as_text(x: Column) -> Column:
    return x.cast("string")


def template(tpl: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text template with Column values.

    The template is split at its slots and rebuilt with ``concat``; NULL parts
    render as the text ``None`` (the domain's texts were produced that way).
    """
    out: list[Column] = []
    rest = tpl
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(F.lit(head))
        out.append(F.coalesce(parts[name].cast("string"), F.lit("None")))
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out) if len(out) > 1 else out[0]


def pct2(x: Column) -> Column:
    """Percent with 2 decimals, half-up on doubles in both engines."""
    return F.floor(x * 100 + 0.5) / 100

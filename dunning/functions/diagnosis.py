"""Failure diagnosis as Column expressions (SX-09..SX-12) and model-response
cleaning / validation (MI-02, MI-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog as C
from . import sqltext as S
from .erv import code_class


def root_cause_from_class(cls: Column) -> Column:
    e = None
    for name, cause in C.CLASS_TO_CAUSE.items():
        e = F.when(cls == name, cause) if e is None else e.when(cls == name, cause)
    return e


def root_cause_from_code(code: Column) -> Column:
    return root_cause_from_class(code_class(code))


def ranking_code_from_cause(cause: Column) -> Column:
    """Substring rules in order over the lower-cased cause text."""
    c = F.lower(F.coalesce(cause, F.lit("")))
    e = None
    for needles, code in C.CAUSE_TEXT_RULES:
        cond = None
        for n in needles:
            cond = c.contains(n) if cond is None else (cond | c.contains(n))
        e = F.when(cond, code) if e is None else e.when(cond, code)
    return e.otherwise(C.CAUSE_TEXT_DEFAULT)


def rules_action(cls: Column, attempts: Column) -> Column:
    """Static rules-only action by code class and attempt number (SX-11)."""
    e = None
    for name, (first, later) in C.RULES_ACTION.items():
        v = F.when(attempts == 0, first).otherwise(later) if first != later else F.lit(first)
        e = F.when(cls == name, v) if e is None else e.when(cls == name, v)
    return e


def fallback_diagnosis(cls: Column, history) -> Column:
    """Struct(root_cause, confidence, recommended_action, reason,
    why_not_alternatives) by code class (see ``code_class``) and whether the
    flipping action is already in ``history`` (array<string>, or a function that
    gives a boolean Column for an action)."""
    has = history if callable(history) else lambda a: F.coalesce(F.array_contains(history, a), F.lit(False))

    def pick(idx: int) -> Column:
        e = None
        for name, (flip, _, first, second) in C.FALLBACK.items():
            if flip is None or second is None:
                v = F.lit(first[idx])
            else:
                v = F.when(has(flip), second[idx]).otherwise(first[idx])
            e = F.when(cls == name, v) if e is None else e.when(cls == name, v)
        return e

    conf = None
    for name, (_, c, _, _) in C.FALLBACK.items():
        v = F.lit(str(c)).cast("decimal(2,1)")
        conf = F.when(cls == name, v) if conf is None else conf.when(cls == name, v)
    return F.struct(
        root_cause_from_class(cls).alias("root_cause"),
        conf.alias("confidence"),
        pick(0).alias("recommended_action"),
        pick(1).alias("reason"),
        pick(2).alias("why_not_alternatives"),
    )


# Model response schema; confidence is read as text and cast later, since a
# numeric string is accepted there.
RESPONSE_SCHEMA = T.StructType([
    T.StructField("root_cause", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("why_not_alternatives", T.StringType()),
])


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def clean_response(text: Column) -> Column:
    """Trim; when it starts with a code fence drop the first and last lines."""
    t = _strip(text)
    fenced = t.startswith("```")
    inner = F.array_join(F.slice(F.split(t, "\n"), 2, F.greatest(F.size(F.split(t, "\n")) - 2, F.lit(0))), "\n")
    return F.when(fenced, _strip(inner)).otherwise(t)


def with_parsed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct ``name`` of the 5 fields of the response in column ``text`` plus
    ``valid``; malformed JSON gives NULL fields.

    Strict JSON: one object from the first to the last character, double quotes
    only, and text fields that are JSON strings (not numbers or objects).  The text is
    cleaned once and parsed once by each parser: every step is a column of its own."""
    p = f"_{name}_"
    inputs = [c for c in df.columns if c != name]
    df = df.withColumn(f"{p}clean", clean_response(F.col(text)))
    # inside brackets, text after the object is a syntax error or a second element
    df = df.withColumn(f"{p}wrapped", F.expr(f"try_parse_json(concat('[', {p}clean, ']'))"))
    df = df.withColumn(f"{p}value", F.expr(f"try_variant_get({p}wrapped, '$[0]', 'variant')"))
    whole = (f"endswith({p}clean, '}}') AND try_variant_get({p}wrapped, '$[1]', 'variant') IS NULL "
             f"AND startswith(schema_of_variant({p}value), 'OBJECT')")
    df = df.withColumn(f"{p}json", F.expr(f"CASE WHEN {whole} THEN {p}clean END"))
    df = df.withColumn(f"{p}j", F.from_json(f"{p}json", RESPONSE_SCHEMA, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}))
    df = df.withColumn(f"{p}conf", F.expr(f"try_cast({p}j.confidence AS DOUBLE)"))
    texts = ("root_cause", "recommended_action", "reason", "why_not_alternatives")
    valid = " AND ".join([f"schema_of_variant(try_variant_get({p}value, '$.{t}', 'variant')) = 'STRING'" for t in texts]
                         + [f"{p}j.root_cause IN {S.names(C.ROOT_CAUSES)}", f"{p}j.recommended_action IN {S.names(C.ACTION_NAMES)}",
                            f"{p}conf IS NOT NULL", f"{p}j.reason IS NOT NULL", f"{p}j.why_not_alternatives IS NOT NULL"])
    packed = (f"named_struct('root_cause', {p}j.root_cause, 'confidence', {p}conf, 'recommended_action', {p}j.recommended_action, "
              f"'reason', {p}j.reason, 'why_not_alternatives', {p}j.why_not_alternatives, 'valid', coalesce({valid}, false))")
    return df.select(*inputs, F.expr(packed).alias(name))

"""SQL-text columns (extraction from model output, shape test, guard)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.text import WS, jtrim

FENCE = "```"
# Substrings that reject a statement (any case), the comment
# openers included.
FORBIDDEN = ["UPDATE", "DELETE", "INSERT", "ALTER", "DROP TABLE", ";--", "/*"]


def _rstrip_semicolons(c: Column) -> Column:
    return F.regexp_replace(c, ";+$", "")


def extract_sql(text: Column) -> Column:
    """Model text -> one SQL statement.

    With fences: the first block (text after a fence) that starts with ``sql``
    (any case, leading blanks ignored) yields the text after its first newline
    (none -> ''); if no block is labelled, the first block. Without fences: the
    whole text. Then strip and drop trailing semicolons.
    """
    t = jtrim(F.coalesce(text, F.lit("")))
    parts = F.split(t, FENCE, -1)
    blocks = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    labelled = F.get(F.filter(blocks, lambda b: F.lower(F.regexp_replace(b, f"^{WS}+", "")).startswith("sql")), 0)
    after_nl = F.when(F.instr(labelled, "\n") > 0, F.substr(labelled, F.instr(labelled, "\n") + 1)).otherwise(F.lit(""))
    from_label = _rstrip_semicolons(jtrim(F.replace(jtrim(after_nl), F.lit(FENCE), F.lit(""))))
    first_block = _rstrip_semicolons(jtrim(F.replace(F.get(parts, 1), F.lit(FENCE), F.lit(""))))
    plain = _rstrip_semicolons(jtrim(F.replace(t, F.lit(FENCE), F.lit(""))))
    fenced = F.when(labelled.isNotNull(), from_label).otherwise(first_block)
    return (F.when(F.coalesce(text, F.lit("")) == "", F.lit(""))
            .when(F.instr(t, FENCE) > 0, fenced).otherwise(plain))


def looks_like_sql(s: Column) -> Column:
    """Contains ``select `` and `` from ``, or starts with ``with ``/``select `` (any case)."""
    t = F.lower(jtrim(F.coalesce(s, F.lit(""))))
    return ((F.instr(t, "select ") > 0) & (F.instr(t, " from ") > 0)) | t.startswith("with ") | t.startswith("select ")


def guard_sql(s: Column) -> Column:
    """TRUE when the statement passes: no forbidden substring, at most one ``;``."""
    low = F.lower(F.coalesce(s, F.lit("")))
    bad = None
    for tok in FORBIDDEN:
        hit = F.instr(low, tok.lower()) > 0
        bad = hit if bad is None else (bad | hit)
    stripped = jtrim(F.coalesce(s, F.lit("")))
    semis = F.length(stripped) - F.length(F.replace(stripped, F.lit(";"), F.lit("")))
    return ~bad & (semis <= 1)


def guard_reason(s: Column) -> Column:
    low = F.lower(F.coalesce(s, F.lit("")))
    r = F.lit(None).cast("string")
    for tok in reversed(FORBIDDEN):
        r = F.when(F.instr(low, tok.lower()) > 0, F.lit(f"forbidden token: {tok}")).otherwise(r)
    stripped = jtrim(F.coalesce(s, F.lit("")))
    semis = F.length(stripped) - F.length(F.replace(stripped, F.lit(";"), F.lit("")))
    return F.coalesce(r, F.when(semis > 1, F.lit("multiple statements")))


def guard_sql_text(sql: str) -> str | None:
    """Driver-side form for one statement string: the rejection reason or None."""
    low = sql.lower()
    for tok in FORBIDDEN:
        if tok.lower() in low:
            return f"forbidden token: {tok}"
    if sql.strip().count(";") > 1:
        return "multiple statements"
    return None

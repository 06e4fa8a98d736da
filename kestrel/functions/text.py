"""Native Column expressions for splitting and normalizing audit lines.

Everything here is a composition of built-in functions, so whole-stage
codegen (or at least JVM-side evaluation) applies; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a script trim sees it: ASCII space classes, Unicode
# separators and the byte-order mark.
WS = r"[\s\p{Z}\x{FEFF}]"
_SEP = "\u0001"


def jtrim(c: Column) -> Column:
    """Trim Unicode whitespace and BOM from both ends (Spark's one-argument trim
    only strips U+0020)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


_OPEN, _CLOSE, _PIPE = "\u0002", "\u0003", "\u0004"
# Marks that a line itself holds are written as this character and a letter until its cells are cut.
_ESCAPE = "\u0005"
_ESCAPED = [(_ESCAPE, _ESCAPE + "e"), (_OPEN, _ESCAPE + "o"), (_CLOSE, _ESCAPE + "c"), (_PIPE, _ESCAPE + "p")]


def _escape_marks(line: Column) -> Column:
    out = line
    for mark, written in _ESCAPED:
        out = F.replace(out, F.lit(mark), F.lit(written))
    return F.when(line.rlike(f"[{_OPEN}-{_ESCAPE}]"), out).otherwise(line)


def protect_quoted(line: Column) -> Column:
    """Resolve double quotes on the whole line with scalar regex passes (no lambdas).

    Quote state flips at every quote character, so a quoted run is a quote,
    any non-quote text, and an optional closing quote. Runs are marked with
    control characters; two runs that touch (``""`` inside quotes) leave one
    literal quote; a ``|`` inside a run becomes a placeholder so that only
    pipes outside quotes separate cells; then the marks are dropped. Such
    control characters of the line itself are escaped first. Restore both
    per cell with ``unprotect``.
    """
    line = _escape_marks(line)
    m = F.regexp_replace(line, '"([^"]*)"?', f"{_OPEN}$1{_CLOSE}")
    m = F.regexp_replace(m, f"{_CLOSE}{_OPEN}", '"')
    m = F.regexp_replace(m, rf"\|(?=[^{_OPEN}{_CLOSE}]*{_CLOSE})", _PIPE)
    m = F.regexp_replace(m, f"[{_OPEN}{_CLOSE}]", "")
    return F.when(F.instr(line, '"') == 0, line).otherwise(m)


def split_cells(protected: Column) -> Column:
    """Split a protected line on ``|``; whitespace around every cell is trimmed.

    Whitespace around separators is removed by one ``regexp_replace`` (its
    pattern is compiled once per task) so that the split itself is on a
    single literal character (no per-row pattern compilation).
    """
    return F.split(F.regexp_replace(jtrim(protected), rf"{WS}*\|{WS}*", "|"), r"\|", -1)


def unprotect(c: Column) -> Column:
    """Placeholder -> literal ``|`` inside one cell, and the line's own control characters back."""
    pipes = F.translate(c, _PIPE, "|")
    out = pipes
    for mark, written in reversed(_ESCAPED):
        out = F.replace(out, F.lit(written), F.lit(mark))
    return F.when(F.instr(c, _ESCAPE) == 0, pipes).otherwise(out)


def split_pipes_quoted(line: Column) -> Column:
    """Cells of a line: ``|`` outside double quotes separates, quotes are dropped,
    ``""`` inside quotes is one quote, each cell trimmed."""
    return F.transform(split_cells(protect_quoted(line)), unprotect)


def coerce_nine(cells: Column, n: Column | None = None) -> Column:
    """Force an array of cells to exactly nine.

    More than nine: the first three, then the middle re-joined with ``|`` as
    the message, then the last five (reason COERCED). Fewer: right-pad with
    ``''`` (reason PADDED). Returns struct<cols: array<string>, reason: string>.
    """
    n = F.size(cells) if n is None else n
    merged = F.concat(
        F.slice(cells, 1, 3),
        F.array(F.array_join(F.slice(cells, F.lit(4), F.greatest(n - 8, F.lit(0))), "|")),
        F.slice(cells, F.greatest(n - 4, F.lit(1)), F.lit(5)),
    )
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(9) - n, F.lit(0))))
    cols = F.when(n == 9, cells).when(n > 9, merged).otherwise(padded)
    reason = F.when(n == 9, F.lit("")).when(n > 9, F.lit("COERCED")).otherwise(F.lit("PADDED"))
    return F.struct(cols.alias("cols"), reason.alias("reason"))


def norm_header(line: Column) -> Column:
    """Header line -> normalized column names (trim, whitespace runs to '_', drop non-word, lower)."""
    names = F.transform(
        F.split(line, r"\|", -1),
        lambda h: F.lower(F.regexp_replace(F.regexp_replace(jtrim(h), rf"{WS}+", "_"), r"[^A-Za-z0-9_]", "")),
    )
    return names


def present(c: Column) -> Column:
    """Shared predicate: NULL or blank-after-trim is missing."""
    return c.isNotNull() & (F.trim(c) != "")


def nz(c: Column) -> Column:
    """COALESCE(c, 0) > 0."""
    return F.coalesce(c, F.lit(0)) > 0

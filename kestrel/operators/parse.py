"""P16 parse_log: raw lines -> normalized nine cells + derived columns.

A narrow chain of projections (no shuffle): split with quote handling, trim,
force nine cells, derive fields, flag session starts and ends. Intermediate
arrays are named columns so each is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import extract as X
from kestrel.functions.text import coerce_nine, jtrim, norm_header, protect_quoted, split_cells, unprotect
from kestrel.functions.timefmt import parse_ts, time_parts
from kestrel.schema import BASE_COLUMNS

KEY = ["file", "blk", "ord"]

# Names the parse job appends after the header cells (the
# derived first-words column is named ``action`` there, like the 6th cell).
APPENDED_NAMES = ["recipe_id", "recipe_name", "material_name", "material_id",
                  "name1", "name2", "username", "action",
                  "session_start", "session_end", "session_duration"]
HEADER_NAMES = ["user_id", "id", "subseq_id", "message", "audit_time", "action", "type", "label",
                "version"] + APPENDED_NAMES


def parse_log(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    """DataFrame(file, blk, ord, line, hdr) -> parsed rows.

    Output: file, blk, ord, reason, the nine cells (strings; ``audit_time`` as
    the trimmed text), eight derived strings, and engine columns ``ts``
    (parsed audit time), ``skey``, ``is_start``, ``is_end``, ``is_auto``.
    Header rows and empty lines are dropped. With ``keep_bad`` a column
    ``raw_line`` holds the whole line where its time is given but unreadable.
    """
    body = lines.filter(~F.col("hdr") & F.col("line").isNotNull() & (F.col("line") != ""))
    raw = [F.col("line").alias("raw_line")] if keep_bad else []
    kept = ["raw_line"] if keep_bad else []
    b = body.select(*KEY, *raw, split_cells(protect_quoted(F.col("line"))).alias("cells"))
    c = b.select(*KEY, *kept, "cells", F.size("cells").alias("n"))
    d = c.select(*KEY, *kept, coerce_nine(F.col("cells"), F.col("n")).alias("n9"))
    e = d.select(*KEY, *kept, F.col("n9.reason").alias("reason"),
                 *[unprotect(F.get(F.col("n9.cols"), i)).alias(col) for i, col in enumerate(BASE_COLUMNS)])
    msg = F.col("message")
    f = e.select(
        "*",
        X.recipe_id(msg).alias("recipe_id"),
        X.recipe_name(F.col("type"), F.col("label")).alias("recipe_name"),
        X.material_name(msg).alias("material_name"),
        X.material_id(msg).alias("material_id"),
        F.regexp_extract("user_id", X.USER_CELL, 1).alias("_m1"),
        jtrim(F.regexp_extract("user_id", X.USER_CELL, 2)).alias("username"),
        X.action_derived(msg).alias("action_derived"),
        time_parts(F.col("audit_time")).alias("_time"),
        X.is_start(msg).alias("is_start"),
        X.is_end(msg).alias("is_end"),
        X.is_auto_end(msg).alias("is_auto"),
    )
    g = f.select("*", parse_ts(F.col("audit_time"), F.col("_time")).alias("ts"), F.when(F.col("_m1") != "", jtrim(F.col("_m1"))).otherwise(F.col("user_id")).alias("_name"))
    h = g.select("*", F.instr("_name", " ").alias("_sp"))
    name1 = F.when(F.col("_sp") == 0, F.col("_name")).otherwise(
        jtrim(F.substring(F.col("_name"), F.lit(1), F.col("_sp") - 1)))
    name2 = F.when(F.col("_sp") == 0, F.lit("")).otherwise(jtrim(F.substr(F.col("_name"), F.col("_sp") + 1)))
    return h.select(
        "file", "blk", "ord", "reason",
        *BASE_COLUMNS,
        "recipe_id", "recipe_name", "material_name", "material_id",
        name1.alias("name1"), name2.alias("name2"), "username", "action_derived",
        "ts",
        X.session_key(F.col("username"), F.col("user_id"), F.col("recipe_id"),
                      F.col("recipe_name")).alias("skey"),
        "is_start", "is_end", "is_auto",
        *([F.when(F.col("ts").isNull() & (F.col("audit_time") != ""), F.col("raw_line")).alias("raw_line")] if keep_bad else []),
    )


def header_names(lines: DataFrame) -> DataFrame:
    """P1 norm_header: per file, the normalized header names plus the eleven appended names.

    Two columns end up named ``action``; the loader renames them by position
    (6th -> ``action_raw``, 17th -> ``action_derived``).
    """
    h = lines.filter(F.col("hdr"))
    return h.select(
        "file",
        F.concat(norm_header(F.col("line")), F.array(*[F.lit(c) for c in APPENDED_NAMES])).alias("columns"),
    )

"""Load side: parsed rows -> typed log table; staged-file alignment and coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.timefmt import iso_utc, parse_ts
from kestrel.schema import AUDIT_COLUMNS, AUDIT_LOG_SCHEMA, INT_COLUMNS, TIMESTAMP_COLUMNS


def _nz_str(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("")).alias(c)


def to_audit_log(paired: DataFrame) -> DataFrame:
    """Typed log rows: empty text -> NULL, times typed, plus engine columns.

    ``audit_month`` (``YYYY-MM`` of audit_time) is the partition column of the
    stored table.
    """
    cols = []
    for c in AUDIT_COLUMNS:
        if c == "audit_time":
            cols.append(F.col("ts").alias("audit_time"))
        elif c in ("session_start", "session_end", "session_duration"):
            cols.append(F.col(c))
        else:
            cols.append(_nz_str(c))
    return paired.select(
        *cols, "file", "blk", "ord", F.nullif(F.col("reason"), F.lit("")).alias("reason"),
        F.date_format("ts", "yyyy-MM").alias("audit_month"))


def to_sheet(paired: DataFrame) -> DataFrame:
    """The parsed sheet as the parse job writes it: 20 string cells, '' when missing."""
    out = []
    for c in AUDIT_COLUMNS:
        if c in ("session_start", "session_end"):
            out.append(F.coalesce(iso_utc(F.col(c)), F.lit("")).alias(c))
        elif c == "session_duration":
            out.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
        else:
            out.append(F.col(c))
    return paired.select("file", "ord", "reason", *out)


# ---- staged-file alignment (I1-I4) ----

def align_schema(df: DataFrame, extra_keep: tuple[str, ...] = ()) -> DataFrame:
    """The fixed 20 columns in order; missing -> NULL, extras dropped (all as raw strings)."""
    have = set(df.columns)
    sel = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
           for c in AUDIT_COLUMNS]
    return df.select(*sel, *[c for c in extra_keep if c in have])


def coerce_ts(c: Column) -> Column:
    """Text -> TIMESTAMP (UTC), bad -> NULL (per row)."""
    return parse_ts(c)


def coerce_int(c: Column) -> Column:
    """I4: text -> INT, bad or fractional -> NULL."""
    return F.trim(c).try_cast("int")


def coerce_types(aligned: DataFrame) -> DataFrame:
    """I2+I3+I4: raw string columns -> the typed log schema."""
    out = []
    for f in AUDIT_LOG_SCHEMA.fields:
        c = F.nullif(F.col(f.name), F.lit(""))
        if f.name in TIMESTAMP_COLUMNS:
            out.append(coerce_ts(c).alias(f.name))
        elif f.name in INT_COLUMNS:
            out.append(coerce_int(c).alias(f.name))
        else:
            out.append(c.alias(f.name))
    keep = [c for c in aligned.columns if c not in AUDIT_COLUMNS]
    return aligned.select(*out, *keep)


def load_rejects(aligned: DataFrame) -> DataFrame:
    """Cells with non-empty source text that became NULL when typed."""
    checks = []
    for c in list(TIMESTAMP_COLUMNS) + list(INT_COLUMNS):
        raw = F.nullif(F.trim(F.col(c)), F.lit(""))
        typed = coerce_ts(raw) if c in TIMESTAMP_COLUMNS else coerce_int(raw)
        checks.append(F.when(raw.isNotNull() & typed.isNull(),
                             F.struct(F.lit(c).alias("column"), raw.alias("raw_value"))))
    keep = [c for c in ("file", "ord") if c in aligned.columns]
    x = aligned.select(*keep, F.explode(F.filter(F.array(*checks), lambda s: s.isNotNull())).alias("bad"))
    return x.select(*keep, "bad.column", "bad.raw_value")


def load_summary(loaded: DataFrame) -> DataFrame:
    """Rows per file plus a grand-total row (file NULL)."""
    return loaded.rollup("file").agg(F.count(F.lit(1)).alias("rows"))

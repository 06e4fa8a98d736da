"""Q01-Q27: the report catalogue over the typed log table.

Each report is ``DataFrame -> DataFrame`` over ``audit_log`` rows. Predicates
are plain column expressions, so Parquet scans prune columns and push simple
comparisons; time windows also add the implied ``audit_month`` partition
predicate. Distinct counts use two-phase partial aggregation; top-n uses
TakeOrderedAndProject. Ties under a limit are broken by extra sort keys, and
NULL placement is always explicit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import nz, present
from kestrel.schema import AUDIT_COLUMNS, TIMESTAMP_COLUMNS

# The recipe code words and report defaults.
GENERAL_CODE = "GR"
SITE_CODE = "SR"


def like_escape(x: str) -> str:
    """Escape LIKE metacharacters so ``x`` matches literally (escape char ``\\``)."""
    return x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def icontains(c: Column, kw: str) -> Column:
    return c.ilike(f"%{like_escape(kw)}%")


def match_names_pred(c: Column, mode: str, x: str) -> Column:
    """Q26: starts with / ends with / contains, any case."""
    e = like_escape(x)
    pat = {"starts": f"{e}%", "ends": f"%{e}", "contains": f"%{e}%"}[mode]
    return c.ilike(pat)


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp")


def _last_month(b: str) -> str:
    """``YYYY-MM`` of the last instant before the exclusive bound ``b``."""
    end = _dt.datetime.fromisoformat(b.replace("T", " ").replace("Z", ""))
    return (end - _dt.timedelta(microseconds=1)).strftime("%Y-%m")


def window_pred(a: str, b: str) -> Column:
    """audit_time in [a, b) plus the implied partition predicate on audit_month."""
    cond = (F.col("audit_time") >= _ts(a)) & (F.col("audit_time") < _ts(b))
    return cond & (F.col("audit_month") >= F.lit(a[:7])) & (F.col("audit_month") <= F.lit(_last_month(b)))


def hours(c: Column | None = None) -> Column:
    c = F.col("session_duration") if c is None else c
    return F.sum(c).cast("double") / 3600.0


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps out as TIMESTAMP_NTZ (UTC wall clock) for engine-neutral results."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in TIMESTAMP_COLUMNS else F.col(c)
                       for c in df.columns])


# ---- Q01-Q06: the six synthesized-question templates ----

def total_time_keyword(t: DataFrame, kw: str) -> DataFrame:
    f = t.filter(icontains(F.col("recipe_name"), kw) & nz(F.col("session_duration")))
    return f.agg(F.sum("session_duration").cast("bigint").alias("total_seconds"),
                 hours().alias("total_hours"))


def count_recipes_keyword(t: DataFrame, kw: str) -> DataFrame:
    f = t.filter(F.col("recipe_id").isNotNull() & (F.col("recipe_id") != "")
                 & icontains(F.col("recipe_name"), kw))
    return f.agg(F.countDistinct("recipe_id").alias("unique_recipes"))


def latest_recipe_rows(t: DataFrame, n: int) -> DataFrame:
    f = t.filter((F.trim(F.lower("type")) == "recipe") & nz(F.col("session_duration")))
    o = f.orderBy(F.col("audit_time").desc_nulls_first(), F.col("id").asc_nulls_first(),
                  F.col("subseq_id").asc_nulls_first()).limit(n)
    return ntz(o.select(*AUDIT_COLUMNS))


def top_recipes_events(t: DataFrame, n: int, window: tuple[str, str] | None = None) -> DataFrame:
    f = t.filter(F.col("recipe_id").isNotNull() & (F.col("recipe_id") != ""))
    if window:
        f = f.filter(window_pred(*window))
    g = f.groupBy("recipe_id", "recipe_name").agg(F.count(F.lit(1)).alias("events"))
    return g.orderBy(F.col("events").desc(), F.col("recipe_id").asc_nulls_first(),
                     F.col("recipe_name").asc_nulls_first()).limit(n)


def user_time_keyword(t: DataFrame, user: str, kw: str, a: str, b: str) -> DataFrame:
    f = t.filter((F.col("username") == user) & icontains(F.col("recipe_name"), kw)
                 & nz(F.col("session_duration")) & window_pred(a, b))
    return f.agg(hours().alias("total_hours"))


def list_recipes_nomatch(t: DataFrame, kw: str) -> DataFrame:
    """Q06: keyword followed by two literal question marks; usually empty (typed)."""
    f = t.filter(F.col("recipe_id").isNotNull() & (F.col("recipe_id") != "")
                 & icontains(F.col("recipe_name"), kw + "??"))
    return f.select("recipe_id", "recipe_name").distinct().orderBy(
        F.col("recipe_id").asc_nulls_first(), F.col("recipe_name").asc_nulls_first())


# ---- Q07-Q12: recipe counts and lists ----

def _trimmed_present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def _code_pred(code: str, any_case: bool) -> Column:
    return F.col("recipe_name").rlike(f"(?i){code}") if any_case else F.col("recipe_name").contains(code)


def count_recipe_ids(t: DataFrame, code: str | None = None, any_case: bool = True,
                     alias: str = "total_recipes") -> DataFrame:
    f = t.filter(_trimmed_present("recipe_id"))
    if code:
        f = f.filter(_code_pred(code, any_case))
    return f.agg(F.countDistinct(F.trim("recipe_id")).alias(alias))


def list_recipe_names(t: DataFrame, code: str | None = None, any_case: bool = True,
                      n: int | None = None) -> DataFrame:
    f = t.filter(_trimmed_present("recipe_name"))
    if code:
        f = f.filter(_code_pred(code, any_case))
    d = f.select(F.trim("recipe_name").alias("recipe_name")).distinct().orderBy("recipe_name")
    return d.limit(n) if n else d


def count_general_recipes(t: DataFrame) -> DataFrame:
    return count_recipe_ids(t, GENERAL_CODE, True, "total_general_recipes")


def list_general_recipes(t: DataFrame) -> DataFrame:
    return list_recipe_names(t, GENERAL_CODE, True)


def count_site_recipes(t: DataFrame) -> DataFrame:
    return count_recipe_ids(t, SITE_CODE, True, "total_site_recipes")


def list_site_recipes(t: DataFrame) -> DataFrame:
    return list_recipe_names(t, SITE_CODE, True)


def count_general_recipes_upper(t: DataFrame) -> DataFrame:
    """Q12: the written rule -- upper-case ``GR`` as a case-sensitive substring."""
    return count_recipe_ids(t, GENERAL_CODE, False, "total_general_recipes")


def count_site_recipes_upper(t: DataFrame) -> DataFrame:
    return count_recipe_ids(t, SITE_CODE, False, "total_site_recipes")


# ---- Q13-Q17: hours and time windows ----

def hours_keyword(t: DataFrame, kw: str, window: tuple[str, str] | None = None) -> DataFrame:
    f = t.filter(icontains(F.col("recipe_name"), kw) & nz(F.col("session_duration")))
    if window:
        f = f.filter(window_pred(*window))
    return f.agg(hours().alias("total_hours"))


def date_window(d1: str, d2: str) -> tuple[str, str]:
    """Inclusive dates -> [d1, d2 + 1 day)."""
    end = _dt.date.fromisoformat(d2) + _dt.timedelta(days=1)
    return (f"{d1} 00:00:00", f"{end.isoformat()} 00:00:00")


def year_window(y: int) -> tuple[str, str]:
    return (f"{y:04d}-01-01 00:00:00", f"{y + 1:04d}-01-01 00:00:00")


def quarter_window(y: int, q: int) -> tuple[str, str]:
    m = 3 * (q - 1) + 1
    end_y, end_m = (y + 1, 1) if q == 4 else (y, m + 3)
    return (f"{y:04d}-{m:02d}-01 00:00:00", f"{end_y:04d}-{end_m:02d}-01 00:00:00")


def hours_keyword_window(t: DataFrame, kw: str, d1: str, d2: str) -> DataFrame:
    return hours_keyword(t, kw, date_window(d1, d2))


def hours_keyword_year(t: DataFrame, kw: str, y: int) -> DataFrame:
    return hours_keyword(t, kw, year_window(y))


def hours_keyword_quarter(t: DataFrame, kw: str, y: int, q: int) -> DataFrame:
    return hours_keyword(t, kw, quarter_window(y, q))


def top_recipes_events_window(t: DataFrame, n: int, a: str, b: str) -> DataFrame:
    return top_recipes_events(t, n, (a, b))


# ---- Q18-Q27: counts, users, smoke reports, patterns ----

def count_recipe_sessions(t: DataFrame) -> DataFrame:
    f = t.filter((F.trim(F.lower("type")) == "recipe") & nz(F.col("session_duration")))
    return f.agg(F.count(F.lit(1)).alias("recipe_sessions"))


def count_recipe_names(t: DataFrame) -> DataFrame:
    f = t.filter(_trimmed_present("recipe_name"))
    return f.agg(F.countDistinct(F.trim("recipe_name")).alias("total_recipe_names"))


def list_users(t: DataFrame, n: int | None = None) -> DataFrame:
    d = t.filter(_trimmed_present("user_id")).select("user_id").distinct().orderBy("user_id")
    return d.limit(n) if n else d


def first_n_users(t: DataFrame, n: int) -> DataFrame:
    return list_users(t, n)


def first_n_recipes(t: DataFrame, n: int) -> DataFrame:
    return list_recipe_names(t, None, True, n)


def count_users(t: DataFrame) -> DataFrame:
    return t.filter(_trimmed_present("user_id")).agg(F.countDistinct("user_id").alias("total_users"))


def total_records(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("total_records"))


def sample_recipe_rows(t: DataFrame, n: int) -> DataFrame:
    """Q24: ``type = 'recipe'`` exactly (case-sensitive), duration > 0; ordered by id to be testable."""
    f = t.filter((F.col("type") == "recipe") & (F.col("session_duration") > 0))
    return ntz(f.orderBy(F.col("id").asc_nulls_first(), F.col("subseq_id").asc_nulls_first())
               .limit(n).select(*AUDIT_COLUMNS))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Q25: exact row count per table, by name."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_names(t: DataFrame, mode: str, x: str) -> DataFrame:
    f = t.filter(_trimmed_present("recipe_name") & match_names_pred(F.col("recipe_name"), mode, x))
    return f.select(F.trim("recipe_name").alias("recipe_name")).distinct().orderBy("recipe_name")


def present_columns(t: DataFrame) -> DataFrame:
    """Q27: the shared ``present`` predicate, counted per text column."""
    cols = [c for c in AUDIT_COLUMNS if c not in TIMESTAMP_COLUMNS and c != "session_duration"]
    return t.agg(*[F.count(F.when(present(F.col(c)), F.lit(1))).alias(f"{c}_present") for c in cols])

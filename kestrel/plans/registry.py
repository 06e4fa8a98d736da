"""Registry of runnable queries (Spark) and their DuckDB oracle SQL.

Every query reads the given tables or data Spark derives from them (the raw
log is generated from ``events``). Report queries read the materialized log
table of ``kestrel.plans.catalog``; parse and pairing queries run their own
work over the whole derived input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import reports as R
from kestrel.operators import tablestats as TS
from kestrel.operators.parse import HEADER_NAMES, header_names, parse_log
from kestrel.operators.sessions import open_sessions, session_pairs
from kestrel.plans.catalog import audit_log, parsed_table
from kestrel.plans.oracle import with_log
from kestrel.schema import AUDIT_COLUMNS
from kestrel.session import scratch_dir
from kestrel.sources.fixture import audit_lines

# Default report parameters, shared by queries() and oracle_sql().
P = {
    "kw": "buffer",
    "kw2": "Column",
    "user": "u106",
    "user_window": ("2024-01-08 00:00:00", "2024-01-22 00:00:00"),
    "window": ("2024-01-08 00:00:00", "2024-01-15 00:00:00"),
    "d1": "2024-01-08",
    "d2": "2024-01-14",
    "year": 2024,
    "quarter": 1,
    "n": 10,
    "n_latest": 100,
    "n_sample": 50,
    "part_rows": 1000,
    "starts": "gr",
    "ends": "9",
    "contains": "mix",
}

GIVEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

Query = Callable[[SparkSession, str], DataFrame]


def _log(fn) -> Query:
    return lambda spark, sf: fn(audit_log(spark, sf))


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


PARSED_STRINGS = ["user_id", "id", "subseq_id", "message", "action_raw", "type", "label", "version",
                  "recipe_id", "recipe_name", "material_name", "material_id",
                  "name1", "name2", "username", "action_derived"]


def q_parse_log(spark: SparkSession, sf: str) -> DataFrame:
    p = parse_log(audit_lines(spark, sf))
    return p.select("file", "ord", "reason", *PARSED_STRINGS, F.col("ts").cast("timestamp_ntz").alias("audit_ts"))


def q_parse_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed_table(spark, sf)
    return p.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("rows"))


def q_norm_header(spark: SparkSession, sf: str) -> DataFrame:
    from kestrel.plans.registry_io import scanned_lines
    h = header_names(scanned_lines(spark, sf))
    return h.select("file", F.array_join("columns", ",").alias("columns"))


def q_pair_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = session_pairs(parsed_table(spark, sf))
    return s.select("file", "start_ord", "end_ord", _ntz("session_start"), _ntz("session_end"),
                    "session_duration")


def q_open_sessions(spark: SparkSession, sf: str) -> DataFrame:
    o = open_sessions(parsed_table(spark, sf))
    return o.select("file", "ord", "skey", F.col("ts").cast("timestamp_ntz").alias("session_start"))


def q_audit_log(spark: SparkSession, sf: str) -> DataFrame:
    t = audit_log(spark, sf)
    return R.ntz(t.select(*AUDIT_COLUMNS, "file", "ord"))


def q_table_stats(spark: SparkSession, sf: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf}/{name}.parquet") for name in GIVEN_TABLES}
    tables["audit_log"] = audit_log(spark, sf)
    return R.table_stats(tables)


def q_table_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """The log laid down in two lots: analyzed after the first, grown by the second, analyzed again."""
    t = audit_log(spark, sf).select("id", "audit_time", "session_duration")
    early = F.coalesce(F.col("audit_time") < F.lit(P["window"][0]).cast("timestamp"), F.lit(False))
    path, report = scratch_dir(spark, "estimates"), scratch_dir(spark, "estimates_report")
    name = "log_" + uuid.uuid4().hex

    def note(phase):
        # Written at once: plans over the same folder and name look alike to Spark, whatever lies there by now.
        both = TS.table_estimates(spark, {name: path}).join(R.table_stats({name: spark.read.parquet(path)}), "table_name")
        both.select(F.lit(phase).alias("phase"), "estimated_rows", "row_count", "stale").write.mode("append").parquet(report)

    t.filter(early).write.mode("append").parquet(path)
    TS.analyze_table(spark, name, path)
    note("loaded")
    t.filter(~early).write.mode("append").parquet(path)
    note("grown")
    TS.analyze_table(spark, name, path)
    note("analyzed")
    spark.sql(f"DROP TABLE `{name}`")  # the name only: the files are not the catalogue's
    return spark.read.parquet(report)


def build_queries() -> dict[str, Query]:
    kw, n = P["kw"], P["n"]
    q: dict[str, Query] = {
        # parse and sessions
        "parse_log": q_parse_log,
        "parse_quality": q_parse_quality,
        "norm_header": q_norm_header,
        "pair_sessions": q_pair_sessions,
        "open_sessions": q_open_sessions,
        "audit_log": q_audit_log,
        # reports
        "total_time_keyword": _log(lambda t: R.total_time_keyword(t, kw)),
        "count_recipes_keyword": _log(lambda t: R.count_recipes_keyword(t, kw)),
        "latest_recipe_rows": _log(lambda t: R.latest_recipe_rows(t, P["n_latest"])),
        "top_recipes_events": _log(lambda t: R.top_recipes_events(t, n)),
        "user_time_keyword": _log(lambda t: R.user_time_keyword(t, P["user"], kw, *P["user_window"])),
        "list_recipes_nomatch": _log(lambda t: R.list_recipes_nomatch(t, kw)),
        "count_recipe_ids": _log(R.count_recipe_ids),
        "count_general_recipes": _log(R.count_general_recipes),
        "list_general_recipes": _log(R.list_general_recipes),
        "count_site_recipes": _log(R.count_site_recipes),
        "list_site_recipes": _log(R.list_site_recipes),
        "count_general_recipes_upper": _log(R.count_general_recipes_upper),
        "count_site_recipes_upper": _log(R.count_site_recipes_upper),
        "hours_keyword": _log(lambda t: R.hours_keyword(t, kw)),
        "hours_keyword2": _log(lambda t: R.hours_keyword(t, P["kw2"])),
        "hours_keyword_window": _log(lambda t: R.hours_keyword_window(t, kw, P["d1"], P["d2"])),
        "hours_keyword_year": _log(lambda t: R.hours_keyword_year(t, kw, P["year"])),
        "hours_keyword_quarter": _log(lambda t: R.hours_keyword_quarter(t, kw, P["year"], P["quarter"])),
        "top_recipes_events_window": _log(lambda t: R.top_recipes_events_window(t, n, *P["window"])),
        "count_recipe_sessions": _log(R.count_recipe_sessions),
        "count_recipe_names": _log(R.count_recipe_names),
        "list_users": _log(R.list_users),
        "first_n_users": _log(lambda t: R.first_n_users(t, n)),
        "first_n_recipes": _log(lambda t: R.first_n_recipes(t, n)),
        "count_users": _log(R.count_users),
        "total_records": _log(R.total_records),
        "sample_recipe_rows": _log(lambda t: R.sample_recipe_rows(t, P["n_sample"])),
        "table_stats": q_table_stats,
        "table_estimates": q_table_estimates,
        "match_names_starts": _log(lambda t: R.match_names(t, "starts", P["starts"])),
        "match_names_ends": _log(lambda t: R.match_names(t, "ends", P["ends"])),
        "match_names_contains": _log(lambda t: R.match_names(t, "contains", P["contains"])),
        "present_columns": _log(R.present_columns),
    }
    from kestrel.plans import registry_answers, registry_eval, registry_io, registry_stream, registry_synth
    q.update(registry_eval.QUERIES)
    q.update(registry_io.QUERIES)
    q.update(registry_stream.QUERIES)
    q.update(registry_answers.QUERIES)
    q.update(registry_synth.QUERIES)
    return q


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)
# ---------------------------------------------------------------------------

_COLS20 = ", ".join(AUDIT_COLUMNS)
_HOURS = "CAST(SUM(session_duration) AS DOUBLE) / 3600.0"
_NZ = "COALESCE(session_duration, 0) > 0"


def _win(a: str, b: str) -> str:
    return f"audit_time >= TIMESTAMP '{a}' AND audit_time < TIMESTAMP '{b}'"


def _count_ids(alias: str, cond: str = "") -> str:
    return with_log(f"SELECT COUNT(DISTINCT TRIM(recipe_id)) AS {alias} FROM audit_log "
                    f"WHERE recipe_id IS NOT NULL AND TRIM(recipe_id) <> ''{cond}")


def _list_names(cond: str = "", limit: str = "") -> str:
    return with_log("SELECT DISTINCT TRIM(recipe_name) AS recipe_name FROM audit_log "
                    f"WHERE recipe_name IS NOT NULL AND TRIM(recipe_name) <> ''{cond} "
                    f"ORDER BY recipe_name{limit}")


def _hours_kw(kw: str, window: tuple[str, str] | None = None) -> str:
    w = f" AND {_win(*window)}" if window else ""
    return with_log(f"SELECT {_HOURS} AS total_hours FROM audit_log "
                    f"WHERE recipe_name ILIKE '%{kw}%' AND {_NZ}{w}")


def _top(n: int, window: tuple[str, str] | None = None) -> str:
    w = f" AND {_win(*window)}" if window else ""
    return with_log("SELECT recipe_id, recipe_name, COUNT(*) AS events FROM audit_log "
                    f"WHERE recipe_id IS NOT NULL AND recipe_id <> ''{w} "
                    "GROUP BY recipe_id, recipe_name "
                    f"ORDER BY events DESC, recipe_id ASC NULLS FIRST, recipe_name ASC NULLS FIRST LIMIT {n}")


def build_oracle() -> dict[str, str]:
    kw, n = P["kw"], P["n"]
    parsed_cols = ", ".join(f"COALESCE({c}, '') AS {c}" for c in PARSED_STRINGS)
    present_cols = [c for c in AUDIT_COLUMNS if c not in ("audit_time", "session_start", "session_end",
                                                          "session_duration")]
    o = {
        "parse_log": with_log(f"SELECT file, ord, COALESCE(reason, '') AS reason, {parsed_cols}, "
                              "audit_time AS audit_ts FROM rows1"),
        "parse_quality": with_log("SELECT file, COALESCE(reason, '') AS reason, COUNT(*) AS rows "
                                  "FROM rows1 GROUP BY 1, 2"),
        "norm_header": with_log("SELECT DISTINCT file, '" + ",".join(HEADER_NAMES) + "' AS columns FROM rows0"),
        "pair_sessions": with_log("SELECT file, start_ord, end_ord, session_start, session_end, "
                                  "session_duration FROM sessions"),
        "open_sessions": with_log("SELECT st.file, st.start_ord AS ord, st.skey, st.start_ts AS session_start "
                                  "FROM st WHERE NOT EXISTS (SELECT 1 FROM sessions s "
                                  "WHERE s.file = st.file AND s.start_ord = st.start_ord)"),
        "audit_log": with_log(f"SELECT {_COLS20}, file, ord FROM audit_log"),
        "total_time_keyword": with_log(
            "SELECT CAST(SUM(session_duration) AS BIGINT) AS total_seconds, "
            f"{_HOURS} AS total_hours FROM audit_log WHERE recipe_name ILIKE '%{kw}%' AND {_NZ}"),
        "count_recipes_keyword": with_log(
            "SELECT COUNT(DISTINCT recipe_id) AS unique_recipes FROM audit_log "
            f"WHERE recipe_id IS NOT NULL AND recipe_id <> '' AND recipe_name ILIKE '%{kw}%'"),
        "latest_recipe_rows": with_log(
            f"SELECT {_COLS20} FROM audit_log WHERE trim(lower(type)) = 'recipe' AND {_NZ} "
            f"ORDER BY audit_time DESC NULLS FIRST, id ASC NULLS FIRST, subseq_id ASC NULLS FIRST "
            f"LIMIT {P['n_latest']}"),
        "top_recipes_events": _top(n),
        "user_time_keyword": with_log(
            f"SELECT {_HOURS} AS total_hours FROM audit_log WHERE username = '{P['user']}' "
            f"AND recipe_name ILIKE '%{kw}%' AND {_NZ} AND {_win(*P['user_window'])}"),
        "list_recipes_nomatch": with_log(
            "SELECT DISTINCT recipe_id, recipe_name FROM audit_log "
            f"WHERE recipe_id IS NOT NULL AND recipe_id <> '' AND recipe_name ILIKE '%{kw}??%' "
            "ORDER BY recipe_id"),
        "count_recipe_ids": _count_ids("total_recipes"),
        "count_general_recipes": _count_ids("total_general_recipes", " AND regexp_matches(recipe_name, '(?i)GR')"),
        "list_general_recipes": _list_names(" AND regexp_matches(recipe_name, '(?i)GR')"),
        "count_site_recipes": _count_ids("total_site_recipes", " AND regexp_matches(recipe_name, '(?i)SR')"),
        "list_site_recipes": _list_names(" AND regexp_matches(recipe_name, '(?i)SR')"),
        "count_general_recipes_upper": _count_ids("total_general_recipes", " AND recipe_name LIKE '%GR%'"),
        "count_site_recipes_upper": _count_ids("total_site_recipes", " AND recipe_name LIKE '%SR%'"),
        "hours_keyword": _hours_kw(kw),
        "hours_keyword2": _hours_kw(P["kw2"]),
        "hours_keyword_window": _hours_kw(kw, R.date_window(P["d1"], P["d2"])),
        "hours_keyword_year": _hours_kw(kw, R.year_window(P["year"])),
        "hours_keyword_quarter": _hours_kw(kw, R.quarter_window(P["year"], P["quarter"])),
        "top_recipes_events_window": _top(n, P["window"]),
        "count_recipe_sessions": with_log(
            f"SELECT COUNT(*) AS recipe_sessions FROM audit_log WHERE trim(lower(type)) = 'recipe' AND {_NZ}"),
        "count_recipe_names": with_log(
            "SELECT COUNT(DISTINCT TRIM(recipe_name)) AS total_recipe_names FROM audit_log "
            "WHERE recipe_name IS NOT NULL AND TRIM(recipe_name) <> ''"),
        "list_users": with_log("SELECT DISTINCT user_id FROM audit_log "
                               "WHERE user_id IS NOT NULL AND TRIM(user_id) <> '' ORDER BY user_id"),
        "first_n_users": with_log("SELECT DISTINCT user_id FROM audit_log "
                                  f"WHERE user_id IS NOT NULL AND TRIM(user_id) <> '' ORDER BY user_id LIMIT {n}"),
        "first_n_recipes": _list_names("", f" LIMIT {n}"),
        "count_users": with_log("SELECT COUNT(DISTINCT user_id) AS total_users FROM audit_log "
                                "WHERE user_id IS NOT NULL AND TRIM(user_id) <> ''"),
        "total_records": with_log("SELECT COUNT(*) AS total_records FROM audit_log"),
        "sample_recipe_rows": with_log(
            f"SELECT {_COLS20} FROM audit_log WHERE type = 'recipe' AND session_duration > 0 "
            f"ORDER BY id ASC NULLS FIRST, subseq_id ASC NULLS FIRST LIMIT {P['n_sample']}"),
        "table_stats": with_log(" UNION ALL ".join(
            f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
            for t in sorted(GIVEN_TABLES + ["audit_log"]))),
        "table_estimates": with_log(
            "SELECT phase, CASE WHEN phase = 'analyzed' THEN all_rows ELSE early_rows END AS estimated_rows, "
            "CASE WHEN phase = 'loaded' THEN early_rows ELSE all_rows END AS row_count, phase = 'grown' AS stale "
            f"FROM (SELECT COUNT(*) AS all_rows, COUNT(*) FILTER (WHERE audit_time < TIMESTAMP '{P['window'][0]}') AS early_rows "
            "FROM audit_log), (VALUES ('loaded'), ('grown'), ('analyzed')) p(phase)"),
        "match_names_starts": _list_names(f" AND recipe_name ILIKE '{P['starts']}%'"),
        "match_names_ends": _list_names(f" AND recipe_name ILIKE '%{P['ends']}'"),
        "match_names_contains": _list_names(f" AND recipe_name ILIKE '%{P['contains']}%'"),
        "present_columns": with_log("SELECT " + ", ".join(
            f"COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRIM({c}) <> '') AS {c}_present"
            for c in present_cols) + " FROM audit_log"),
    }
    from kestrel.plans import registry_answers, registry_eval, registry_io, registry_stream, registry_synth
    o.update(registry_eval.ORACLE)
    o.update(registry_io.ORACLE)
    o.update(registry_stream.ORACLE)
    o.update(registry_answers.ORACLE)
    o.update(registry_synth.ORACLE)
    return o

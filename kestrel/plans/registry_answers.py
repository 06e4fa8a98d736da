"""Registered queries for result shaping (A1-A11) and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.timefmt import fmt_elapsed, parse_ts
from kestrel.operators import answers as A
from kestrel.operators import querylog as QL
from kestrel.operators import reports as R
from kestrel.operators.sessions import session_pairs
from kestrel.plans.catalog import audit_log, parsed_table
from kestrel.plans.oracle import with_log
from kestrel.session import scratch_dir


# Texts that exercise the SQL checks, by arithmetic on the turn: fenced, bare and multiple statements,
# writes, comments; an e-mail address in every third question.
def checked_texts(conv: DataFrame) -> DataFrame:
    n, k = F.col("conv_id").cast("string"), (F.col("conv_id") * 7 + F.col("turn")) % 6
    answer = (F.when(k == 1, F.concat(F.lit("```sql\nSELECT a FROM t WHERE x = '"), n, F.lit("';\n```")))
              .when(k == 2, F.concat(F.lit("Here:\n```\nselect "), n, F.lit(" from t\n```")))
              .when(k == 3, F.concat(F.lit("DELETE FROM t WHERE id = "), n, F.lit("; ")))
              .when(k == 4, F.concat(F.lit("with q as (select "), n, F.lit(") select * from q; select 2; select 3")))
              .when(k == 5, F.concat(F.lit("```SQL\nSELECT "), n, F.lit(";-- note\n```")))
              .otherwise(F.col("text")))
    mail = F.concat(F.col("text"), F.lit(" write to u"), n, F.lit("@mail.example.org, now"))
    ask = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, mail).otherwise(F.col("text"))
    return conv.withColumn("text", F.when(F.col("role") == "assistant", answer)
                           .when(F.col("role") == "user", ask).otherwise(F.col("text")))


def _conv(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return checked_texts(_conv(spark, sf))


def q_session_elapsed(spark, sf):
    s = session_pairs(parsed_table(spark, sf))
    return s.select("file", "start_ord", fmt_elapsed(F.col("session_duration")).alias("elapsed"))


def q_recent_context(spark, sf):
    return A.recent_context(_conv(spark, sf))


def q_sql_checks(spark, sf):
    a = _checked(spark, sf).filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return QL.sql_checks(a).select("conv_id", "turn", "sql", "looks_like_sql", "guard_ok")


def q_query_log_report(spark, sf):
    path = scratch_dir(spark, "query_events")
    QL.write_events(QL.events_from_conversations(_checked(spark, sf)), path)
    return QL.query_log_report(QL.read_events(spark, path)).select(
        F.col("day").cast("string").alias("day"), "queries", "errors", "empty_results",
        "mean_elapsed", "max_elapsed", "rows_returned", "valid_sql")


def q_query_log_percentiles(spark, sf):
    """Weekly percentiles from the days' stored sketches, each judged by its exact rank."""
    path, days = scratch_dir(spark, "query_events"), scratch_dir(spark, "elapsed_sketches")
    QL.write_events(QL.events_from_conversations(_checked(spark, sf)), path)
    events = QL.read_events(spark, path)
    QL.elapsed_sketches(events).write.parquet(days)
    answers = QL.elapsed_percentiles(spark.read.parquet(days), [0.5, 0.9, 0.99])
    judged = QL.percentile_ranks(events, answers)
    return judged.select(F.col("span_start").cast("string").alias("week"), "p", "queries",
                         ((F.col("rank_low") <= F.col("p") + QL.RANK_ERROR)
                          & (F.col("rank_high") >= F.col("p") - QL.RANK_ERROR)).alias("within_error"))


def q_last_sql(spark, sf):
    path = scratch_dir(spark, "query_events")
    QL.write_events(QL.events_from_conversations(_checked(spark, sf)), path)
    return QL.last_sql(QL.read_events(spark, path))


def q_jsonify_result(spark, sf):
    return A.jsonify_rows(R.top_recipes_events(audit_log(spark, sf), 10))


def q_result_header(spark, sf):
    return A.result_header(R.list_users(audit_log(spark, sf)))


def q_format_answer_count(spark, sf):
    return A.format_answer(R.count_recipe_ids(audit_log(spark, sf)))


def q_format_answer_list(spark, sf):
    return A.format_answer(R.list_general_recipes(audit_log(spark, sf)))


def q_format_answer_rows(spark, sf):
    return A.format_answer(R.top_recipes_events(audit_log(spark, sf), 10))


def q_answer_hours(spark, sf):
    return A.answer_text(R.hours_keyword(audit_log(spark, sf), "buffer"), "hours")


def q_answer_list(spark, sf):
    return A.answer_text(R.list_site_recipes(audit_log(spark, sf)), "list")


def q_result_preview(spark, sf):
    return A.result_preview(R.list_users(audit_log(spark, sf)), 20)


def q_run_report(spark, sf):
    audit_log(spark, sf).createOrReplaceTempView("audit_log")
    return QL.run_report(spark, "SELECT recipe_name, COUNT(*) AS n FROM audit_log "
                                "WHERE recipe_name ILIKE :kw GROUP BY recipe_name;", {"kw": "%mix%"})


def q_format_answer_empty(spark, sf):
    """The lone sum over no rows is missing: the preview says so."""
    return A.format_answer(R.hours_keyword(audit_log(spark, sf), "no such keyword"))


def q_event_samples(spark, sf):
    """Every event's result sample, whole rows, twenty at most."""
    path = scratch_dir(spark, "query_events")
    QL.write_events(QL.events_from_conversations(_checked(spark, sf)), path)
    return QL.read_events(spark, path).select("ts", F.size("rows_sample").cast("bigint").alias("rows"), F.array_join(
        F.transform("rows_sample", lambda r: r[0]), "\n").alias("sample"))


def q_sql_history(spark, sf):
    path = scratch_dir(spark, "query_events")
    QL.write_events(QL.events_from_conversations(_checked(spark, sf)), path)
    return QL.sql_history(QL.read_events(spark, path))


def q_jsonify_times(spark, sf):
    """A1 with a time, a date and a decimal in the row."""
    t = audit_log(spark, sf).select("id", "audit_time", F.to_date("audit_time").alias("day"),
                                    (F.col("session_duration") / 10).cast("decimal(12,1)").alias("tenths"))
    return A.jsonify_rows(t)


def q_time_forms(spark, sf):
    """Every event's time in one of sixteen written forms, parsed back."""
    e, ts = F.col("event_id") % 16, F.col("ts").cast("timestamp")
    forms = {0: "HH:mm:ss", 1: "M/d/yyyy, h:mm:ss a", 2: "EEE, dd MMM yyyy HH:mm:ss 'GMT'", 3: "'T'HH:mm",
             4: "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", 5: "yyyy/MM/dd HH:mm:ss", 6: "MMM d, yyyy", 7: "yyyy-MM-dd HH:mm:ss 'junk'",
             8: "EEE, dd MMM yyyy HH:mm:ss '+0200'", 9: "MMMM d, yyyy HH:mm:ss", 10: "d MMMM yyyy HH:mm",
             11: "EEE MMM dd yyyy HH:mm:ss 'GMT-0530 (somewhere)'", 12: "EEE MMM d HH:mm:ss yyyy", 13: "d-MMM-yy h:mm a",
             14: "MM-dd-yyyy HH:mm:ss.SSS 'EST'", 15: "M/d/yy"}
    text = F.lit(None).cast("string")
    for k, f in forms.items():
        text = F.when(e == k, F.date_format(ts, f)).otherwise(text)
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select("event_id", parse_ts(text).cast("timestamp_ntz").alias("parsed"))


QUERIES = {
    "session_elapsed": q_session_elapsed,
    "recent_context": q_recent_context,
    "sql_checks": q_sql_checks,
    "query_log_report": q_query_log_report,
    "query_log_percentiles": q_query_log_percentiles,
    "last_sql": q_last_sql,
    "jsonify_result": q_jsonify_result,
    "result_header": q_result_header,
    "format_answer_count": q_format_answer_count,
    "format_answer_list": q_format_answer_list,
    "format_answer_rows": q_format_answer_rows,
    "answer_hours": q_answer_hours,
    "answer_list": q_answer_list,
    "result_preview": q_result_preview,
    "run_report": q_run_report,
    "format_answer_empty": q_format_answer_empty,
    "event_samples": q_event_samples,
    "sql_history": q_sql_history,
    "jsonify_times": q_jsonify_times,
    "time_forms": q_time_forms,
}

_ELAPSED = """CASE WHEN d // 3600 > 0 THEN (d // 3600) || 'h ' || lpad(((d % 3600) // 60)::VARCHAR, 2, '0') || 'm '
                                || lpad((d % 60)::VARCHAR, 2, '0') || 's'
          WHEN d // 60 > 0 THEN (d // 60) || 'm ' || lpad((d % 60)::VARCHAR, 2, '0') || 's'
          ELSE d || 's' END"""

_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

# The same texts in SQL, and what the checks must find in each kind of them.
_KIND = "(conv_id * 7 + turn) % 6"
CHECKED_CTE = f"""c2 AS (
  SELECT conv_id, turn, role, {_KIND} AS kind,
    CASE WHEN role = 'assistant' THEN CASE {_KIND}
           WHEN 1 THEN '```sql' || chr(10) || 'SELECT a FROM t WHERE x = ''' || conv_id || ''';' || chr(10) || '```'
           WHEN 2 THEN 'Here:' || chr(10) || '```' || chr(10) || 'select ' || conv_id || ' from t' || chr(10) || '```'
           WHEN 3 THEN 'DELETE FROM t WHERE id = ' || conv_id || '; '
           WHEN 4 THEN 'with q as (select ' || conv_id || ') select * from q; select 2; select 3'
           WHEN 5 THEN '```SQL' || chr(10) || 'SELECT ' || conv_id || ';-- note' || chr(10) || '```'
           ELSE text END
         WHEN role = 'user' AND (conv_id + turn) % 3 = 0 THEN text || ' write to u' || conv_id || '@mail.example.org, now'
         ELSE text END AS text,
    text AS plain
  FROM conversations),
found AS (
  SELECT conv_id, turn, role, text,
    CASE kind WHEN 1 THEN 'SELECT a FROM t WHERE x = ''' || conv_id || ''''
              WHEN 2 THEN 'select ' || conv_id || ' from t'
              WHEN 3 THEN 'DELETE FROM t WHERE id = ' || conv_id
              WHEN 4 THEN 'with q as (select ' || conv_id || ') select * from q; select 2; select 3'
              WHEN 5 THEN 'SELECT ' || conv_id || ';-- note'
              ELSE rtrim(regexp_replace(COALESCE(plain, ''), '^\\s+|\\s+$', '', 'g'), ';') END AS s,
    kind IN (1, 2, 4, 5) AS looks, kind IN (0, 1, 2) AS passes
  FROM c2 WHERE role = 'assistant')"""
_QA = f"""WITH {CHECKED_CTE},
q AS (
  SELECT u.conv_id, u.turn, u.text, COALESCE(a.text, '') AS answer, COALESCE(a.s, '') AS s,
         COALESCE(a.looks, false) AS looks, COALESCE(a.passes, true) AS passes
  FROM c2 u LEFT JOIN found a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user'),
e AS (
  SELECT strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts, *
  FROM q)
"""

ORACLE = {
    "last_sql": _QA + "SELECT arg_max('-- ' || ts || ' | ' || text || chr(10) || s || ';', ts) AS last_sql FROM e WHERE s <> ''",
    "sql_history": _QA + "SELECT ts, '-- ' || ts || ' | ' || text || chr(10) || s || ';' AS entry FROM e WHERE s <> ''",
    "event_samples": _QA + "SELECT ts, CAST(least(len(string_split(answer, chr(10))), 20) AS BIGINT) AS rows, "
                           "array_to_string(list_slice(string_split(answer, chr(10)), 1, 20), chr(10)) AS sample FROM e",
    "format_answer_empty": "SELECT 'Found **' || count(*) || '** rows. Preview:' || chr(10) || '- total_hours=None' AS answer "
                           "FROM (SELECT count(*) FROM events)",
    "jsonify_times": with_log(
        "SELECT '{\"id\":\"' || id || '\",\"audit_time\":' || CASE WHEN audit_time IS NULL THEN 'null' ELSE '\"' || "
        "strftime(audit_time, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(audit_time) % 1000000 = 0 THEN '' "
        "ELSE strftime(audit_time, '.%f') END || '+00:00\"' END || ',\"day\":' || "
        "CASE WHEN audit_time IS NULL THEN 'null' ELSE '\"' || strftime(audit_time, '%Y-%m-%d') || '\"' END || ',\"tenths\":' || "
        "COALESCE(CAST(session_duration // 10 AS VARCHAR) || '.' || CAST(session_duration % 10 AS VARCHAR), 'null') || '}' AS row_json "
        "FROM audit_log"),
    "time_forms": "SELECT event_id, CASE event_id % 16 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN date_trunc('millisecond', ts) "
                  "WHEN 6 THEN date_trunc('day', ts) WHEN 8 THEN date_trunc('second', ts) - INTERVAL 2 HOUR "
                  "WHEN 10 THEN date_trunc('minute', ts) WHEN 11 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE "
                  "WHEN 13 THEN date_trunc('minute', ts) WHEN 14 THEN date_trunc('millisecond', ts) + INTERVAL 5 HOUR "
                  "WHEN 15 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS parsed FROM events",
    "session_elapsed": with_log(
        f"SELECT file, start_ord, {_ELAPSED} AS elapsed FROM (SELECT file, start_ord, "
        "CAST(session_duration AS BIGINT) AS d FROM sessions)"),
    "recent_context": """
WITH c AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k
      FROM c WHERE role = 'user'),
l AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS next_turn FROM u WHERE k <= 3),
p AS (SELECT l.conv_id, l.turn, l.text,
             arg_min(a.text, a.turn) AS answer
      FROM l LEFT JOIN c a ON a.conv_id = l.conv_id AND a.role = 'assistant' AND a.turn > l.turn
                           AND (l.next_turn IS NULL OR a.turn < l.next_turn)
      GROUP BY l.conv_id, l.turn, l.text),
b AS (SELECT conv_id, turn AS t, 0 AS o, '- User: ' || """ + _TRIM.format(x="text") + """ AS b FROM p
      WHERE """ + _TRIM.format(x="COALESCE(text, '')") + """ <> ''
      UNION ALL
      SELECT conv_id, turn, 1, '- Answer: ' || """ + _TRIM.format(x="answer") + """ FROM p
      WHERE """ + _TRIM.format(x="COALESCE(answer, '')") + """ <> ''),
r AS (SELECT *, SUM(length(b) + 1) OVER (PARTITION BY conv_id ORDER BY t, o
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT conv_id, 'Recent context:' || chr(10) || string_agg(b, chr(10) ORDER BY t, o) AS context
FROM r WHERE run <= 300 GROUP BY conv_id""",
    "sql_checks": f"WITH {CHECKED_CTE} SELECT conv_id, turn, s AS sql, looks AS looks_like_sql, passes AS guard_ok FROM found",
    "query_log_percentiles": _QA + """
SELECT CAST(CAST(date_trunc('week', CAST(substr(ts, 1, 10) AS DATE)) AS DATE) AS VARCHAR) AS week, r.p,
       COUNT(*) AS queries, true AS within_error
FROM e, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) r(p) GROUP BY 1, 2""",
    "query_log_report": _QA + """
SELECT substr(ts, 1, 10) AS day, COUNT(*) AS queries, COUNT(*) FILTER (WHERE answer = '') AS errors,
       COUNT(*) FILTER (WHERE length(answer) = 0) AS empty_results,
       round(AVG(round(length(text) / 100.0, 3)), 6) AS mean_elapsed, MAX(round(length(text) / 100.0, 3)) AS max_elapsed,
       CAST(SUM(length(answer)) AS BIGINT) AS rows_returned, COUNT(*) FILTER (WHERE looks AND passes) AS valid_sql
FROM e GROUP BY 1""",
    "jsonify_result": with_log(
        "SELECT CAST(to_json({'recipe_id': recipe_id, 'recipe_name': recipe_name, 'events': events}) AS VARCHAR) "
        "AS row_json FROM (SELECT recipe_id, recipe_name, COUNT(*) AS events FROM audit_log "
        "WHERE recipe_id IS NOT NULL AND recipe_id <> '' GROUP BY recipe_id, recipe_name "
        "ORDER BY events DESC, recipe_id ASC NULLS FIRST, recipe_name ASC NULLS FIRST LIMIT 10)"),
    "result_header": with_log(
        "SELECT '{\"columns\":[\"user_id\"],\"total_rows\":' || COUNT(*) || '}' AS header FROM "
        "(SELECT DISTINCT user_id FROM audit_log WHERE user_id IS NOT NULL AND TRIM(user_id) <> '')"),
    "format_answer_count": with_log(
        "SELECT 'There are **' || format('{:,}', COUNT(DISTINCT TRIM(recipe_id))) || "
        "'** distinct recipes in the system.' AS answer FROM audit_log "
        "WHERE recipe_id IS NOT NULL AND TRIM(recipe_id) <> ''"),
    "format_answer_list": with_log(
        "SELECT 'Found **' || COUNT(*) || '** recipes. Showing ' || least(COUNT(*), 20) || ':' || chr(10) || '- ' "
        "|| string_agg(recipe_name, chr(10) || '- ' ORDER BY recipe_name) FILTER (WHERE rn <= 20) AS answer "
        "FROM (SELECT recipe_name, row_number() OVER (ORDER BY recipe_name) AS rn FROM "
        "(SELECT DISTINCT TRIM(recipe_name) AS recipe_name FROM audit_log WHERE recipe_name IS NOT NULL "
        "AND TRIM(recipe_name) <> '' AND regexp_matches(recipe_name, '(?i)GR')))"),
    "format_answer_rows": with_log(
        "SELECT 'Found **' || COUNT(*) || '** rows. Preview:' || chr(10) || "
        "string_agg('- recipe_id=' || COALESCE(recipe_id, 'None') || ', recipe_name=' || COALESCE(recipe_name, 'None') "
        "|| ', events=' || events, chr(10) ORDER BY rn) FILTER (WHERE rn <= 5) AS answer FROM ("
        "SELECT *, row_number() OVER (ORDER BY events DESC, recipe_id ASC NULLS FIRST, recipe_name ASC NULLS FIRST) "
        "AS rn FROM (SELECT recipe_id, recipe_name, COUNT(*) AS events FROM audit_log "
        "WHERE recipe_id IS NOT NULL AND recipe_id <> '' GROUP BY recipe_id, recipe_name "
        "ORDER BY events DESC, recipe_id ASC NULLS FIRST, recipe_name ASC NULLS FIRST LIMIT 10))"),
    "answer_hours": with_log(
        "SELECT COALESCE(format('{:,.2f}', CAST(SUM(session_duration) AS DOUBLE) / 3600.0), '0.00') AS text "
        "FROM audit_log WHERE recipe_name ILIKE '%buffer%' AND COALESCE(session_duration, 0) > 0"),
    "answer_list": with_log(
        "SELECT DISTINCT '- ' || TRIM(recipe_name) AS text FROM audit_log WHERE recipe_name IS NOT NULL "
        "AND TRIM(recipe_name) <> '' AND regexp_matches(recipe_name, '(?i)SR')"),
    "result_preview": with_log(
        "SELECT user_id, (SELECT COUNT(DISTINCT user_id) FROM audit_log WHERE user_id IS NOT NULL "
        "AND TRIM(user_id) <> '') AS total_rows FROM (SELECT DISTINCT user_id FROM audit_log "
        "WHERE user_id IS NOT NULL AND TRIM(user_id) <> '' ORDER BY user_id LIMIT 20)"),
    "run_report": with_log(
        "SELECT recipe_name, COUNT(*) AS n FROM audit_log WHERE recipe_name ILIKE '%mix%' GROUP BY recipe_name"),
}

"""Registered queries for the documented-only capabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import evaluation as EV
from kestrel.operators import querylog as QL
from kestrel.operators import reports as R
from kestrel.operators import synth as S
from kestrel.plans.catalog import audit_log
from kestrel.plans.oracle import with_log
from kestrel.plans.registry_answers import CHECKED_CTE, checked_texts
from kestrel.plans.registry_synth import _join as synth_sql
from kestrel.session import scratch_dir
from kestrel.sources import rawlogs as RL

SALT = "kestrel-salt"
SHIFT_SECRET = "kestrel-shift"


def q_exact_match(spark, sf):
    p = S.sample_pairs(spark, audit_log(spark, sf))
    # A reformatted copy for even rows (must match), the next row's SQL for odd rows.
    nxt = p.select((F.col("row_id") - 1).alias("row_id"), F.col("gold_sql").alias("other_sql"))
    pred = p.join(nxt, "row_id", "left").select(
        "template", "gold_sql",
        F.when(F.col("row_id") % 2 == 0, F.concat(F.upper("gold_sql"), F.lit("  ;")))
        .otherwise(F.coalesce("other_sql", F.lit(""))).alias("pred_sql"))
    return EV.exact_match(pred, "pred_sql", "gold_sql", ["template"])


def q_execution_match(spark, sf):
    t = audit_log(spark, sf)
    t.createOrReplaceTempView("audit_log")
    a = R.top_recipes_events(t, 10)
    b = spark.sql("SELECT recipe_id, recipe_name, COUNT(*) AS events FROM audit_log "
                  "WHERE recipe_id IS NOT NULL AND recipe_id <> '' GROUP BY recipe_id, recipe_name "
                  "ORDER BY events DESC, recipe_id, recipe_name LIMIT 10")
    return EV.execution_match(a, b)


def q_execution_mismatch(spark, sf):
    """Two results that differ in both directions: rows by recipe id against rows by recipe name."""
    t = audit_log(spark, sf)
    a = t.groupBy(F.trim("recipe_id").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    b = t.groupBy(F.trim("recipe_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return EV.execution_match(a, b)


def q_raw_logs(spark, sf):
    r = EV.raw_logs(spark.read.parquet(f"{sf}/events.parquet"))
    return r.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "actor", "action", "duration_ms",
                    F.variant_get("payload_json", "$.k", "bigint").alias("k"))


# Where the canonical fields lie in an event's record.
_EVENT_PATHS = {"ts": "$.ts", "actor": "$.user_id", "action": "$.event_type", "object": "$.event_id"}


def _staged_events(spark, sf):
    """The events as JSON lines, every 50th one cut off, every 70th only a number, and as Parquet."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    json, parquet = scratch_dir(spark, "raw_jsonl"), scratch_dir(spark, "raw_parquet")
    record = ev.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), "user_id", "event_type",
                       "value", F.from_json("props", "k bigint").alias("props"))
    line = F.to_json(F.struct("*"))
    e = F.col("event_id")
    (record.select(F.when(e % 50 == 7, F.substring(line, 1, 20)).when(e % 70 == 9, F.col("event_id").cast("string"))
                   .otherwise(line)).write.text(json))
    record.write.parquet(parquet)
    return RL.read_json_lines(spark, json), RL.read_parquet_records(spark, parquet)


def q_raw_logs_jsonl(spark, sf):
    """The canonical rows of both staged forms, with two fields of the payload."""
    ms = F.round(F.try_variant_get("payload_json", "$.value", "double") * 1000)
    lines, records = (RL.raw_log_rows(r, name, {**_EVENT_PATHS, "duration_ms": ms})
                      for r, name in zip(_staged_events(spark, sf), ("jsonl", "parquet")))
    return lines.unionByName(records).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "source", "actor", "action", "object", "duration_ms", "project",
        F.try_variant_get("payload_json", "$.props.k", "bigint").alias("k"))


def q_raw_logs_quarantine(spark, sf):
    lines, _ = _staged_events(spark, sf)
    return RL.raw_log_rejects(lines).select("raw_line", "reason")


def q_raw_logs_schema(spark, sf):
    lines, records = (RL.raw_log_rows(r, name, _EVENT_PATHS)
                      for r, name in zip(_staged_events(spark, sf), ("jsonl", "parquet")))
    # JSON numbers have the precision of the largest one seen, which differs from table to table.
    shown = F.regexp_replace("payload_schema", r"DECIMAL\([0-9,]+\)", "DECIMAL")
    return RL.payload_schema(lines.unionByName(records)).withColumn("payload_schema", shown)


def q_deidentify(spark, sf):
    d = EV.deidentify(audit_log(spark, sf), SALT, SHIFT_SECRET)
    return d.groupBy("user_hash").agg(F.count(F.lit(1)).alias("rows"),
                                      F.min("shifted_time").cast("timestamp_ntz").alias("first_seen"))


def q_redact_events(spark, sf):
    ev = QL.events_from_conversations(checked_texts(spark.read.parquet(f"{sf}/conversations.parquet")))
    return EV.redact_events(ev).select("user_query", "row_count", "error")


QUERIES = {
    "exact_match": q_exact_match,
    "execution_match": q_execution_match,
    "execution_mismatch": q_execution_mismatch,
    "raw_logs": q_raw_logs,
    "raw_logs_jsonl": q_raw_logs_jsonl,
    "raw_logs_quarantine": q_raw_logs_quarantine,
    "raw_logs_schema": q_raw_logs_schema,
    "deidentify": q_deidentify,
    "redact_events": q_redact_events,
}

_NORM = "regexp_replace(regexp_replace(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g'), '\\s*;+$', '')"

ORACLE = {
    "exact_match": synth_sql(
        "SELECT template, COUNT(*) AS rows, CAST(SUM(hit) AS BIGINT) AS matches, SUM(hit) / COUNT(*) AS exact_match FROM ("
        "SELECT z.template, CAST(" + _NORM.format(x="CASE WHEN z.row_id % 2 = 0 THEN upper(z.gold_sql) || '  ;' "
        "ELSE COALESCE(n.gold_sql, '') END") + " = " + _NORM.format(x="z.gold_sql") + " AS INTEGER) AS hit "
        "FROM z LEFT JOIN z n ON n.row_id = z.row_id + 1) GROUP BY template"),
    "execution_match": "SELECT CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, true AS match "
                       "FROM (SELECT COUNT(*) FROM events)",
    "raw_logs": "SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS actor, event_type AS action, "
                "CAST(round(value * 1000) AS BIGINT) AS duration_ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k "
                "FROM events",
    "raw_logs_jsonl": """
SELECT date_trunc('millisecond', ts) AS ts, s.source, CAST(user_id AS VARCHAR) AS actor, event_type AS action,
       CAST(event_id AS VARCHAR) AS object, CAST(round(value * 1000) AS BIGINT) AS duration_ms,
       CAST(NULL AS VARCHAR) AS project, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events, (VALUES ('jsonl'), ('parquet')) s(source)
WHERE s.source = 'parquet' OR (event_id % 50 <> 7 AND event_id % 70 <> 9)""",
    "raw_logs_quarantine": """
SELECT CASE WHEN event_id % 50 = 7 THEN substr('{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d') || 'T', 1, 20)
            ELSE CAST(event_id AS VARCHAR) END AS raw_line,
       CASE WHEN event_id % 50 = 7 THEN 'NOT_JSON' ELSE 'NOT_OBJECT' END AS reason
FROM events WHERE event_id % 50 = 7 OR event_id % 70 = 9""",
    "raw_logs_schema": """
SELECT s.source, COUNT(*) AS records,
       'OBJECT<event_id: BIGINT, event_type: STRING, props: OBJECT<k: BIGINT>, ts: STRING, user_id: BIGINT, value: '
       || CASE s.source WHEN 'jsonl' THEN 'DECIMAL' ELSE 'DOUBLE' END || '>' AS payload_schema
FROM events, (VALUES ('jsonl'), ('parquet')) s(source)
WHERE s.source = 'parquet' OR (event_id % 50 <> 7 AND event_id % 70 <> 9) GROUP BY s.source""",
    "execution_mismatch": with_log(""",
a AS (SELECT TRIM(recipe_id) AS name, COUNT(*) AS rows FROM audit_log GROUP BY 1),
b AS (SELECT TRIM(recipe_name) AS name, COUNT(*) AS rows FROM audit_log GROUP BY 1),
x AS (SELECT COUNT(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
y AS (SELECT COUNT(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT x.n AS only_a, y.n AS only_b, x.n = 0 AND y.n = 0 AS match FROM x, y"""),
    "deidentify": with_log(
        "SELECT user_hash, COUNT(*) AS rows, MIN(shifted) AS first_seen FROM ("
        f"SELECT sha256('{SALT}' || COALESCE(user_id, '')) AS user_hash, to_timestamp(CAST(floor(epoch(audit_time)) AS BIGINT) + "
        f"('0x' || substr(sha256('{SHIFT_SECRET}' || COALESCE(user_id, '')), 1, 12))::BIGINT % 2592000 + "
        f"('0x' || substr(sha256('{SHIFT_SECRET}' || 'row|' || COALESCE(user_id, '') || '|' || COALESCE(id, '')), 1, 12))::BIGINT % 60)"
        "::TIMESTAMP AS shifted FROM audit_log) GROUP BY user_hash"),
    "redact_events": f"""WITH {CHECKED_CTE}
SELECT regexp_replace(CASE WHEN u.text <> u.plain THEN u.plain || ' write to <email>, now' ELSE u.text END, '[0-9]', '#', 'g') AS user_query,
       CAST(length(COALESCE(a.text, '')) AS BIGINT) AS row_count,
       CASE WHEN COALESCE(a.text, '') = '' THEN 'no answer' ELSE '' END AS error
FROM c2 u LEFT JOIN c2 a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
}

"""DuckDB oracle text: the expected log computed from ``events`` columns.

No raw line is parsed here: each expected field follows from the event's
columns by the same fixed rules that generate the lines (see
``kestrel.sources.fixture``). Pairing uses the rank form of the session rule.
"""

from __future__ import annotations

# One CTE chain; ``audit_log`` is the typed table (empty text as NULL).
LOG_CTE = r"""
ev AS (
  SELECT event_id AS e, ts, user_id AS u, event_type,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) % 20 AS r,
         CASE WHEN event_id % 97 = 0 THEN 0 ELSE (event_id // 3) % 4 END AS form,
         CASE WHEN event_type IN ('view', 'click') THEN 'User checked out recipe'
              WHEN event_type = 'purchase' THEN 'User checked in recipe'
              WHEN event_type = 'signup' AND event_id % 11 = 0 THEN 'User updated recipe'
              WHEN event_type = 'signup' THEN 'User discarded checkout'
              WHEN event_type = 'error' THEN 'System auto-check in'
              ELSE 'User opened log' END AS verb
  FROM events
),
rows0 AS (
  SELECT
    CASE e % 3 WHEN 0 THEN 'January 2024.csv' WHEN 1 THEN '2023-12 export.csv' ELSE 'misc.csv' END AS file,
    e AS ord,
    CASE WHEN u % 10 = 0 THEN 'Solo' || u ELSE 'First' || u || ' Van Last (u' || u || ')' END AS user_id,
    CAST(e AS VARCHAR) AS id,
    CAST(e % 7 AS VARCHAR) AS subseq_id,
    CASE form WHEN 0 THEN verb || ' Recipe ID: ''R-' || r || ''' done'
              WHEN 1 THEN verb || ' of recipe_' || r || ', ok'
              WHEN 2 THEN verb || '|Material Name = Mat ' || r || '|Material ID = ' || (100 + r)
              ELSE verb || ' for "Lot ' || r || '" | Recipe ID: R-' || r || ', end' END AS message,
    CASE WHEN e % 101 = 0 THEN NULL
         WHEN e % 2 = 0 THEN date_trunc('second', ts)
         ELSE date_trunc('millisecond', ts) END AS audit_time,
    event_type AS action_raw,
    CASE WHEN e % 7 <= 2 THEN 'Recipe' WHEN e % 7 <= 4 THEN 'recipe' ELSE 'Equipment' END AS type,
    CASE WHEN e % 97 = 0 THEN NULL
         WHEN r % 4 = 0 THEN 'GR Buffer ' || r
         WHEN r % 4 = 1 THEN 'SR Column ' || r
         WHEN r % 4 = 2 THEN 'Grab mix ' || r
         ELSE 'Alphamab ' || r END AS label,
    CASE WHEN e % 97 = 0 THEN NULL ELSE 'v1' END AS version,
    CASE WHEN form IN (0, 3) THEN 'R-' || r WHEN form = 1 THEN 'recipe_' || r ELSE NULL END AS recipe_id,
    CASE WHEN e % 97 = 0 OR e % 7 >= 5 THEN NULL
         WHEN r % 4 = 0 THEN 'GR Buffer ' || r
         WHEN r % 4 = 1 THEN 'SR Column ' || r
         WHEN r % 4 = 2 THEN 'Grab mix ' || r
         ELSE 'Alphamab ' || r END AS recipe_name,
    CASE WHEN form = 2 THEN 'Mat ' || r END AS material_name,
    CASE WHEN form = 2 THEN CAST(100 + r AS VARCHAR) END AS material_id,
    CASE WHEN u % 10 = 0 THEN 'Solo' || u ELSE 'First' || u END AS name1,
    CASE WHEN u % 10 = 0 THEN NULL ELSE 'Van Last' END AS name2,
    CASE WHEN u % 10 = 0 THEN NULL ELSE 'u' || u END AS username,
    CASE WHEN e % 97 = 0 THEN 'PADDED' WHEN form = 2 THEN 'COERCED' ELSE NULL END AS reason,
    event_type IN ('view', 'click') AS is_start,
    event_type IN ('purchase', 'signup', 'error') AS is_end,
    event_type = 'error' AS is_auto
  FROM ev
),
rows1 AS (
  SELECT *,
    array_to_string(list_slice(string_split_regex(trim(message), '\s+'), 1, 4), ' ') AS action_derived,
    COALESCE(username, user_id) || '|' || COALESCE(recipe_id, recipe_name, '') AS skey
  FROM rows0
),
st AS (
  SELECT file, skey, ord AS start_ord, audit_time AS start_ts,
         row_number() OVER (PARTITION BY file, skey ORDER BY ord DESC) AS rnk
  FROM rows1 WHERE is_start
),
en AS (
  SELECT file, skey, ord AS end_ord, audit_time AS end_ts, is_auto,
         row_number() OVER (PARTITION BY file, skey ORDER BY ord) AS rnk
  FROM rows1 WHERE is_end AND audit_time IS NOT NULL
),
pairs AS (
  SELECT st.file, st.skey, st.start_ord, en.end_ord, st.start_ts, en.end_ts AS session_end,
         greatest(0, floor((epoch_ms(en.end_ts) - epoch_ms(COALESCE(st.start_ts, en.end_ts))) / 1000.0))::BIGINT AS raw,
         en.is_auto
  FROM st JOIN en USING (file, skey, rnk)
),
sessions AS (
  SELECT file, skey, start_ord, end_ord, start_ts AS session_start, session_end,
         CAST(CASE WHEN is_auto THEN least(raw, 28800)
                   WHEN raw > 28000 THEN CASE WHEN raw // 86400 <= 1 THEN 28000 ELSE (raw // 86400) * 28000 END
                   ELSE raw END AS INTEGER) AS session_duration
  FROM pairs
),
audit_log AS (
  SELECT rows1.user_id, rows1.id, rows1.subseq_id, rows1.message, rows1.audit_time,
         rows1.action_raw, rows1.type, rows1.label, rows1.version,
         rows1.recipe_id, rows1.recipe_name, rows1.material_name, rows1.material_id,
         rows1.name1, rows1.name2, rows1.username, rows1.action_derived,
         CASE WHEN rows1.is_start THEN rows1.audit_time END AS session_start,
         sessions.session_end, sessions.session_duration,
         rows1.file, rows1.ord, rows1.reason, rows1.skey, rows1.is_start, rows1.is_end, rows1.is_auto
  FROM rows1 LEFT JOIN sessions ON rows1.file = sessions.file AND rows1.ord = sessions.start_ord
)
"""


def with_log(select_sql: str) -> str:
    """Prefix a SELECT over ``audit_log`` with the expected-log CTE chain."""
    return "WITH " + LOG_CTE.strip() + "\n" + select_sql

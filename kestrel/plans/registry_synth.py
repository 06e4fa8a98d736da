"""Registered queries for pair synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import synth as S
from kestrel.plans.catalog import audit_log
from kestrel.plans.oracle import with_log
from kestrel.schema import AUDIT_LOG_SCHEMA
from kestrel.session import scratch_dir


def _pairs(spark, sf):
    return S.sample_pairs(spark, audit_log(spark, sf))


def q_synth_pairs(spark, sf):
    return S.random_split(_pairs(spark, sf))


def q_synth_pattern_split(spark, sf):
    p = S.pattern_split(_pairs(spark, sf))
    return p.groupBy("split", "template").agg(F.count(F.lit(1)).alias("rows"))


def q_synth_leak_report(spark, sf):
    return S.leak_report(S.random_split(_pairs(spark, sf)))


def q_synth_rejects(spark, sf):
    return S.validate_pairs(_pairs(spark, sf)).agg(F.count(F.lit(1)).alias("rejects"))


def q_synth_jsonl(spark, sf):
    """The written records, read back, every field of the nested record as a column."""
    path = scratch_dir(spark, "pairs_jsonl")
    records = S.pair_records(S.random_split(_pairs(spark, sf)))
    S.write_jsonl(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.select("split", F.col("schema.engine").alias("engine"),
                       F.array_join(F.col(f"schema.tables.{S.TABLE}.columns"), ", ").alias("table_columns"), "system",
                       "user_query", "gold_sql", F.size("notes").cast("bigint").alias("notes"))


QUERIES = {
    "synth_pairs": q_synth_pairs,
    "synth_pattern_split": q_synth_pattern_split,
    "synth_leak_report": q_synth_leak_report,
    "synth_rejects": q_synth_rejects,
    "synth_jsonl": q_synth_jsonl,
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _digits(slot: int) -> str:
    return f"('0x' || substr(md5('{S.SEED}|' || row_id || '|{slot}'), 1, 8))::BIGINT"


def _category() -> str:
    parts, bound = [], 0
    for name, w in S.CATEGORIES:
        bound += w
        parts.append(f"WHEN row_id < {bound} THEN '{name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{S.CATEGORIES[-1][0]}' END"


def _template() -> str:
    parts = []
    for c, _ in S.CATEGORIES:
        names = [r.name for r in S.of_category(c)]
        parts.append(f"WHEN '{c}' THEN [{', '.join(map(_lit, names))}][{_digits(1)} % {len(names)} + 1]")
    return "CASE category " + " ".join(parts) + " END"


def _fill(pattern: str, values: list[str]) -> str:
    out, rest = [], pattern
    for i, v in enumerate(values):
        head, _, rest = rest.partition("{%d}" % i)
        out += [_lit(head), v]
    return " || ".join([*out, _lit(rest)])


def _texts() -> tuple[str, str]:
    plain = {"user": ["usr"], "kw": ["kw"], "absent": ["kw"], "window": ["win_a", "win_b"], "limit": ["lim"]}
    q, s = [], []
    for r in S.REPORTS:
        slots = [x for x in S.SLOTS if x in r.slots]
        said = ", ".join(_fill(S.SLOTS[x][0], plain[x]) for x in slots)
        q.append(f"WHEN '{r.name}' THEN " + (f"concat_ws(': ', {_lit(r.title)}, nullif(array_to_string([{said}], ', '), ''))"
                                             if slots else _lit(r.title)))
        cond = [_lit(w) for w in r.where]
        for x in slots:
            if S.SLOTS[x][1]:
                esc = plain[x]
                if x in ("kw", "absent"):
                    for old, new in (("\\", "\\" * 4), ("%", "\\%"), ("_", "\\_")):
                        esc = [f"replace({v}, {_lit(old)}, {_lit(new)})" for v in esc]
                esc = [f"replace({v}, {_lit(chr(39))}, {_lit(chr(39) * 2)})" for v in esc]
                cond.append(_fill(S.SLOTS[x][1], esc))
        tail = _lit(" " + r.tail if r.tail else "") + (" || ' LIMIT ' || lim" if "limit" in r.slots else "")
        s.append(f"WHEN '{r.name}' THEN {_lit(f'SELECT {r.select} FROM {S.TABLE} WHERE ')} || "
                 f"array_to_string([{', '.join(cond)}], ' AND ') || {tail} || ';'")
    return "CASE template " + " ".join(q) + " END", "CASE template " + " ".join(s) + " END"


_QUESTION, _SQL = _texts()
_INDEX = "row_number() OVER (ORDER BY substr(md5({0}), 1, 2), {0}) - 1"

PAIRS_CTE = f""",
kws AS (SELECT kw, {_INDEX.format('kw')} AS kw_i FROM (
         SELECT DISTINCT regexp_replace(trim(recipe_name), '[\\s0-9]+$', '') AS kw
         FROM audit_log WHERE recipe_name IS NOT NULL) WHERE kw <> ''),
us AS (SELECT usr, {_INDEX.format('usr')} AS user_i FROM (
         SELECT DISTINCT username AS usr FROM audit_log WHERE username IS NOT NULL)),
wn AS (SELECT win_a, win_b, {_INDEX.format('win_a')} AS win_i FROM (
         SELECT DISTINCT strftime(date_trunc('month', audit_time), '%Y-%m-%d') AS win_a,
                strftime(date_trunc('month', audit_time) + INTERVAL 1 MONTH, '%Y-%m-%d') AS win_b
         FROM audit_log WHERE audit_time IS NOT NULL)),
plan AS (SELECT range AS row_id, {_category()} AS category FROM range({S.N_TOTAL})),
x AS (SELECT row_id, category, {_template()} AS template,
         {_digits(2)} % (SELECT greatest(count(*), 1) FROM kws) AS kw_i,
         {_digits(3)} % (SELECT greatest(count(*), 1) FROM us) AS user_i,
         {_digits(4)} % (SELECT greatest(count(*), 1) FROM wn) AS win_i,
         [{', '.join(f"'{v}'" for v in S.LIMITS)}][{_digits(5)} % {len(S.LIMITS)} + 1] AS lim,
         {_digits(9)} AS h9
  FROM plan),
y AS (SELECT x.*, kws.kw, us.usr, wn.win_a, wn.win_b FROM x
      LEFT JOIN kws USING (kw_i) LEFT JOIN us USING (user_i) LEFT JOIN wn USING (win_i)),
z AS (SELECT row_id, category, template, {_QUESTION} AS user_query, {_SQL} AS gold_sql,
        CASE WHEN row_number() OVER (ORDER BY h9, row_id) <= {S.N_TEST} THEN 'test' ELSE 'train' END AS split
  FROM y)
"""


def _join(select: str) -> str:
    base = with_log("")
    return base.rstrip() + PAIRS_CTE.rstrip() + "\n" + select


_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in AUDIT_LOG_SCHEMA.fields)

ORACLE = {
    "synth_pairs": _join("SELECT row_id, category, template, user_query, gold_sql, split FROM z"),
    "synth_pattern_split": _join(
        f"SELECT CASE WHEN substr(md5(template), 1, 1) IN ({', '.join(map(_lit, S.HELD_DIGITS))}) THEN 'test' ELSE 'train' END "
        "AS split, template, COUNT(*) AS rows FROM z GROUP BY 1, 2"),
    "synth_leak_report": _join(
        "SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT user_query, gold_sql FROM z)) AS distinct_pairs, "
        "COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT user_query, gold_sql FROM z)) AS duplicate_rows, "
        "COUNT(*) FILTER (WHERE split = 'test') AS test_rows, "
        "(SELECT COUNT(*) FROM z t WHERE t.split = 'test' AND EXISTS (SELECT 1 FROM z r WHERE r.split = 'train' "
        "AND r.user_query = t.user_query AND r.gold_sql = t.gold_sql)) AS test_rows_in_train FROM z"),
    "synth_rejects": _join(
        "SELECT COUNT(*) AS rejects FROM z WHERE lower(gold_sql) LIKE '%update%' OR lower(gold_sql) LIKE '%delete%' "
        "OR lower(gold_sql) LIKE '%insert%' OR lower(gold_sql) LIKE '%alter%' OR lower(gold_sql) LIKE '%drop table%' "
        "OR gold_sql LIKE '%;--%' OR gold_sql LIKE '%/*%' "
        "OR length(trim(gold_sql)) - length(replace(trim(gold_sql), ';', '')) > 1"),
    "synth_jsonl": _join(f"SELECT split, '{S.ENGINE}' AS engine, {_lit(_COLUMNS)} AS table_columns, "
                         f"{_lit(S.system_text())} AS system, user_query, gold_sql, CAST(0 AS BIGINT) AS notes FROM z"),
}

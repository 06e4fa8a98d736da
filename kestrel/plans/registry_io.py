"""Registered queries for sources and sinks (S1-S16) and the load side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators import parts as PT
from kestrel.operators.load import load_rejects, load_summary, to_sheet
from kestrel.operators.parse import HEADER_NAMES, parse_log
from kestrel.operators.reports import ntz
from kestrel.operators.sessions import pair_sessions
from kestrel.plans.catalog import parsed_table
from kestrel.plans.oracle import with_log
from kestrel.schema import AUDIT_COLUMNS
from kestrel.session import scratch_dir
from kestrel.sources import lines as LN
from kestrel.sources import staged as ST
from kestrel.sources.fixture import HEADER, audit_lines

PART_ROWS = 1000
SMALL_PART_ROWS = 2
RUN_TIME = "2024-07-01 12:00:00"
SPLIT_BYTES = "65536"

_STAGED: dict = {}


def _body(spark, sf):
    return audit_lines(spark, sf).filter(~F.col("hdr"))


def _staged_folder(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STAGED:
        folder = scratch_dir(spark, "staged_csv")
        ST.write_sheet_csv(to_sheet(pair_sessions(parsed_table(spark, sf))), folder)
        _STAGED[key] = folder
    return _STAGED[key]


def scanned_lines(spark, sf):
    """The raw log written as line files and scanned back in small splits."""
    folder = scratch_dir(spark, "raw_lines")
    LN.write_line_files(audit_lines(spark, sf), folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)
    try:
        return LN.scan_lines(spark, folder, scratch_dir(spark, "lines_stage"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def q_scan_line_order(spark, sf):
    s = scanned_lines(spark, sf)
    body = PT.row_numbers(s.filter(~F.col("hdr")), ["file"])
    return body.select("file", "rn", F.split("line", r"\|").getItem(1).alias("id"))


def q_scan_headers(spark, sf):
    s = scanned_lines(spark, sf)
    return s.groupBy("file").agg(F.count(F.when(F.col("hdr"), 1)).alias("headers"),
                                 F.count(F.lit(1)).alias("lines"))


def q_scan_parse(spark, sf):
    p = parse_log(scanned_lines(spark, sf))
    return p.select("file", "id", "message", "recipe_id", "username", "skey")


def q_file_manifest(spark, sf):
    return LN.file_manifest(audit_lines(spark, sf))


def q_files_newest_first(spark, sf):
    m = LN.files_newest_first(LN.file_manifest(audit_lines(spark, sf)))
    w = Window.orderBy(F.col("y").desc_nulls_last(), F.col("m").desc_nulls_last(), F.col("file").desc())
    return m.select("file", F.row_number().over(w).cast("bigint").alias("pos"))


def q_files_in_range(spark, sf):
    return LN.files_in_range(LN.file_manifest(audit_lines(spark, sf)), "2023-12", "2024-01").select("file", "ym")


def q_files_in_range_rows(spark, sf):
    """The raw log written as line files, and only the files of two months read back."""
    folder = scratch_dir(spark, "range_lines")
    LN.write_line_files(audit_lines(spark, sf), folder)
    return LN.read_range(spark, folder, "2023-12", "2024-01").groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def _parted(spark, sf):
    return PT.part_assign(_body(spark, sf), PART_ROWS)


def q_part_counts(spark, sf):
    return _parted(spark, sf).groupBy("file", "part", "part_name").agg(F.count(F.lit(1)).alias("rows"))


def q_part_names_over_100(spark, sf):
    """Parts of two rows: hundreds of parts per file, each with a name of its own."""
    p = PT.part_assign(_body(spark, sf), SMALL_PART_ROWS)
    return p.groupBy("part_name").agg(F.min("file").alias("file"), F.max("part").alias("part"), F.count(F.lit(1)).alias("rows"))


def q_resume_parts(spark, sf):
    """Parts one and two are written, then only the absent ones; all are read back."""
    parted = _parted(spark, sf)
    path = scratch_dir(spark, "parts")
    PT.write_parts(parted.filter(F.col("part") <= 2), path, ["rn", "line"])
    PT.write_parts(PT.resume_parts(parted, spark.read.parquet(path)), path, ["rn", "line"])
    return spark.read.parquet(path).groupBy("file", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("rn").cast("bigint").alias("first_row"))


def q_output_base_v1(spark, sf):
    m = LN.file_manifest(audit_lines(spark, sf))
    return m.select("file", PT.output_base(ym=F.col("ym")).alias("base_v1"), PT.output_base().alias("base_v2"))


def _run_log(spark, sf):
    return PT.run_metrics(_parted(spark, sf), F.lit(RUN_TIME).cast("timestamp"))


def q_run_metrics(spark, sf):
    return _run_log(spark, sf)


def q_progress(spark, sf):
    return PT.progress(_run_log(spark, sf))


def q_quarantine(spark, sf):
    lines = _body(spark, sf)
    parsed = parsed_table(spark, sf).select("file", "ord", "ts", "audit_time")
    numbered = PT.row_numbers(lines, ["file"]).join(parsed, ["file", "ord"])
    bad = numbered.filter(F.col("ts").isNull() & (F.col("audit_time") != "")).select(
        "file", (F.col("rn") + 1).alias("orig_line_no"), F.col("line").alias("raw_line"),
        F.lit("BAD_TIME").alias("reason"))
    path = scratch_dir(spark, "quarantine")
    PT.quarantine(bad, path)
    return _bad_lines(spark.read.parquet(path))


def q_load_roundtrip(spark, sf):
    typed = ST.load_typed(ST.read_staged(spark, _staged_folder(spark, sf)))
    return ntz(typed.select(*AUDIT_COLUMNS))


def q_load_summary(spark, sf):
    return load_summary(ST.read_staged(spark, _staged_folder(spark, sf)))


def q_load_rejects(spark, sf):
    staged = ST.read_staged(spark, _staged_folder(spark, sf))
    return load_rejects(staged).groupBy("column").agg(F.count(F.lit(1)).alias("rejects"))


def q_load_idempotent(spark, sf):
    """Two loads of one folder: the second finds nothing new."""
    folder = _staged_folder(spark, sf)
    table, manifest = scratch_dir(spark, "log_table"), scratch_dir(spark, "load_manifest")
    ST.load_folder(spark, folder, table, manifest)
    again = ST.load_folder(spark, folder, table, manifest).agg(F.count(F.lit(1)).alias("rows_of_second_load"))
    # both sides are one-row aggregates
    return ST.read_log(spark, table, manifest).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files")).crossJoin(again)


def q_load_after_crash(spark, sf):
    """A load of two sources breaks off between its rows and its commit; a third source arrives; the
    folder is loaded again. The log holds every row once."""
    sheet = _sheet(spark, sf)
    folder, table, manifest = scratch_dir(spark, "crash_csv"), scratch_dir(spark, "log_table"), scratch_dir(spark, "load_manifest")
    ST.write_sheet_csv(sheet.filter("file <> 'misc.csv'"), folder)

    def lost(*_):
        raise ConnectionError("the commit was lost")

    commit, ST.commit_load = ST.commit_load, lost
    try:
        ST.load_folder(spark, folder, table, manifest)
    except ConnectionError:
        pass
    finally:
        ST.commit_load = commit
    unseen = ST.read_log(spark, table, manifest).agg(F.count(F.lit(1)).alias("rows_before_commit"))
    unseen = spark.createDataFrame(unseen.collect(), unseen.schema)  # one number, as of now
    ST.write_sheet_csv(sheet.filter("file = 'misc.csv'"), folder, mode="append")
    ST.load_folder(spark, folder, table, manifest)
    # both sides are one-row aggregates
    return ST.read_log(spark, table, manifest).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files"),
        F.count("session_duration").alias("sessions")).crossJoin(unseen)


def _sheet(spark, sf):
    return to_sheet(pair_sessions(parsed_table(spark, sf)))


def _typed(spark, folder, fmt="csv"):
    return ntz(ST.load_typed(ST.read_staged(spark, folder, fmt)).select(*AUDIT_COLUMNS))


def q_load_mixed_headers(spark, sf):
    """One file's columns in another order than the others'."""
    folder, sheet = scratch_dir(spark, "mixed_csv"), _sheet(spark, sf)
    other = F.col("file") == "misc.csv"
    ST.write_sheet_csv(sheet.filter(~other), folder)
    ST.write_sheet_csv(sheet.filter(other), folder, columns=AUDIT_COLUMNS[::-1], mode="append")
    return _typed(spark, folder)


def q_load_two_actions(spark, sf):
    """The parse job's own header, in which two columns are called action."""
    folder, sheet = scratch_dir(spark, "two_actions"), _sheet(spark, sf)
    line = F.to_csv(F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in AUDIT_COLUMNS]), {"quote": '"', "escape": '"'})
    body = sheet.select("file", F.lit(0).cast("bigint").alias("blk"), "ord", line.alias("line"))
    head = body.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("blk"), F.lit(-1).cast("bigint").alias("ord"),
                                                 F.lit(",".join(HEADER_NAMES)).alias("line"))
    LN.write_line_files(head.unionByName(body), folder)
    return _typed(spark, folder)


def q_load_jsonl(spark, sf):
    folder = scratch_dir(spark, "staged_jsonl")
    _sheet(spark, sf).select("file", *AUDIT_COLUMNS).write.partitionBy("file").json(folder)
    return _typed(spark, folder, "json")


def q_load_parquet(spark, sf):
    folder = scratch_dir(spark, "staged_parquet")
    _sheet(spark, sf).select("file", *AUDIT_COLUMNS).write.partitionBy("file").parquet(folder)
    return _typed(spark, folder, "parquet")


def q_same_name_files(spark, sf):
    """Two files of one base name in two folders: sessions and headers of each stay apart."""
    from kestrel.plans.load_job import load_raw_folder
    folder = scratch_dir(spark, "same_name")
    body = audit_lines(spark, sf).filter(~F.col("hdr")).withColumn("site", F.when(F.col("ord") % 2 == 0, "a").otherwise("b"))
    head = body.select("site").distinct().select("site", F.lit(-1).cast("bigint").alias("ord"), F.lit(HEADER).alias("line"))
    (head.unionByName(body.select("site", "ord", "line")).repartition("site").sortWithinPartitions("site", "ord")
     .select("site", "line").write.partitionBy("site").text(folder))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for site in ("a", "b"):
        name = [s.getPath() for s in fs.listStatus(path(f"{folder}/site={site}")) if s.getPath().getName().startswith("part-")]
        fs.rename(name[0], path(f"{folder}/site={site}/log.csv"))
    t = load_raw_folder(spark, folder, scratch_dir(spark, "same_name_table"))
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count("session_duration").alias("sessions"),
                                 F.sum("session_duration").cast("bigint").alias("seconds"))


def q_load_raw_quarantine(spark, sf):
    """S12 from the load job: lines whose time cannot be read, with their place and text."""
    from kestrel.plans.load_job import load_raw_folder, quarantine_path
    folder, table = scratch_dir(spark, "raw_folder"), scratch_dir(spark, "raw_table")
    LN.write_line_files(audit_lines(spark, sf), folder)
    load_raw_folder(spark, folder, table)
    return _bad_lines(spark.read.parquet(quarantine_path(table)))


def _bad_lines(bad):
    return bad.select("file", "orig_line_no", F.split("raw_line", r"\|").getItem(1).alias("raw_id"),
                      F.length("raw_line").cast("bigint").alias("raw_length"), "reason")


def q_rechunk_parsed(spark, sf):
    """Re-chunk the already parsed table with a caller's chunk size, written and read back."""
    path = scratch_dir(spark, "rechunked")
    PT.write_parts(PT.part_assign(parsed_table(spark, sf).select("file", "blk", "ord", "id"), 500), path, ["rn", "id"])
    return spark.read.parquet(path).groupBy("file", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("id", "rn").alias("first_id"))


def q_create_reset_log(spark, sf):
    """Create the table over a path, append the staged rows, count; reset, count."""
    path = scratch_dir(spark, "log_tbl")
    name = f"audit_log_{abs(hash(path)) % 10**8}"
    ST.create_log(spark, name, path)
    ST.append_log(ST.load_typed(ST.read_staged(spark, _staged_folder(spark, sf))), path)
    spark.sql(f"REFRESH TABLE {name}")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    loaded = spark.table(name).agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    ST.reset_log(spark, name, path)
    after = spark.table(name).agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    return spark.createDataFrame([(int(loaded), int(after))], "loaded_rows bigint, rows_after_reset bigint")


def q_load_run_log(spark, sf):
    from kestrel.plans.catalog import load_runs
    return load_runs(spark, sf).select("phase", "rows_written", "sessions", "repaired_rows",
                                       "rows_without_time", "status")


def q_load_raw_folder(spark, sf):
    """S1 -> P16 -> J1 -> S10 from a folder of raw line files."""
    from kestrel.plans.load_job import load_raw_folder
    folder = scratch_dir(spark, "raw_folder")
    LN.write_line_files(audit_lines(spark, sf), folder)
    return ntz(load_raw_folder(spark, folder, scratch_dir(spark, "raw_table")).select(*AUDIT_COLUMNS))


QUERIES = {
    "load_raw_folder": q_load_raw_folder,
    "load_run_log": q_load_run_log,
    "rechunk_parsed": q_rechunk_parsed,
    "create_reset_log": q_create_reset_log,
    "scan_line_order": q_scan_line_order,
    "scan_headers": q_scan_headers,
    "scan_parse": q_scan_parse,
    "file_manifest": q_file_manifest,
    "files_newest_first": q_files_newest_first,
    "files_in_range": q_files_in_range,
    "files_in_range_rows": q_files_in_range_rows,
    "part_counts": q_part_counts,
    "resume_parts": q_resume_parts,
    "run_metrics": q_run_metrics,
    "progress": q_progress,
    "part_names_over_100": q_part_names_over_100,
    "output_base_v1": q_output_base_v1,
    "quarantine": q_quarantine,
    "load_roundtrip": q_load_roundtrip,
    "load_summary": q_load_summary,
    "load_rejects": q_load_rejects,
    "load_idempotent": q_load_idempotent,
    "load_after_crash": q_load_after_crash,
    "load_mixed_headers": q_load_mixed_headers,
    "load_two_actions": q_load_two_actions,
    "load_jsonl": q_load_jsonl,
    "load_parquet": q_load_parquet,
    "load_raw_quarantine": q_load_raw_quarantine,
    "same_name_files": q_same_name_files,
}

_FILES = ("SELECT DISTINCT CASE e % 3 WHEN 0 THEN 'January 2024.csv' WHEN 1 THEN '2023-12 export.csv' "
          "ELSE 'misc.csv' END AS file FROM ev")
_MANIFEST = with_log(f""",
fl AS ({_FILES}),
mf AS (
  SELECT file,
    CASE WHEN regexp_matches(file, '(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s*[0-9]{{4}}')
           THEN CAST(regexp_extract(file, '(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s*([0-9]{{4}})', 2) AS INTEGER)
         WHEN regexp_matches(regexp_replace(file, '(?i)\\.csv$', ''), '([0-9]{{4}})[-_ ]?([0-9]{{2}})\\b')
           THEN CAST(regexp_extract(regexp_replace(file, '(?i)\\.csv$', ''), '([0-9]{{4}})[-_ ]?([0-9]{{2}})\\b', 1) AS INTEGER)
    END AS y,
    CASE WHEN regexp_matches(file, '(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s*[0-9]{{4}}')
           THEN list_position(['january','february','march','april','may','june','july','august','september','october','november','december'],
                lower(regexp_extract(file, '(?i)(january|february|march|april|may|june|july|august|september|october|november|december)\\s*([0-9]{{4}})', 1)))
         WHEN regexp_matches(regexp_replace(file, '(?i)\\.csv$', ''), '([0-9]{{4}})[-_ ]?([0-9]{{2}})\\b')
           THEN CAST(regexp_extract(regexp_replace(file, '(?i)\\.csv$', ''), '([0-9]{{4}})[-_ ]?([0-9]{{2}})\\b', 2) AS INTEGER)
    END AS m
  FROM fl WHERE lower(file) LIKE '%.csv')
""")


def _mf(select: str) -> str:
    return _MANIFEST.rstrip() + "\n" + select


_RN = "row_number() OVER (PARTITION BY file ORDER BY ord)"
_PARTED = ("SELECT file, ord, " + _RN + " AS rn, CAST(floor((" + _RN + " - 1) / " + str(PART_ROWS) + ") + 1 AS INTEGER) AS part "
           "FROM rows1")


def _parted_sql(select: str) -> str:
    return with_log("").rstrip() + ",\nparted AS (" + _PARTED + ")\n" + select


def _part_name(part: str) -> str:
    """Padded to two digits, never cut (lpad alone would cut a longer number)."""
    return (f"regexp_replace(file, '(?i)\\.csv$', '') || '.parced__part' || "
            f"CASE WHEN {part} < 10 THEN '0' ELSE '' END || {part}")


_RUN_LOG_SQL = """SELECT '2024-07-01 14:00:00' AS ts, 'part_done' AS phase, file, CAST(part AS VARCHAR) AS part, rows_written,
  CAST(SUM(rows_written) OVER (PARTITION BY file) AS BIGINT) AS total_rows, 'ok' AS status,
  CASE WHEN part < MAX(part) OVER (PARTITION BY file) THEN '2024-07-01 14:01:00' END AS next_resume_at
FROM (SELECT file, part, COUNT(*) AS rows_written FROM parted GROUP BY ALL)
UNION ALL
SELECT '2024-07-01 14:00:00', 'file_complete', file, '', COUNT(*), COUNT(*), 'ok', NULL FROM parted GROUP BY file"""

# Lengths of the raw lines, from the events' columns.
_RAWS = """, raws AS (
  SELECT e AS ord, CAST(length(CASE WHEN u % 10 = 0 THEN 'Solo' || u ELSE 'First' || u || ' Van Last (u' || u || ')' END)
    + 1 + length(CAST(e AS VARCHAR)) + 3
    + length(CASE form WHEN 0 THEN verb || ' Recipe ID: ''R-' || r || ''' done' WHEN 1 THEN verb || ' of recipe_' || r || ', ok'
                       WHEN 2 THEN verb || ' | Material Name = Mat ' || r || ' | Material ID = ' || (100 + r)
                       ELSE '"' || verb || ' for ""Lot ' || r || '"" | Recipe ID: R-' || r || ', end"' END)
    + 1 + length('not a date') + 1 + length(event_type)
    + 1 + length(CASE WHEN e % 7 <= 4 THEN 'recipe' ELSE 'Equipment' END)
    + CASE WHEN e % 97 = 0 THEN 0 ELSE 1 + length(CASE WHEN r % 4 = 0 THEN 'GR Buffer ' || r WHEN r % 4 = 1 THEN 'SR Column ' || r
        WHEN r % 4 = 2 THEN 'Grab mix ' || r ELSE 'Alphamab ' || r END) + 3 END AS BIGINT) AS raw_length
  FROM ev)
"""

ORACLE = {
    "load_raw_folder": with_log(f"SELECT {', '.join(AUDIT_COLUMNS)} FROM audit_log"),
    "load_run_log": with_log(
        "SELECT 'load_audit_log' AS phase, COUNT(*) AS rows_written, COUNT(session_duration) AS sessions, "
        "COUNT(reason) AS repaired_rows, COUNT(*) FILTER (WHERE audit_time IS NULL) AS rows_without_time, "
        "'done' AS status FROM audit_log"),
    "rechunk_parsed": with_log("SELECT file, CAST(floor((rn - 1) / 500) + 1 AS INTEGER) AS part, COUNT(*) AS rows, "
                               "arg_min(id, rn) AS first_id "
                               "FROM (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY ord) AS rn FROM rows1) "
                               "GROUP BY 1, 2"),
    "create_reset_log": with_log("SELECT COUNT(*) AS loaded_rows, CAST(0 AS BIGINT) AS rows_after_reset FROM audit_log"),
    "scan_line_order": with_log(f"SELECT file, CAST({_RN} AS BIGINT) AS rn, id FROM rows1"),
    "scan_headers": with_log("SELECT file, CAST(1 AS BIGINT) AS headers, COUNT(*) + 1 AS lines FROM rows1 GROUP BY file"),
    "scan_parse": with_log("SELECT file, id, message, COALESCE(recipe_id, '') AS recipe_id, "
                           "COALESCE(username, '') AS username, skey FROM rows1"),
    "file_manifest": _mf("SELECT file, y, m, CASE WHEN y IS NOT NULL THEN printf('%04d-%02d', y, m) END AS ym FROM mf"),
    "files_newest_first": _mf("SELECT file, row_number() OVER (ORDER BY y DESC NULLS LAST, m DESC NULLS LAST, "
                              "file DESC) AS pos FROM mf"),
    "files_in_range": _mf("SELECT file, printf('%04d-%02d', y, m) AS ym FROM mf WHERE y IS NOT NULL "
                          "AND printf('%04d-%02d', y, m) BETWEEN '2023-12' AND '2024-01'"),
    "files_in_range_rows": _mf("SELECT file, COUNT(*) + 1 AS lines FROM rows1 JOIN mf USING (file) WHERE y IS NOT NULL "
                               "AND printf('%04d-%02d', y, m) BETWEEN '2023-12' AND '2024-01' GROUP BY file"),
    "part_counts": _parted_sql(
        f"SELECT file, part, {_part_name('part')} AS part_name, COUNT(*) AS rows FROM parted GROUP BY ALL"),
    "part_names_over_100": with_log("").rstrip() + f""",
small AS (SELECT file, CAST(floor(({_RN} - 1) / {SMALL_PART_ROWS}) + 1 AS INTEGER) AS part FROM rows1)
SELECT {_part_name('part')} AS part_name, file, part, COUNT(*) AS rows FROM small GROUP BY file, part""",
    "output_base_v1": _mf("SELECT file, CASE WHEN y IS NOT NULL THEN printf('%04d-%02d', y, m) END || '_' || "
                          "regexp_replace(file, '(?i)\\.csv$', '') || '.parced' AS base_v1, "
                          "regexp_replace(file, '(?i)\\.csv$', '') || '.parced' AS base_v2 FROM mf"),
    "resume_parts": _parted_sql("SELECT file, part, COUNT(*) AS rows, CAST(MIN(rn) AS BIGINT) AS first_row FROM parted "
                                "GROUP BY ALL"),
    "run_metrics": _parted_sql(_RUN_LOG_SQL),
    "progress": _parted_sql(
        "SELECT '2024-07-01 14:00:00' AS ts, file AS current_file, 0 AS part, CAST(COUNT(*) AS BIGINT) AS cursor, "
        "CAST(COUNT(*) AS BIGINT) AS total_rows, 'completed' AS status, '' AS note FROM parted GROUP BY file"),
    "quarantine": _parted_sql("").rstrip() + _RAWS + (
        "SELECT parted.file, CAST(rn + 1 AS BIGINT) AS orig_line_no, CAST(parted.ord AS VARCHAR) AS raw_id, raw_length, "
        "'BAD_TIME' AS reason FROM parted JOIN raws USING (ord) WHERE parted.ord % 101 = 0"),
    "load_roundtrip": with_log(f"SELECT {', '.join(AUDIT_COLUMNS)} FROM audit_log"),
    "load_summary": with_log("SELECT file, COUNT(*) AS rows FROM audit_log GROUP BY ROLLUP (file)"),
    "load_rejects": with_log("SELECT 'audit_time' AS column, COUNT(*) AS rejects FROM rows1 WHERE ord % 101 = 0"),
    "load_idempotent": with_log("SELECT COUNT(*) AS rows, COUNT(DISTINCT file) AS files, CAST(0 AS BIGINT) AS rows_of_second_load "
                                "FROM audit_log"),
    "load_after_crash": with_log("SELECT COUNT(*) AS rows, COUNT(DISTINCT file) AS files, COUNT(session_duration) AS sessions, "
                                 "CAST(0 AS BIGINT) AS rows_before_commit FROM audit_log"),
    "same_name_files": with_log("SELECT file, COUNT(*) AS rows, COUNT(session_duration) AS sessions, "
                                "CAST(SUM(session_duration) AS BIGINT) AS seconds FROM audit_log GROUP BY file").replace(
        "CASE e % 3 WHEN 0 THEN 'January 2024.csv' WHEN 1 THEN '2023-12 export.csv' ELSE 'misc.csv' END",
        "CASE e % 2 WHEN 0 THEN 'site=a/log.csv' ELSE 'site=b/log.csv' END"),
}
for _name in ("load_mixed_headers", "load_two_actions", "load_jsonl", "load_parquet"):
    ORACLE[_name] = ORACLE["load_roundtrip"]
ORACLE["load_raw_quarantine"] = ORACLE["quarantine"]

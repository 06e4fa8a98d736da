"""Staged sheet files (CSV) and the log table sink."""

from __future__ import annotations

import csv
import time
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.load import align_schema, coerce_types
from kestrel.schema import AUDIT_COLUMNS, AUDIT_LOG_SCHEMA
from kestrel.session import path_exists
from kestrel.sources.lines import clean_path, file_id, path_under

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "false"}


def write_sheet_csv(sheet: DataFrame, folder: str, columns=AUDIT_COLUMNS, mode: str = "overwrite") -> None:
    """Stage parsed sheets as CSV, one folder per source file, with display-style header names. A large
    source is written as several part files, by as many tasks, each with the header and its rows in order."""
    display = [F.col(c).alias(c.replace("_", " ").title()) for c in columns]
    (sheet.hint("rebalance", "file").sortWithinPartitions("file", "ord")
     .select("file", *display).write.mode(mode).options(**CSV_OPTIONS).partitionBy("file").csv(folder))


def sheet_names(cells: list[str]) -> list[str]:
    """I1 for one header row: names stripped, lower-cased, blanks to ``_``; the parse job writes two
    columns called ``action``, which are told apart by position (C1)."""
    names = [c.strip().lower().replace(" ", "_") for c in cells]
    actions = [i for i, n in enumerate(names) if n == "action"]
    if len(actions) == 2:
        names[actions[0]], names[actions[1]] = "action_raw", "action_derived"
    seen: dict[str, int] = {}
    out = []
    for n in names:  # any other repeated name keeps its first column under that name
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return out


def read_staged(spark: SparkSession, folder: str, fmt: str = "csv", paths: list[str] | None = None) -> DataFrame:
    """Every staged file (``csv``, ``json`` lines or ``parquet``), all columns as text, names
    canonicalized (I1); only the empty cell becomes NULL (no other NA tokens).

    CSV files are read by their own header rows: files with equal headers form one read, and the
    reads are united by name. Only distinct headers and file names meet on the driver.
    """
    if fmt != "csv":
        reader = spark.read.option("recursiveFileLookup", "true")
        reader = reader.option("mergeSchema", "true") if fmt == "parquet" else reader.option("primitivesAsString", "true")
        raw = reader.format(fmt).load(paths or folder)
        name = file_id(spark, folder)
        return raw.select(name.alias("file"), *[F.col(f"`{c}`").cast("string").alias(n)
                                                for c, n in zip(raw.columns, sheet_names(raw.columns)) if n != "file"])
    text = spark.read.option("recursiveFileLookup", "true").text(paths or folder)
    first = (text.filter(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("i"), "value")
             .groupBy("path").agg(F.min_by("value", "i").alias("header")))
    by_header: dict[str, list[str]] = {}
    for r in first.collect():  # one row per file, as in the listing
        by_header.setdefault(r["header"], []).append(r["path"])
    out = None
    for header, paths in sorted(by_header.items()):
        names = sheet_names(next(csv.reader([header.lstrip("﻿")])))
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
        raw = (spark.read.options(**CSV_OPTIONS).option("recursiveFileLookup", "true").option("enforceSchema", "true")
               .schema(schema).csv([_decoded(p) for p in paths]))
        part = raw.select(file_id(spark, folder).alias("file"),
                          *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "file string")


def _decoded(path: str) -> str:
    return urllib.parse.unquote(path)


def load_typed(staged: DataFrame) -> DataFrame:
    """Align to the fixed 20 columns and coerce types; keeps ``file``."""
    return coerce_types(align_schema(staged, extra_keep=("file",)))


def create_log(spark: SparkSession, name: str, path: str) -> None:
    """Create the partitioned log table over ``path`` if absent."""
    cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in AUDIT_LOG_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}, file STRING, audit_month STRING) "
              f"USING parquet PARTITIONED BY (audit_month) LOCATION '{path}'")


def reset_log(spark: SparkSession, name: str, path: str) -> None:
    """Empty the table (overwrite with no rows) and re-register it."""
    empty = spark.createDataFrame([], AUDIT_LOG_SCHEMA).withColumn("file", F.lit(None).cast("string")) \
        .withColumn("audit_month", F.lit(None).cast("string"))
    empty.write.mode("overwrite").partitionBy("audit_month").parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    create_log(spark, name, path)


def append_log(typed: DataFrame, path: str) -> None:
    """Append typed rows, partitioned by month."""
    (typed.withColumn("audit_month", F.date_format("audit_time", "yyyy-MM"))
     .hint("rebalance", "audit_month").sortWithinPartitions("audit_month", "audit_time")
     .write.mode("append").partitionBy("audit_month").parquet(path))


def staged_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, size): the files of a staged folder from a listing; no file is opened."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, rows = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            rows.append((f.getPath().toString(), int(f.getLen())))
    root = clean_path(fs.makeQualified(p).toString()).rstrip("/")
    listed = spark.createDataFrame(rows, "path string, size bigint")
    return listed.select("path", path_under(F.col("path"), root).alias("file"), "size")


COMMIT_SCHEMA = "file string, size bigint, rows bigint, load_id string, seq bigint"


def commits(spark: SparkSession, manifest_path: str) -> DataFrame:
    """The commit log: one row for each file of each load that came to its end."""
    if not path_exists(spark, manifest_path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(manifest_path)


def current_commits(spark: SparkSession, manifest_path: str) -> DataFrame:
    """For every committed file its latest commit: later ones replace earlier ones, file by file."""
    latest = F.max_by(F.struct("size", "rows", "load_id", "seq"), F.struct("seq", "load_id")).alias("c")
    return commits(spark, manifest_path).groupBy("file").agg(latest).select("file", "c.*")


def read_log(spark: SparkSession, table_path: str, manifest_path: str) -> DataFrame:
    """The loaded rows: those that a file's current commit names. Rows of a load that broke off before
    its commit, or that a later load of the same file has replaced, are not seen."""
    if not path_exists(spark, table_path):
        return load_typed(spark.createDataFrame([], "file string"))
    now = current_commits(spark, manifest_path).select("file", "load_id")
    return spark.read.parquet(table_path).join(now, ["file", "load_id"])


def load_folder(spark: SparkSession, folder: str, table_path: str, manifest_path: str, fmt: str = "csv",
                again: bool = False) -> DataFrame:
    """I6 + S10: load the staged files that no commit names, or whose size has changed since (all of
    them with ``again``), and commit them. Returns the rows loaded in this call.

    Every call writes its rows under a load id of its own and then commits, in one small file, which
    files that load id holds. A call that breaks off anywhere before leaves rows that no reader sees
    (``drop_uncommitted`` clears them); the next call loads those files anew.
    """
    files = staged_files(spark, folder)
    known = current_commits(spark, manifest_path)
    if not again:
        whole = files.groupBy("file").agg(F.sum("size").alias("size"))
        files = files.join(whole.join(known.select("file", "size"), ["file", "size"], "left_anti").select("file"), "file", "left_semi")
    new = files.select("path", "file", "size").collect()  # the listing of one load
    if not new:
        return load_typed(spark.createDataFrame([], "file string"))
    load_id = uuid.uuid4().hex
    rows = load_typed(read_staged(spark, folder, fmt, [urllib.parse.unquote(r["path"]) for r in new]))
    out = rows.withColumn("audit_month", F.date_format("audit_time", "yyyy-MM")).withColumn("load_id", F.lit(load_id))
    (out.hint("rebalance", "audit_month").sortWithinPartitions("audit_month", "audit_time").write.mode("append")
     .partitionBy("load_id", "audit_month").parquet(table_path))
    loaded = spark.read.schema(out.schema).parquet(table_path).filter(F.col("load_id") == load_id)
    listed = spark.createDataFrame([(r["file"], r["size"]) for r in new], "file string, size bigint")
    commit_load(spark, listed, loaded, load_id, manifest_path)
    return loaded


def commit_load(spark: SparkSession, listed: DataFrame, loaded: DataFrame, load_id: str, manifest_path: str) -> None:
    """Append the load's files (file, size) to the commit log, as one part file: Spark moves it into
    place in one step, so a commit is there as a whole or not at all. A source of several parts
    (``file=<name>/part-...``) is one file of their summed size."""
    last = commits(spark, manifest_path).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()["seq"]
    per_file = listed.groupBy("file").agg(F.sum("size").alias("size"))
    counted = loaded.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    done = per_file.join(counted, "file", "left").select(
        "file", "size", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(load_id).alias("load_id"),
        F.lit(last + 1).cast("bigint").alias("seq"))
    done.coalesce(1).write.mode("append").parquet(manifest_path)


def drop_uncommitted(spark: SparkSession, table_path: str, manifest_path: str, older_than_s: float = 7 * 86400) -> int:
    """Delete the folders of loads that no current commit names and that nothing was written to for
    ``older_than_s`` (a running load is younger). Returns how many there were."""
    if not path_exists(spark, table_path):
        return 0
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {r["load_id"] for r in current_commits(spark, manifest_path).select("load_id").distinct().collect()}
    gone = 0
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name.startswith("load_id=") and name[8:] not in held \
                and f.getModificationTime() / 1000 <= time.time() - older_than_s:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone

"""Row numbering, output parts, resume, quarantine, run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows per output part, rows per quarantine file, minutes between parts, time zone
# of displayed times, suffix of output names.
PART_ROWS = 100_000
QUARANTINE_ROWS = 200_000
PART_PAUSE_MINUTES = 1
DISPLAY_ZONE = "Europe/Zurich"
OUTPUT_SUFFIX = ".parced"


def row_numbers(df: DataFrame, group: list[str], blk: str = "blk", ord_: str = "ord",
                out: str = "rn") -> DataFrame:
    """1-based row number within ``group`` in (blk, ord) order, without a whole group in one task.

    Rows are numbered inside each (group, blk) block; a small per-block count of
    the input itself gives each block the number of rows in earlier blocks.
    """
    before = Window.partitionBy(*group).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offs = df.groupBy(*group, blk).agg(F.count(F.lit(1)).alias("_n")).select(
        *group, blk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = df.withColumn("_run", F.row_number().over(Window.partitionBy(*group, blk).orderBy(ord_)))
    return local.join(offs, [*group, blk]).select(
        *df.columns, (F.col("_off") + F.col("_run")).alias(out))


def part_label(part):
    """Part number as text, padded to two digits and never cut."""
    p = part.cast("string")
    return F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)


def output_base(file: str | None = None, col=None, ym=None):
    """``<base>.parced`` (v2) or ``<ym>_<base>.parced`` (v1) from a ``.csv`` name."""
    c = F.col("file") if col is None else col
    base = F.regexp_replace(c, r"(?i)\.csv$", "")
    if ym is None:
        return F.concat(base, F.lit(OUTPUT_SUFFIX))
    return F.concat(ym, F.lit("_"), base, F.lit(OUTPUT_SUFFIX))


def part_assign(rows: DataFrame, n: int = PART_ROWS, group: str = "file") -> DataFrame:
    """Part number (1-based) for every row: floor((rn - 1) / n) + 1, with its part name."""
    r = row_numbers(rows, [group])
    part = (F.floor((F.col("rn") - 1) / n) + 1).cast("int")
    return r.select("*", part.alias("part"),
                    F.concat(output_base(col=F.col(group)), F.lit("__part"),
                             part_label(part)).alias("part_name"))


def write_parts(parted: DataFrame, path: str, cols: list[str]) -> None:
    """S6/S7 sink: one folder per (file, part), rows in order. Parts that are not among the rows keep
    their folders, so writing resumed parts never erases finished ones."""
    (parted.repartition("file", "part").sortWithinPartitions("file", "part", "rn")
     .select("file", "part", *cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("file", "part").parquet(path))


def resume_parts(parted: DataFrame, written: DataFrame) -> DataFrame:
    """Rows of parts not yet written (anti join on (file, part))."""
    return parted.join(written.select("file", "part").distinct(), ["file", "part"], "left_anti")


def quarantine(bad: DataFrame, path: str) -> None:
    """S12 sink: bad lines (file, orig_line_no, raw_line, reason), at most 200,000 rows per file."""
    (bad.select("file", F.col("orig_line_no").cast("bigint").alias("orig_line_no"), "raw_line",
                F.coalesce(F.col("reason"), F.lit("NOT_PROCESSED")).alias("reason"))
     .write.mode("append").option("maxRecordsPerFile", QUARANTINE_ROWS).parquet(path))


def display_time(ts):
    """A time as the run log shows it: Zurich wall clock."""
    return F.date_format(F.from_utc_timestamp(ts, DISPLAY_ZONE), "yyyy-MM-dd HH:mm:ss")


def run_metrics(parted: DataFrame, ts=None) -> DataFrame:
    """The run log, one row per written part and one per finished file.

    ts, phase, file, part, rows_written, total_rows (rows of the whole file), status, next_resume_at
    (when the next part of the same file is due; null for the last one). ``ts`` is the run's time.
    """
    ts = F.current_timestamp() if ts is None else ts
    per_part = parted.groupBy("file", "part").agg(F.count(F.lit(1)).alias("rows_written"))
    w = Window.partitionBy("file")
    due = F.when(F.col("part") < F.max("part").over(w), ts + F.expr(f"INTERVAL {PART_PAUSE_MINUTES} MINUTES"))
    done = per_part.select(
        display_time(ts).alias("ts"), F.lit("part_done").alias("phase"), "file", F.col("part").cast("string").alias("part"),
        "rows_written", F.sum("rows_written").over(w).alias("total_rows"), F.lit("ok").alias("status"),
        display_time(due).alias("next_resume_at"))
    files = per_part.groupBy("file").agg(F.sum("rows_written").alias("n")).select(
        display_time(ts).alias("ts"), F.lit("file_complete").alias("phase"), "file", F.lit("").alias("part"),
        F.col("n").alias("rows_written"), F.col("n").alias("total_rows"), F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("next_resume_at"))
    return done.unionByName(files)


def progress(run_log: DataFrame) -> DataFrame:
    """S13 progress: the latest state per file -- ts, current_file, part (0 when finished), cursor,
    total_rows, status, note."""
    done = run_log.filter("phase = 'part_done'").groupBy("file").agg(
        F.max(F.struct(F.col("part").cast("int").alias("part"), "ts")).alias("last"),
        F.sum("rows_written").alias("cursor"), F.max("total_rows").alias("total_rows"))
    whole = F.col("cursor") >= F.col("total_rows")
    return done.select(
        F.col("last.ts").alias("ts"), F.col("file").alias("current_file"),
        F.when(whole, 0).otherwise(F.col("last.part")).alias("part"), "cursor", "total_rows",
        F.when(whole, "completed").otherwise("running").alias("status"), F.lit("").alias("note"))

"""Raw audit lines derived from the ``events`` table by fixed arithmetic rules.

The reference ships no data, so the raw pipe-delimited log is generated from
``events``: one line per event, grouped into three source files, plus a header
line per file. The generation is a plain projection of ``events``, whose rows
are first dealt evenly over tasks, so it grows with the table. The DuckDB oracle computes the expected parsed
fields from the same event columns without parsing any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Source file names by event_id mod 3.
FILES = ["January 2024.csv", "2023-12 export.csv", "misc.csv"]
# Header line of every source file.
HEADER = "User ID | ID | Subseq ID | Message | Audit Time | Action | Type | Label | Version"
# Lines per ordering block inside one source file (bounds window groups).
BLOCK_LINES = 4096
# Lines that one task makes and parses.
TASK_LINES = 100_000


def _s(c: Column) -> Column:
    return c.cast("string")


def event_columns(ev: DataFrame) -> DataFrame:
    """Per-event helper columns shared by the line text and its expectations."""
    e = F.col("event_id")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        (F.regexp_extract("props", r"(-?\d+)", 1).try_cast("bigint") % 20).alias("r"),
        F.when(e % 97 == 0, F.lit(0)).otherwise(F.floor(e / 3) % 4).alias("form"),
        (F.when(F.col("event_type").isin("view", "click"), F.lit("User checked out recipe"))
         .when(F.col("event_type") == "purchase", F.lit("User checked in recipe"))
         .when((F.col("event_type") == "signup") & (e % 11 == 0), F.lit("User updated recipe"))
         .when(F.col("event_type") == "signup", F.lit("User discarded checkout"))
         .when(F.col("event_type") == "error", F.lit("System auto-check in"))
         .otherwise(F.lit("User opened log"))).alias("verb"),
    )


def spread(ev: DataFrame) -> DataFrame:
    """The events in equal shares of at most about TASK_LINES, so that the per-line parse runs in parallel.

    The splits of a scan say nothing of their rows: one task reads the whole of a row group, so a
    file of a single one is a single task's work, however many splits it has. The number of rows
    comes from the file footers; rows are dealt by their place, whatever their keys hold.
    """
    par = ev.sparkSession.sparkContext.defaultParallelism
    n = max(par, -(-ev.count() // TASK_LINES))
    return (ev.select("event_id", "ts", "user_id", "event_type", "props")
            .withColumn("_place", F.monotonically_increasing_id()).repartition(n, "_place").drop("_place"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataFrame(file, blk, ord, line, hdr) of raw audit lines, header first per file."""
    x = event_columns(spread(spark.read.parquet(f"{sf_dir}/events.parquet")))
    e, u, r, form, verb = F.col("event_id"), F.col("user_id"), F.col("r"), F.col("form"), F.col("verb")
    message = (
        F.when(form == 0, F.concat(verb, F.lit(" Recipe ID: 'R-"), _s(r), F.lit("' done")))
        .when(form == 1, F.concat(verb, F.lit(" of recipe_"), _s(r), F.lit(", ok")))
        .when(form == 2, F.concat(verb, F.lit(" | Material Name = Mat "), _s(r),
                                  F.lit(" | Material ID = "), _s(r + 100)))
        .otherwise(F.concat(F.lit('"'), verb, F.lit(' for ""Lot '), _s(r),
                            F.lit('"" | Recipe ID: R-'), _s(r), F.lit(', end"'))))
    user_cell = F.when(u % 10 == 0, F.concat(F.lit("Solo"), _s(u))).otherwise(
        F.concat(F.lit("First"), _s(u), F.lit(" Van Last (u"), _s(u), F.lit(")")))
    time_cell = (F.when(e % 101 == 0, F.lit("not a date"))
                 .when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                 .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    type_cell = F.when(e % 7 <= 2, F.lit("Recipe")).when(e % 7 <= 4, F.lit("recipe")).otherwise(F.lit("Equipment"))
    label_cell = (F.when(r % 4 == 0, F.concat(F.lit("GR Buffer "), _s(r)))
                  .when(r % 4 == 1, F.concat(F.lit("SR Column "), _s(r)))
                  .when(r % 4 == 2, F.concat(F.lit("Grab mix "), _s(r)))
                  .otherwise(F.concat(F.lit("Alphamab "), _s(r))))
    seven = [user_cell, _s(e), _s(e % 7), message, time_cell, F.col("event_type"), type_cell]
    line = F.when(e % 97 == 0, F.concat_ws("|", *seven)).otherwise(
        F.concat_ws("|", *seven, label_cell, F.lit("v1")))
    file_name = F.element_at(F.array(*[F.lit(f) for f in FILES]), (e % 3 + 1).cast("int"))
    body = x.select(
        file_name.alias("file"),
        F.floor(e / BLOCK_LINES).cast("bigint").alias("blk"),
        e.cast("bigint").alias("ord"),
        line.alias("line"),
        F.lit(False).alias("hdr"),
    )
    headers = spark.createDataFrame(
        [(f, 0, -1, HEADER, True) for f in FILES],
        "file string, blk bigint, ord bigint, line string, hdr boolean")
    return headers.unionByName(body)


def made_once(lines: DataFrame) -> DataFrame:
    """The same lines, their text made after the spread and once. Spark otherwise moves a filter on the
    text below the spread, where it makes every text a first time, by the few tasks of the scan."""
    return lines.select("file", "blk", "ord", F.explode(F.array("line")).alias("line"), "hdr")

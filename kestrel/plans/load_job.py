"""The batch load job: raw line folder -> typed, month-partitioned log table.

One pass over the raw text: every non-empty line is parsed (narrow) straight
from the scan and the parsed rows are staged once; their (split offset, row
id) order key is fixed by that single scan. Header lines (the first line of
each file) are then removed from the staged rows, sessions are paired, and
the typed rows are written as Parquet partitioned by ``audit_month``. Every
intermediate lives in the shared folder, so a lost executor re-runs only its
own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.load import to_audit_log
from kestrel.operators.parse import parse_log
from kestrel.operators.parts import QUARANTINE_ROWS, row_numbers
from kestrel.operators.sessions import pair_sessions
from kestrel.plans.catalog import write_audit_log
from kestrel.session import scratch_dir
from kestrel.sources.lines import file_id, line_block


def parse_staged(spark: SparkSession, lines: DataFrame, parsed_path: str) -> DataFrame:
    """Parse (file, blk, line) rows in one pass, stage them, and drop each file's header.

    Row ids are assigned in the same pass that writes the stage, so the order
    key (blk, ord) is fixed once. The header is the first staged row of each
    file; only first splits (blk = 0) can hold it.
    """
    with_ids = lines.select("file", "blk", F.monotonically_increasing_id().alias("ord"), "line",
                            F.lit(False).alias("hdr"))
    parse_log(with_ids, keep_bad=True).write.mode("overwrite").parquet(parsed_path)
    parsed = spark.read.parquet(parsed_path)
    head = parsed.filter(F.col("blk") == 0)
    first = head.groupBy("file").agg(F.min("ord").alias("ord"))
    return head.join(first, ["file", "ord"], "left_anti").unionByName(parsed.filter(F.col("blk") != 0))


def quarantine_path(table_path: str) -> str:
    """Where a load reports its bad lines (file, orig_line_no, raw_line, reason)."""
    return table_path + "_quarantine"


def load_raw_folder(spark: SparkSession, folder: str, table_path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    lines = raw.select(file_id(spark, folder).alias("file"), line_block().alias("blk"),
                       F.col("value").alias("line"))
    body = parse_staged(spark, lines, scratch_dir(spark, "parsed_stage"))
    # Lines whose time cannot be read stay in the table without a time, and are reported with their text.
    numbered = row_numbers(body.select("file", "blk", "ord", "raw_line"), ["file"])
    bad = numbered.filter(F.col("raw_line").isNotNull()).select(
        "file", (F.col("rn") + 1).alias("orig_line_no"), "raw_line", F.lit("BAD_TIME").alias("reason"))
    bad.write.mode("overwrite").option("maxRecordsPerFile", QUARANTINE_ROWS).parquet(quarantine_path(table_path))
    write_audit_log(to_audit_log(pair_sessions(body.drop("raw_line"))), table_path)
    return spark.read.parquet(table_path)

"""The audit-log table, built once per session and source folder.

Build = raw lines -> parse (narrow) -> session pairing (rank join) -> typed
rows, written as Parquet partitioned by ``audit_month`` into the shared folder
(``spark.checkpoint.dir``). Reports read the written table, so the lineage is
cut, a lost executor only re-runs its own scan tasks, and month filters prune
partitions.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.load import to_audit_log
from kestrel.operators.parse import parse_log
from kestrel.operators.sessions import pair_sessions
from kestrel.session import scratch_dir
from kestrel.sources.fixture import audit_lines, made_once

_LOCK = threading.RLock()
_TABLES: dict[tuple[str, str, str], str] = {}

# Rows per written Parquet file (keeps files within one task's memory).
MAX_RECORDS_PER_FILE = 2_000_000


def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log(made_once(audit_lines(spark, sf_dir)))


def _memo(spark: SparkSession, kind: str, sf_dir: str, build) -> str:
    key = (spark.sparkContext.applicationId, kind, sf_dir.rstrip("/"))
    with _LOCK:
        path = _TABLES.get(key)
        if path is None:
            path = scratch_dir(spark, kind)
            build(path)
            _TABLES[key] = path
    return path


def parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed rows written once to the shared folder (the parse is the costly narrow step;
    session pairing reads it several times, so it is materialized rather than recomputed)."""
    path = _memo(spark, "parsed", sf_dir,
                 lambda p: parsed_rows(spark, sf_dir).write.mode("overwrite").parquet(p))
    return spark.read.parquet(path)


def write_audit_log(df: DataFrame, path: str) -> dict:
    """Write the typed rows partitioned by month; returns the run metrics.

    Metrics come from an ``Observation`` on the written rows (computed by the
    write itself, no second pass) and are appended to ``<path>_runs``.
    """
    from pyspark.sql import Observation

    obs = Observation("load_audit_log")
    observed = df.observe(
        obs, F.count(F.lit(1)).alias("rows_written"),
        F.count(F.when(F.col("session_duration").isNotNull(), F.lit(1))).alias("sessions"),
        F.count(F.when(F.col("reason").isNotNull(), F.lit(1))).alias("repaired_rows"),
        F.count(F.when(F.col("audit_time").isNull(), F.lit(1))).alias("rows_without_time"))
    # Months go together, large ones split: the number of files follows the data, not the tasks.
    (observed.hint("rebalance", "audit_month").sortWithinPartitions("audit_month", "audit_time")
       .write.mode("overwrite")
       .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .partitionBy("audit_month")
       .parquet(path))
    metrics = {k: int(v) for k, v in obs.get.items()}
    spark = df.sparkSession
    run = spark.createDataFrame(
        [("load_audit_log", path, metrics["rows_written"], metrics["sessions"], metrics["repaired_rows"],
          metrics["rows_without_time"], "done")],
        "phase string, target string, rows_written bigint, sessions bigint, repaired_rows bigint, "
        "rows_without_time bigint, status string")
    run.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path + "_runs")
    return metrics


def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of the log-table build for ``sf_dir``."""
    path = _memo(spark, "audit_log", sf_dir, lambda p: write_audit_log(
        to_audit_log(pair_sessions(parsed_table(spark, sf_dir))), p))
    return spark.read.parquet(path + "_runs")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialized log table for ``sf_dir`` (built on first use in this session)."""
    path = _memo(spark, "audit_log", sf_dir, lambda p: write_audit_log(
        to_audit_log(pair_sessions(parsed_table(spark, sf_dir))), p))
    return spark.read.parquet(path)

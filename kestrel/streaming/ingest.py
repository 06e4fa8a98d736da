"""Incremental ingest of a raw line folder with Structured Streaming.

New files are picked up once, in bounded bites (``maxFilesPerTrigger``); a
micro-batch holds whole files, so session pairing inside it is exact. Each
batch is parsed in the same pass that stages it (its line ids depend on the
split layout), paired and appended under ``batch_id=<n>`` with overwrite, so a retried
epoch replaces its own output instead of duplicating it. Metrics per batch
are persisted with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.load import to_audit_log
from kestrel.operators.sessions import pair_sessions
from kestrel.sources.lines import file_id, line_block

# New files per micro-batch; a micro-batch always holds whole files. Where a source arrives as several
# chunks, the number must cover all files that arrive together, as its lines are paired within a micro-batch.
FILES_PER_TRIGGER = 64


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER,
                 latest_first: bool = False) -> DataFrame:
    """New files of ``folder`` as (file, blk, line); ``latest_first`` takes the newest files
    (by modification time) first."""
    return (spark.readStream.format("text")
            .option("maxFilesPerTrigger", files_per_trigger)
            .option("latestFirst", str(latest_first).lower())
            .option("recursiveFileLookup", "true")
            .load(folder)
            .select(file_id(spark, folder).alias("file"),
                    line_block().alias("blk"),
                    F.col("value").alias("line")))


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out: str, stage: str) -> None:
    """P16 -> J1 -> S10 for one micro-batch of whole files."""
    from kestrel.plans.load_job import parse_staged

    body = parse_staged(spark, batch, f"{stage}/parsed/batch_id={batch_id}")
    typed = to_audit_log(pair_sessions(body))
    obs = Observation(f"batch_{batch_id}")
    observed = typed.observe(obs, F.count(F.lit(1)).alias("rows_written"),
                             F.count("session_duration").alias("sessions"),
                             F.count("reason").alias("repaired_rows"))
    (observed.hint("rebalance", "audit_month").sortWithinPartitions("audit_month", "audit_time")
     .write.mode("overwrite").partitionBy("audit_month").parquet(f"{out}/batch_id={batch_id}"))
    # One metrics row per epoch, overwritten on a retry of the same epoch.
    m = obs.get
    spark.createDataFrame(
        [(int(batch_id), int(m["rows_written"]), int(m["sessions"]), int(m["repaired_rows"]))],
        "batch_id bigint, rows_written bigint, sessions bigint, repaired_rows bigint",
    ).write.mode("overwrite").parquet(f"{stage}/metrics/batch_id={batch_id}")


def stream_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, stage: str,
                  files_per_trigger: int = FILES_PER_TRIGGER):
    """Run until the folder is drained (availableNow); returns the finished query."""
    q = (stream_lines(spark, folder, files_per_trigger).writeStream
         .foreachBatch(lambda df, bid: process_batch(spark, df, bid, out, stage))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q


def batch_metrics(spark: SparkSession, stage: str) -> DataFrame:
    """Rows written, sessions and repaired rows per micro-batch (from Observations)."""
    return spark.read.parquet(f"{stage}/metrics")


def stream_metrics(spark: SparkSession, stage: str) -> DataFrame:
    """Lines read per source file and micro-batch, from the persisted rows of every epoch (the
    query's own progress list keeps the latest entries only)."""
    parsed = spark.read.parquet(f"{stage}/parsed")
    return parsed.groupBy("batch_id", "file").agg(F.count(F.lit(1)).alias("input_rows"))

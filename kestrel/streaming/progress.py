"""Every progress report of a streaming query, kept in a folder.

A query remembers its latest reports only (100 by default). The listener writes each one as a small
JSON file named after run and micro-batch, so a repeated report replaces itself, and the log can be
read while queries run or after the session has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = ("id string, runId string, name string, timestamp string, batchId bigint, numInputRows bigint, "
                   "durationMs map<string, bigint>, sources array<struct<description string, numInputRows bigint>>")


class ProgressLog(StreamingQueryListener):
    """Writes the progress of the queries in ``names`` (all, if none are given) under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, names: set[str] | None = None):
        self.spark, self.folder, self.names = spark, folder, names
        self.failed: list[str] = []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names is not None and p.name not in self.names:
            return
        try:
            self._write(f"{self.folder}/{p.runId}-{p.batchId:012d}.json", p.json)
        except Exception as e:  # a listener must not stop the others; see `failed`
            self.failed.append(f"{p.runId} {p.batchId}: {e}")

    def _write(self, target: str, text: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def wait_for_listeners(spark: SparkSession, timeout_ms: int = 60_000) -> None:
    """Wait until the reports made so far have reached the listeners (they are delivered late)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(timeout_ms)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run and micro-batch: (name, run_id, batch_id, ts, input_rows, batch_ms). A batch that
    several runs reported, as it was retried, has a row of each."""
    p = spark.read.schema(PROGRESS_SCHEMA).option("multiLine", "true").json(folder)
    return p.select("name", F.col("runId").alias("run_id"), F.col("batchId").alias("batch_id"),
                    F.to_timestamp("timestamp").alias("ts"), F.col("numInputRows").alias("input_rows"),
                    F.col("durationMs")["triggerExecution"].alias("batch_ms"))

"""Q25, estimated: row counts from the catalogue's statistics, beside what the files hold now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def analyze_table(spark: SparkSession, name: str, path: str) -> None:
    """Have the statistics of the Parquet folder ``path`` gathered under the table name ``name``.

    The name is registered for that folder on first use; month folders that came since are made
    known to the catalogue before the count. The rows stay where they are.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` USING parquet LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE `{name}`")
    spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS")


def table_estimates(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Registered name -> folder; returns (table_name, estimated_rows, bytes_analyzed, bytes_now, stale).

    ``estimated_rows`` is the count of the last ``analyze_table``, read from the catalogue without
    touching the rows; NULL for a table never analyzed. ``stale`` says that the files, as listed
    now, no longer have the bytes that were analyzed. No file is opened.
    """
    known, found = [], []
    for name, path in sorted(tables.items()):
        told = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}` AS JSON").select("json_metadata")
        told = told.select(F.lit(name).alias("table_name"), *[
            F.get_json_object("json_metadata", f"$.statistics.{field}").cast("bigint").alias(col)
            for field, col in (("num_rows", "estimated_rows"), ("size_in_bytes", "bytes_analyzed"))])
        known.append(told)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        found.append(files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_now"))
                     .select(F.lit(name).alias("table_name"), "bytes_now"))
    both = reduce(DataFrame.unionByName, known).join(reduce(DataFrame.unionByName, found), "table_name")
    return both.withColumn("stale", ~F.col("bytes_analyzed").eqNullSafe(F.col("bytes_now")))

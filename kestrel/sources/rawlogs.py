"""Raw log staging from JSON lines or Parquet, the source's own record kept as VARIANT.

No schema is inferred and none is imposed on the records: a line is parsed once into a VARIANT,
the canonical fields are read from it by path, and all else stays reachable in ``payload_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.timefmt import parse_ts, time_parts
from kestrel.sources.lines import file_id

# The canonical staging columns read from a record, with their types.
RAW_LOG_FIELDS = {"ts": "timestamp", "actor": "string", "action": "string", "object": "string",
                  "duration_ms": "bigint", "project": "string"}


def read_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, raw_line, payload_json) of every non-blank line under ``folder``; the payload of a line
    that is no JSON is NULL."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder)
    lines = raw.select(file_id(spark, folder).alias("file"), F.col("value").alias("raw_line"))
    return lines.filter(F.trim("raw_line") != "").withColumn("payload_json", F.try_parse_json("raw_line"))


def read_parquet_records(spark: SparkSession, folder: str) -> DataFrame:
    """The same shape from Parquet files: each row is one record, no line is ever bad."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    record = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(file_id(spark, folder).alias("file"), F.lit(None).cast("string").alias("raw_line"),
                       record.alias("payload_json"))


def is_record(payload: Column) -> Column:
    """Whether a payload is a JSON object (not NULL, a bare value or an array)."""
    return F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))


def raw_log_rows(records: DataFrame, source: str, paths: dict[str, str | Column]) -> DataFrame:
    """(ts, source, actor, action, object, duration_ms, project, payload_json) of every record.

    ``paths`` gives, for a canonical field, the JSON path in the record or an expression over
    ``payload_json``; a field without one, or whose value does not fit its type, is NULL. Times are
    read by the log's own time grammar (P4), in UTC.
    """
    def field(name: str, kind: str) -> Column:
        at = paths.get(name)
        if at is None:
            return F.lit(None).cast(kind)
        if isinstance(at, Column):
            return at.cast(kind)
        if kind == "timestamp":
            return parse_ts(F.col("_text"), F.col("_time"))
        return F.try_variant_get("payload_json", at, kind)

    fields = {c: field(c, kind).alias(c) for c, kind in RAW_LOG_FIELDS.items()}
    at = paths.get("ts")
    text = F.try_variant_get("payload_json", at, "string") if isinstance(at, str) else F.lit(None).cast("string")
    # The time's parts are a column of their own, so that the parse does not repeat them.
    kept = records.filter(is_record(F.col("payload_json"))).select("payload_json", text.alias("_text"))
    return kept.select("*", time_parts(F.col("_text")).alias("_time")).select(
        fields.pop("ts"), F.lit(source).alias("source"), *fields.values(), "payload_json")


def raw_log_rejects(records: DataFrame) -> DataFrame:
    """Quarantine: (file, raw_line, reason) of the lines that hold no record -- NOT_JSON (broken or cut
    off) or NOT_OBJECT (a bare value or an array)."""
    reason = F.when(F.col("payload_json").isNull(), F.lit("NOT_JSON")).otherwise(F.lit("NOT_OBJECT"))
    return records.filter(~is_record(F.col("payload_json"))).select("file", "raw_line", reason.alias("reason"))


def payload_schema(rows: DataFrame) -> DataFrame:
    """One row per source: its number of records and the merged schema of all its payloads."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"),
                                      F.schema_of_variant_agg("payload_json").alias("payload_schema"))

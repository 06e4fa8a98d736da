"""Documented-only capabilities (evaluation, raw staging, de-identification, redaction).

The reference describes these in its documentation without code; they are
built as plain DataFrame operators and labelled as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import jtrim

# Redaction patterns and their replacement tokens.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DIGITS = r"[0-9]"


def normalize_sql(c: Column) -> Column:
    """E1 normal form: lower case, whitespace runs to one space, no trailing semicolons."""
    return F.regexp_replace(F.regexp_replace(F.lower(jtrim(c)), r"\s+", " "), r"\s*;+$", "")


def exact_match(df: DataFrame, pred: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows whose normalized predicted SQL equals the normalized gold SQL."""
    hit = (normalize_sql(F.col(pred)) == normalize_sql(F.col(gold))).cast("int")
    g = df.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("rows"), F.sum(hit).alias("matches"),
                 (F.sum(hit) / F.count(F.lit(1))).alias("exact_match"))


def execution_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two results are equal as multisets (EXCEPT ALL both ways is empty)."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a"))
    right = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b"))
    # both sides are one-row aggregates (scalar attach, not a pair product)
    return left.crossJoin(right).select(
        "only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("match"))


def raw_logs(events: DataFrame) -> DataFrame:
    """The canonical raw staging shape with the JSON payload as VARIANT."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("events").alias("source"),
        F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"),
        F.col("event_id").cast("string").alias("object"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.lit(None).cast("string").alias("project"),
        F.try_parse_json("props").alias("payload_json"))


def _secret_number(secret: str, value: Column, mod: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(secret), value), 256), 1, 12), 16, 10).cast("bigint") % mod


def deidentify(log: DataFrame, salt: str, shift_secret: str, bucket: str = "hour") -> DataFrame:
    """Salted user hash, per-user time shift and per-row jitter, time bucket.

    Shift (up to 30 days) and jitter (up to a minute) come from a second secret
    that is not published, so the hash says nothing about them; the times
    keep their order within a user up to the jitter.
    """
    user = F.coalesce(F.col("user_id"), F.lit(""))
    shift = _secret_number(shift_secret, user, 30 * 86400)
    jitter = _secret_number(shift_secret, F.concat_ws("|", F.lit("row"), user, F.coalesce("id", F.lit(""))), 60)
    shifted = F.timestamp_seconds(F.unix_seconds("audit_time") + shift + jitter)
    return log.select(F.sha2(F.concat(F.lit(salt), user), 256).alias("user_hash"), shifted.alias("shifted_time"),
                      F.date_trunc(bucket, shifted).alias("time_bucket"), "action_derived",
                      "session_duration")


def redact_events(events: DataFrame) -> DataFrame:
    """E5: drop raw payloads and samples, keep counts; mask e-mails and digits in questions."""
    q = F.regexp_replace(F.regexp_replace(F.col("user_query"), EMAIL, "<email>"), DIGITS, "#")
    return events.select("ts", q.alias("user_query"), "row_count", "error", "elapsed_seconds")

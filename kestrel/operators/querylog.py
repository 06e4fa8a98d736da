"""Query-log operators: the event source (S15), A5-A8 over it, A10 guarded runs.

The event log is JSONL with a fixed schema (one object per question). For the
registered queries it is derived from ``conversations``: each user turn is a
question and the next assistant turn the model output, written as JSONL into
the shared folder and read back with the fixed schema.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.sqltext import extract_sql, guard_reason, guard_sql, guard_sql_text, looks_like_sql
from kestrel.functions.timefmt import fmt_elapsed
from kestrel.operators.guard import analysed_reason, parsed_reason
from kestrel.schema import QUERY_EVENT_SCHEMA
from kestrel.session import scratch_dir

# Rows kept per event as a result sample, time limit of a statement.
SAMPLE_ROWS = 20
STATEMENT_TIMEOUT_S = 300.0
# Size of a quantile sketch, and the rank error it keeps far within (its 99 % bound is near 0.7 %).
SKETCH_K = 400
RANK_ERROR = 0.02


def events_from_conversations(conv: DataFrame) -> DataFrame:
    """M10 events: user turn -> question, the following assistant turn -> model output."""
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    # The next turn by an equi-join on (conv_id, turn + 1): hashes on both keys,
    # so a very long conversation is spread over tasks.
    nxt = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    q = users.join(nxt, ["conv_id", "turn"], "left")
    answer = F.coalesce(F.col("next_text"), F.lit(""))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    elapsed = F.length(F.col("text")) / 100.0
    return q.select(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.col("text").alias("user_query"),
        extract_sql(answer).alias("sql"),
        F.array(F.lit("answer")).alias("columns"),
        F.length(answer).cast("bigint").alias("row_count"),
        # The answer's lines are the result's rows: up to SAMPLE_ROWS whole ones are kept.
        F.transform(F.slice(F.split(answer, "\n"), 1, SAMPLE_ROWS), lambda x: F.array(x)).alias("rows_sample"),
        F.when(answer == "", F.lit("no answer")).otherwise(F.lit("")).alias("error"),
        answer.alias("model_raw_phase_a"),
        F.lit("").alias("model_raw_phase_b"),
        fmt_elapsed(elapsed).alias("elapsed_human"),
        F.round(elapsed, 3).cast("double").alias("elapsed_seconds"),
    )


def write_events(events: DataFrame, path: str) -> None:
    """S14/S15 sink: one JSON object per line, nulls kept."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S15 source: the event log with the fixed schema (no inference)."""
    return spark.read.schema(QUERY_EVENT_SCHEMA).json(path)


def query_log_report(events: DataFrame) -> DataFrame:
    """Per day -- questions, errors, empty results, mean and max elapsed, rows returned."""
    day = F.to_date(F.substring("ts", 1, 10))
    return events.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count(F.when(F.col("error") != "", F.lit(1))).alias("errors"),
        F.count(F.when(F.col("row_count") == 0, F.lit(1))).alias("empty_results"),
        F.round(F.avg("elapsed_seconds"), 6).alias("mean_elapsed"),
        F.max("elapsed_seconds").alias("max_elapsed"),
        F.sum("row_count").alias("rows_returned"),
        F.count(F.when(guard_sql(F.col("sql")) & looks_like_sql(F.col("sql")), F.lit(1))).alias("valid_sql"),
    )


def elapsed_sketches(events: DataFrame) -> DataFrame:
    """A8, per day: (day, queries, sketch) -- a quantile sketch (KLL) of the seconds elapsed, a few
    kilobytes whatever the number of events, so a day is read once and merged into any longer span.
    Events without a day or a time elapsed take no part."""
    e = events.select(F.expr("try_to_date(substring(ts, 1, 10))").alias("day"), "elapsed_seconds").dropna()
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("queries"),
                                F.kll_sketch_agg_double("elapsed_seconds", F.lit(SKETCH_K)).alias("sketch"))


def elapsed_percentiles(sketches: DataFrame, ranks: list[float], span: str = "week") -> DataFrame:
    """(span_start, queries, p, elapsed) for every ``span`` and rank in ``ranks``, from the days'
    sketches alone; an answer's true rank lies within RANK_ERROR of ``p``."""
    merged = sketches.groupBy(F.to_date(F.date_trunc(span, "day")).alias("span_start")).agg(
        F.sum("queries").alias("queries"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"),
                                        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("elapsed"))
                               for p in ranks])).alias("q")
    return merged.select("span_start", "queries", each).select("span_start", "queries", "q.p", "q.elapsed")


def percentile_ranks(events: DataFrame, percentiles: DataFrame, span: str = "week") -> DataFrame:
    """Exact ranks of answered percentiles: ``percentiles`` with ``rank_low`` and ``rank_high``, the
    shares of the span's events below it and up to it. Two counts over the events, no sort."""
    day = F.expr("try_to_date(substring(ts, 1, 10))")
    answers = percentiles.groupBy("span_start").agg(F.collect_list(F.struct("p", "elapsed", "queries")).alias("answers"))
    e = events.select(F.to_date(F.date_trunc(span, day)).alias("span_start"), "elapsed_seconds").dropna()
    # Partial sums before the shuffle: one row per span and rank leaves each task.
    each = e.join(answers, "span_start").select("span_start", "elapsed_seconds", F.explode("answers").alias("a"))
    share = [F.sum(hit.cast("bigint")) / F.first("a.queries")
             for hit in (F.col("elapsed_seconds") < F.col("a.elapsed"), F.col("elapsed_seconds") <= F.col("a.elapsed"))]
    return each.groupBy("span_start", F.col("a.p").alias("p")).agg(
        F.first("a.queries").alias("queries"), F.first("a.elapsed").alias("elapsed"),
        share[0].alias("rank_low"), share[1].alias("rank_high"))


def last_sql(events: DataFrame) -> DataFrame:
    """S15 'last' file: the most recent non-empty SQL with its comment header."""
    e = events.filter(F.col("sql") != "")
    return e.agg(F.max_by(F.concat(F.lit("-- "), F.col("ts"), F.lit(" | "), F.col("user_query"), F.lit("\n"),
                                   F.col("sql"), F.lit(";")), F.col("ts")).alias("last_sql"))


def sql_history(events: DataFrame) -> DataFrame:
    """S15 history file: every non-empty SQL with its comment header, oldest first by ``ts``."""
    e = events.filter(F.col("sql") != "")
    return e.select("ts", F.concat(F.lit("-- "), F.col("ts"), F.lit(" | "), F.col("user_query"), F.lit("\n"),
                                   F.col("sql"), F.lit(";")).alias("entry"))


def sql_checks(texts: DataFrame, col: str = "text") -> DataFrame:
    """A5-A7 as columns over a table of texts."""
    s = extract_sql(F.col(col))
    return texts.select("*", s.alias("sql"), looks_like_sql(s).alias("looks_like_sql"),
                        guard_sql(s).alias("guard_ok"), guard_reason(s).alias("guard_reason"))


def run_guarded_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """A10: one read-only statement over registered views. It must pass the text guard, its parsed
    plan must be a query over views with allowed functions (so that analysing it runs nothing), and
    its analysed plan must read views only."""
    statement = sql.strip().rstrip(";")
    reason = guard_sql_text(sql) or parsed_reason(spark, statement)
    if reason:
        raise ValueError(reason)
    df = spark.sql(statement, args=args or {})
    if reason := analysed_reason(df):
        raise ValueError(reason)
    return df


def run_report(spark: SparkSession, sql: str, args: dict | None = None, timeout_s: float = STATEMENT_TIMEOUT_S) -> DataFrame:
    """A10: the whole guarded report under its time limit. The result is written to the shared
    folder in a job group that is cancelled when time is up, and read back; no row is collected."""
    df = run_guarded_sql(spark, sql, args)
    path = scratch_dir(spark, "report")
    with_timeout(spark, lambda: df.write.parquet(path), timeout_s)
    return spark.read.schema(df.schema).parquet(path)


def with_timeout(spark: SparkSession, action, timeout_s: float):
    """Run an action in its own job group. When time is up the group is cancelled, again and again
    until the action ends: it may not have started its next job yet."""
    sc = spark.sparkContext
    group = f"kestrel-{uuid.uuid4().hex[:8]}"
    done = threading.Event()

    def watch() -> None:
        late = not done.wait(timeout_s)
        while late and not done.is_set():
            sc.cancelJobGroup(group)
            done.wait(0.5)

    sc.setJobGroup(group, "guarded report", interruptOnCancel=True)
    threading.Thread(target=watch, daemon=True).start()
    try:
        return action()
    finally:
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)

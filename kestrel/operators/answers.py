"""Result shaping and answer text as DataFrame operators.

Results stay DataFrames: rows become JSON per row on the executors; only
bounded previews (first 20 / first 5 rows) are ever gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import jtrim

# Preview sizes and the context budget.
LIST_PREVIEW = 20
ROW_PREVIEW = 5
CONTEXT_TURNS = 3
CONTEXT_CHARS = 300


NUMBERS = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)


def iso_time(c: Column, zone: str) -> Column:
    """ISO text of a time: a fraction only if there is one, and the zone's offset."""
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.0{6}$", ""), F.lit(zone))


def _json_safe(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = iso_time(c, "+00:00")  # the session's zone is UTC
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = iso_time(c, "")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return out


def jsonify_rows(df: DataFrame) -> DataFrame:
    """A1: one JSON object per row (decimal -> float, date/time -> ISO text)."""
    return df.select(F.to_json(F.struct(*_json_safe(df)), {"ignoreNullFields": "false"}).alias("row_json"))


def result_header(df: DataFrame) -> DataFrame:
    """A1 header: {columns, total_rows} computed by an aggregate (no row gathering)."""
    cols = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.to_json(F.struct(cols.alias("columns"), F.col("total_rows"))).alias("header"))


def _ordered_preview(df: DataFrame, n: int, render: Column) -> DataFrame:
    """First ``n`` rows in the frame's order, rendered, as one array (bounded by n)."""
    seq = df.limit(n).select(F.monotonically_increasing_id().alias("_seq"), render.alias("_r"))
    return seq.agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_r"))),
                               lambda s: s["_r"]).alias("items"))


def format_answer(df: DataFrame) -> DataFrame:
    """A2: fallback answer text for a result (one row, column ``answer``).

    1x1 integral / floating value: a sentence with thousands separators, the
    full value of a float; one column named recipe_name/username: the count
    plus the first 20 items; otherwise the count plus the first 5 rows as
    ``col=value``. A missing value reads ``None``, and a lone missing number
    takes the preview branch, as does a lone decimal. The result is staged
    once by a limit of 20 rows and a count; nothing else of it is gathered.
    """
    fields = df.schema.fields
    name, kind = fields[0].name, fields[0].dataType
    total = df.agg(F.count(F.lit(1)).alias("total"))
    if len(fields) == 1 and name.lower() in ("recipe_name", "username") and not isinstance(kind, NUMBERS):
        label = "recipes" if name.lower() == "recipe_name" else "users"
        items = _ordered_preview(df, LIST_PREVIEW, F.coalesce(F.col(name).cast("string"), F.lit("None")))
        # both sides are one-row aggregates (scalar attach, not a pair product)
        return total.crossJoin(items).select(F.concat(
            F.lit("Found **"), F.col("total").cast("string"), F.lit(f"** {label}. Showing "),
            F.least(F.col("total"), F.lit(LIST_PREVIEW)).cast("string"), F.lit(":\n- "),
            F.array_join("items", "\n- ")).alias("answer"))
    preview = _preview_answer(df, total)
    if len(fields) != 1 or not isinstance(kind, NUMBERS):
        return preview
    v = F.first(F.col(name))
    txt = _grouped_float(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.format_number(v, 0)
    sentence = {"total_records": F.concat(F.lit("There are **"), txt, F.lit("** records in the system.")),
                "total_recipes": F.concat(F.lit("There are **"), txt,
                                          F.lit("** distinct recipes in the system."))}.get(
        name.lower(), F.concat(F.lit("Result: **"), txt, F.lit(f"** ({name}).")))
    one = df.agg(F.count(F.lit(1)).alias("n"), sentence.alias("s"))
    # both sides are one-row aggregates (scalar attach, not a pair product)
    return one.crossJoin(preview).select(
        F.when((F.col("n") == 1) & F.col("s").isNotNull(), F.col("s")).otherwise(F.col("answer")).alias("answer"))


def _grouped_float(v: Column) -> Column:
    """A float with all its digits (the fewest that tell it apart) and thousands separators. A whole
    one keeps ``.0``; below 0.0001 and from 1e16 on it is written with an exponent (at least two digits
    before it where Java writes so: the smallest float of all reads 4.9e-324)."""
    text, size = v.cast("string"), F.abs(v)
    number = text.try_cast("decimal(38,20)")
    whole = F.format_number(F.floor(F.abs(number)), 0)
    digits = F.rtrim(F.substring_index(number.cast("string"), ".", -1), F.lit("0"))
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, whole, F.lit("."), F.when(digits == "", F.lit("0")).otherwise(digits))
    power = F.substring_index(text, "E", -1).try_cast("int")
    short = F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"),
                     F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    short = F.when(F.abs(power) > 99, F.concat(F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.lit("e"),
                                               F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                                               F.abs(power).cast("string"))).otherwise(short)
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan"))
            .when(size == float("inf"), F.concat(sign, F.lit("inf")))
            .when((size < 1e16) & ((size >= 1e-4) | (size == 0)), plain).otherwise(short))


def _preview_answer(df: DataFrame, total: DataFrame) -> DataFrame:
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
                               for c in df.columns])
    rows = _ordered_preview(df, ROW_PREVIEW, F.concat(F.lit("- "), pairs))
    # both sides are one-row aggregates (scalar attach, not a pair product)
    return total.crossJoin(rows).select(F.concat(
        F.lit("Found **"), F.col("total").cast("string"), F.lit("** rows. Preview:\n"),
        F.array_join("items", "\n")).alias("answer"))


def answer_text(df: DataFrame, kind: str) -> DataFrame:
    """Plain presentation of a result.

    ``count``: number with thousands separators; ``hours``: two decimals;
    ``list``: one ``- item`` line per row (complete, stays a DataFrame).
    """
    c = F.col(df.columns[0])
    if kind == "count":
        return df.select(F.format_number(c, 0).alias("text"))
    if kind == "hours":
        return df.select(F.coalesce(F.format_number(c, 2), F.lit("0.00")).alias("text"))
    return df.select(F.concat(F.lit("- "), c.cast("string")).alias("text"))


def result_preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows plus the total row count on each."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    # the right side is a one-row aggregate (scalar attach to at most n rows)
    return df.limit(n).crossJoin(total)


def recent_context(conv: DataFrame, turns: int = CONTEXT_TURNS, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """A4: per conversation, the last ``turns`` (question, answer) pairs as bullets.

    System rows are dropped; pair k is the k-th user row and the first
    assistant row before the next user row. Bullets ``- User: ...`` and
    ``- Answer: ...`` (empty texts skipped) are kept while the running total of
    (length + 1) stays within ``max_chars``. The last pairs are picked with a
    per-conversation top-k, and answers are matched to them by an equi-join on
    (conv_id, owning user turn), so a long conversation never lands whole in
    one task.
    """
    c = conv.filter(F.col("role").isin("user", "assistant"))
    users = c.filter(F.col("role") == "user")
    w_desc = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = users.withColumn("k", F.row_number().over(w_desc)).filter(F.col("k") <= turns) \
        .select("conv_id", "turn", "text")
    # One row per conversation: its (at most ``turns``) last user turns.
    marks = last.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("uturns"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("a_turn"),
                                                      F.col("text").alias("a_text"))
    # Each assistant row belongs to the closest earlier user turn; only rows
    # after the first of the last user turns can answer one of them. The
    # inner equi-join on conv_id lets AQE split a very long conversation.
    owner = F.array_max(F.filter("uturns", lambda u: u < F.col("a_turn")))
    answers = (a.join(marks, "conv_id")
               .filter(F.col("a_turn") > F.element_at("uturns", 1))
               .select("conv_id", owner.alias("turn"), "a_turn", "a_text")
               .groupBy("conv_id", "turn").agg(F.min_by("a_text", "a_turn").alias("answer")))
    paired = last.join(answers, ["conv_id", "turn"], "left")
    bullets = paired.select(
        "conv_id",
        F.explode(F.array(
            F.struct(F.col("turn").alias("t"), F.lit(0).alias("o"),
                     F.when(jtrim(F.coalesce("text", F.lit(""))) != "",
                            F.concat(F.lit("- User: "), jtrim(F.col("text")))).alias("b")),
            F.struct(F.col("turn").alias("t"), F.lit(1).alias("o"),
                     F.when(jtrim(F.coalesce("answer", F.lit(""))) != "",
                            F.concat(F.lit("- Answer: "), jtrim(F.col("answer")))).alias("b")),
        )).alias("x")).select("conv_id", "x.*").filter(F.col("b").isNotNull())
    w_run = Window.partitionBy("conv_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    kept = bullets.withColumn("run", F.sum(F.length("b") + 1).over(w_run)).filter(F.col("run") <= max_chars)
    return kept.groupBy("conv_id").agg(
        F.concat(F.lit("Recent context:\n"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "o", "b"))),
                                          lambda s: s["b"]), "\n")).alias("context"))

"""Question / SQL pair synthesis as a Spark job, generated from a catalogue of reports.

Each catalogue entry says what a report measures, its fixed conditions and
which slots (keyword, user, period, row limit) it takes. Question, SQL and
system text are all rendered from these entries, so a new report is one more
entry. A fixed-size plan of rows is built with ``spark.range``; a row gets a
category by cumulative weight (T2) and its report and slot values by seeded
MD5 digits of (row, slot) (T3), which vary independently of each other and
which DuckDB repeats exactly. Slot values come from the log itself: keyword
stems of recipe names, usernames and calendar months.

A slot without any value (an empty log) leaves its condition out. Values are
quoted and, in patterns, escaped. Splits are by hash order (T4) or by report
(T5: no report on both sides); T6 reports leaks, T7 runs the SQL guard, T8
builds the nested record written as JSONL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.sqltext import guard_sql
from kestrel.schema import AUDIT_LOG_SCHEMA

# Plan size, held-out size, seed, and category weights in order.
N_TOTAL = 20000
N_TEST = 3000
SEED = 42
CATEGORIES = [
    ("basic_agg_time_or_count", 5000),
    ("text_filters_case_ins", 3000),
    ("time_windows", 3000),
    ("group_topn", 3000),
    ("hard_combos", 4000),
    ("edge_no_match", 2000),
]
ENGINE = "spark"
TABLE = "audit_log"


@dataclass(frozen=True)
class Report:
    """One catalogue entry: ``slots`` are filled in the order of SLOTS."""

    name: str
    categories: tuple[str, ...]
    title: str
    select: str
    where: tuple[str, ...]
    slots: tuple[str, ...]
    tail: str = ""


HAS_ID = "recipe_id <> ''"
WORKED = "session_duration > 0"
REPORTS = [
    Report("total_time_keyword", ("basic_agg_time_or_count",), "Session time as seconds and as hours",
           "SUM(session_duration) AS total_seconds, SUM(session_duration) / 3600.0 AS total_hours", (WORKED,), ("kw",)),
    Report("count_recipes_keyword", ("basic_agg_time_or_count", "text_filters_case_ins"), "Number of recipe ids",
           "COUNT(DISTINCT recipe_id) AS unique_recipes", (HAS_ID,), ("kw",)),
    Report("count_users", ("basic_agg_time_or_count",), "Number of user ids",
           "COUNT(DISTINCT user_id) AS users", ("user_id <> ''",), ()),
    Report("latest_recipe_rows", ("text_filters_case_ins",), "Worked log rows of type recipe, latest first", "*",
           ("LOWER(TRIM(type)) = 'recipe'", WORKED), ("limit",), "ORDER BY audit_time DESC NULLS FIRST, id NULLS FIRST, subseq_id NULLS FIRST"),
    Report("list_recipe_names", ("text_filters_case_ins",), "Recipe names in order",
           "DISTINCT TRIM(recipe_name) AS recipe_name", ("recipe_name <> ''",), ("kw",), "ORDER BY recipe_name"),
    Report("top_recipes_events_window", ("time_windows",), "Recipes by number of log rows",
           "recipe_id, recipe_name, COUNT(*) AS events", (HAS_ID,), ("window", "limit"),
           "GROUP BY recipe_id, recipe_name ORDER BY events DESC, recipe_id, recipe_name"),
    Report("hours_window", ("time_windows",), "Session hours", "SUM(session_duration) / 3600.0 AS total_hours",
           (WORKED,), ("window",)),
    Report("top_recipes_events", ("group_topn",), "Recipes by number of log rows, whole log",
           "recipe_id, recipe_name, COUNT(*) AS events", (HAS_ID,), ("limit",),
           "GROUP BY recipe_id, recipe_name ORDER BY events DESC, recipe_id, recipe_name"),
    Report("top_users_hours", ("group_topn",), "Users by session hours",
           "username, SUM(session_duration) / 3600.0 AS total_hours", ("username <> ''", WORKED), ("limit",),
           "GROUP BY username ORDER BY total_hours DESC, username"),
    Report("user_time_keyword", ("hard_combos",), "Session hours of one user",
           "SUM(session_duration) / 3600.0 AS total_hours", (WORKED,), ("user", "kw", "window")),
    Report("user_recipes", ("hard_combos",), "Recipe ids one user worked on", "DISTINCT recipe_id", (HAS_ID, WORKED),
           ("user", "window", "limit"), "ORDER BY recipe_id"),
    Report("list_recipes_nomatch", ("edge_no_match",), "Recipe ids and names under a name that does not occur",
           "DISTINCT recipe_id, recipe_name", (HAS_ID,), ("absent",), "ORDER BY recipe_id, recipe_name"),
]
# Every slot in the order its condition is written: wording in the question, condition in the SQL.
# {0} and {1} are the slot's values; the SQL of a pattern takes the escaped value.
SLOTS = {
    "user": ("user name is '{0}'", "username = '{0}'"),
    "kw": ("recipe name contains '{0}'", "recipe_name ILIKE '%{0}%'"),
    "absent": ("recipe name contains '{0}??'", "recipe_name ILIKE '%{0}??%'"),
    "window": ("audit time from {0} up to, not including, {1}", "audit_time >= '{0}' AND audit_time < '{1}'"),
    "limit": ("at most {0} rows", None),
}
LIMITS = [10, 20, 50, 100, 200]


def system_text() -> str:
    """What the catalogue can answer, and the conventions its SQL follows."""
    titles = sorted({r.title for r in REPORTS})
    return (f"{ENGINE} SQL over the table {TABLE}; one SELECT per question. Measures: " + "; ".join(titles)
            + f". Conditions: {'; '.join(sql for _, sql in SLOTS.values() if sql)}.")


def slot_digits(row_id: Column, slot: int) -> Column:
    """Seeded 32-bit number of (row, slot), unrelated between slots."""
    key = F.concat_ws("|", F.lit(str(SEED)), row_id.cast("string"), F.lit(str(slot)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def indexed(df: DataFrame, col: str, idx: str) -> DataFrame:
    """Dense 0-based index of distinct values, in (MD5 block, value) order; each of the 256 blocks is
    numbered by itself and shifted by the sizes of the earlier ones."""
    b = df.withColumn("_b", F.substring(F.md5(F.col(col).cast("string")), 1, 2))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = b.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(col))
    return b.withColumn("_r", within).join(offs, "_b").select(*df.columns, (F.col("_o") + F.col("_r") - 1).alias(idx))


def parameter_frames(log: DataFrame) -> dict[str, DataFrame]:
    kw = (log.filter(F.col("recipe_name").isNotNull())
          .select(F.regexp_replace(F.trim("recipe_name"), r"[\s0-9]+$", "").alias("kw"))
          .filter(F.col("kw") != "").distinct())
    users = log.filter(F.col("username").isNotNull()).select(F.col("username").alias("user")).distinct()
    months = (log.filter(F.col("audit_time").isNotNull())
              .select(F.date_trunc("month", "audit_time").cast("date").alias("m0")).distinct()
              .select(F.date_format("m0", "yyyy-MM-dd").alias("win_a"),
                      F.date_format(F.add_months("m0", 1), "yyyy-MM-dd").alias("win_b")))
    return {"kw": indexed(kw, "kw", "kw_i"), "user": indexed(users, "user", "user_i"),
            "win": indexed(months, "win_a", "win_i")}


def category_plan(spark: SparkSession) -> DataFrame:
    """Row ids 0..N-1 with a category by cumulative weight (padded with the last)."""
    cat, bound = F.lit(CATEGORIES[-1][0]), sum(w for _, w in CATEGORIES)
    for name, w in reversed(CATEGORIES):
        cat = F.when(F.col("row_id") < bound, F.lit(name)).otherwise(cat)
        bound -= w
    return spark.range(N_TOTAL).withColumnRenamed("id", "row_id").withColumn("category", cat)


def of_category(category: str) -> list[Report]:
    return [r for r in REPORTS if category in r.categories]


def sample_pairs(spark: SparkSession, log: DataFrame) -> DataFrame:
    """T1+T3: one (row_id, category, template, user_query, gold_sql) per plan row."""
    p = parameter_frames(log)
    plan, rid = category_plan(spark), F.col("row_id")
    template = F.lit(None).cast("string")
    for c, _ in CATEGORIES:
        names = [r.name for r in of_category(c)]
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (slot_digits(rid, 1) % len(names) + 1).cast("int"))
        template = F.when(F.col("category") == c, pick).otherwise(template)
    x = plan.withColumn("template", template)
    for slot, (key, df) in enumerate(p.items(), start=2):
        n = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias(f"{key}_n"))  # one row, attached to each plan row
        x = x.crossJoin(n).withColumn(f"{key}_i", slot_digits(rid, slot) % F.col(f"{key}_n")).join(df, f"{key}_i", "left")
    x = x.withColumn("limit", F.element_at(F.array(*[F.lit(str(v)) for v in LIMITS]),
                                           (slot_digits(rid, 5) % len(LIMITS) + 1).cast("int")))
    x = x.withColumns({"user_sql": quoted(F.col("user")), "kw_sql": pattern_text(F.col("kw"))})
    return x.select("row_id", "category", "template", *_texts())


def fill(pattern: str, *values: Column) -> Column:
    """A pattern with {0}, {1} replaced; null if a value is null."""
    out, rest = [], pattern
    for i, v in enumerate(values):
        head, _, rest = rest.partition("{%d}" % i)
        out += [F.lit(head), v]
    return F.concat(*out, F.lit(rest))


def quoted(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def pattern_text(c: Column) -> Column:
    """A value inside a LIKE pattern of a SQL literal: wildcards and backslashes lose their meaning."""
    e = F.replace(c, F.lit("\\"), F.lit("\\\\\\\\"))
    return quoted(F.replace(F.replace(e, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")))


def _texts() -> list[Column]:
    """Question and SQL of a row, chosen by its report."""
    values = {"user": [F.col("user")], "kw": [F.col("kw")], "absent": [F.col("kw")],
              "window": [F.col("win_a"), F.col("win_b")], "limit": [F.col("limit")]}
    in_sql = values | {"user": [F.col("user_sql")], "kw": [F.col("kw_sql")], "absent": [F.col("kw_sql")]}
    question = sql = F.lit(None).cast("string")
    for r in REPORTS:
        slots = [s for s in SLOTS if s in r.slots]
        said = [fill(SLOTS[s][0], *values[s]) for s in slots]
        cond = [F.lit(w) for w in r.where]
        cond += [fill(SLOTS[s][1], *in_sql[s]) for s in slots if SLOTS[s][1]]
        # array_join leaves out the conditions whose slot has no value.
        q = F.concat_ws(": ", F.lit(r.title), F.nullif(F.array_join(F.array(*said), ", "), F.lit(""))) if said else F.lit(r.title)
        s = F.concat(F.lit(f"SELECT {r.select} FROM {TABLE} WHERE "), F.array_join(F.array(*cond), " AND "),
                     F.lit(" " + r.tail if r.tail else ""),
                     F.concat(F.lit(" LIMIT "), F.col("limit")) if "limit" in r.slots else F.lit(""), F.lit(";"))
        mine = F.col("template") == r.name
        question, sql = F.when(mine, q).otherwise(question), F.when(mine, s).otherwise(sql)
    return [question.alias("user_query"), sql.alias("gold_sql")]


def random_split(pairs: DataFrame) -> DataFrame:
    """T4: order by a seeded hash; the first N_TEST rows are test, the rest train.

    The test set is a distributed top-k (per-partition top N_TEST, then a
    merge) joined back by row id, so no single task sorts the whole plan.
    """
    h = slot_digits(F.col("row_id"), 9)
    test = pairs.select("row_id", h.alias("_h")).orderBy("_h", "row_id").limit(N_TEST) \
        .select("row_id", F.lit("test").alias("split"))
    return pairs.join(test, "row_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def pattern_split(pairs: DataFrame) -> DataFrame:
    """T5: hold out whole reports, by an MD5 digit of the report's name."""
    held = F.substring(F.md5(F.col("template")), 1, 1).isin(*HELD_DIGITS)
    return pairs.withColumn("split", F.when(held, F.lit("test")).otherwise(F.lit("train")))


HELD_DIGITS = ("0", "1", "2", "3")


def leak_report(split_pairs: DataFrame) -> DataFrame:
    """Rows, distinct pairs, duplicate rows, test rows whose pair also occurs in train."""
    key = ["user_query", "gold_sql"]
    train = split_pairs.filter(F.col("split") == "train").select(*key).distinct()
    test = split_pairs.filter(F.col("split") == "test")
    leaked = test.join(train, key, "left_semi").agg(F.count(F.lit(1)).alias("test_rows_in_train"))
    stats = split_pairs.agg(F.count(F.lit(1)).alias("rows"),
                            F.count_distinct(*[F.col(k) for k in key]).alias("distinct_pairs"),
                            F.count(F.when(F.col("split") == "test", F.lit(1))).alias("test_rows"))
    # both sides are one-row aggregates (scalar attach, not a pair product)
    return stats.crossJoin(leaked).select(
        "rows", "distinct_pairs", (F.col("rows") - F.col("distinct_pairs")).alias("duplicate_rows"),
        "test_rows", "test_rows_in_train")


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose SQL fails the guard (expected: none)."""
    return pairs.filter(~guard_sql(F.col("gold_sql")))


def pair_records(pairs: DataFrame) -> DataFrame:
    """The nested training record (schema block, system text, question, SQL, notes)."""
    cols = [f"{f.name} {f.dataType.simpleString().upper()}" for f in AUDIT_LOG_SCHEMA.fields]
    schema = F.struct(F.lit(ENGINE).alias("engine"),
                      F.struct(F.struct(F.array(*[F.lit(c) for c in cols]).alias("columns")).alias(TABLE))
                      .alias("tables"))
    return pairs.select("split", schema.alias("schema"), F.lit(system_text()).alias("system"), "user_query",
                        "gold_sql", F.array().cast("array<string>").alias("notes"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per line, one folder per split."""
    records.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)

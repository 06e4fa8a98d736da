import random

from pyspark.sql import functions as F

from kestrel.functions.sqltext import extract_sql, guard_sql, looks_like_sql
from kestrel.operators import answers as A
from kestrel.operators.parts import row_numbers
from kestrel.sources.lines import file_manifest


def test_extract_sql(spark):
    cases = {
        "select 1;": "select 1",
        "```\nselect 2\n```": "select 2",
        "text ```sql\nselect 3;;\n``` more": "select 3",
        "```\nfirst\n``` mid ```SQL\nselect 4\n```": "select 4",
        "```sql``` tail": "",
        "  plain text  ": "plain text",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", extract_sql(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_guard_and_shape(spark):
    rows = [("SELECT a FROM t", True, True), ("select updated_at from t", False, True),
            ("select 1; select 2;", False, True), ("select /* x */ 1 from t", False, True),
            ("with x as (select 1) select * from x", True, True), ("hello", True, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    out = df.select(guard_sql(F.col("s")).alias("g"), looks_like_sql(F.col("s")).alias("l")).collect()
    assert [(r.g, r.l) for r in out] == [(r[1], r[2]) for r in rows]


def test_format_answer_branches(spark):
    one = spark.createDataFrame([(1234567,)], "total_recipes bigint")
    assert A.format_answer(one).first().answer == "There are **1,234,567** distinct recipes in the system."
    other = spark.createDataFrame([(42,)], "n bigint")
    assert A.format_answer(other).first().answer == "Result: **42** (n)."
    names = spark.createDataFrame([(f"r{i:02d}",) for i in range(25)], "recipe_name string").orderBy("recipe_name")
    ans = A.format_answer(names).first().answer
    assert ans.startswith("Found **25** recipes. Showing 20:\n- r00\n- r01") and ans.endswith("- r19")
    rows = spark.createDataFrame([(i, f"x{i}", None) for i in range(7)], "a int, b string, c string").orderBy("a")
    ans = A.format_answer(rows).first().answer
    assert ans.splitlines()[0] == "Found **7** rows. Preview:" and ans.splitlines()[1] == "- a=0, b=x0, c=None"
    assert len(ans.splitlines()) == 6


def test_recent_context(spark):
    rows = [(1, 0, "system", "sys"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
            (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (1, 6, "user", "q4"), (1, 7, "assistant", "a4"),
            (2, 0, "user", "x" * 400), (2, 1, "assistant", "short")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.context for r in A.recent_context(conv).collect()}
    assert got[1] == "Recent context:\n- User: q2\n- User: q3\n- Answer: a3\n- User: q4\n- Answer: a4"
    assert 2 not in got  # the first bullet alone is over the budget

def test_file_manifest(spark):
    names = ["January 2024.csv", "2024_01 x.CSV", "202401.csv", "notes.txt", "misc.csv", "report march2023.csv"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.file: r.ym for r in file_manifest(df).collect()}
    assert got == {"January 2024.csv": "2024-01", "2024_01 x.CSV": "2024-01", "202401.csv": "2024-01",
                   "misc.csv": None, "report march2023.csv": "2023-03"}


def test_row_numbers_across_blocks(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), i // 7, i) for i in rnd.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "file string, blk bigint, ord bigint")
    got = {(r.file, r.ord): r.rn for r in row_numbers(df, ["file"]).collect()}
    exp = {}
    for f in "ab":
        for k, (_, _, o) in enumerate(sorted(r for r in rows if r[0] == f), start=1):
            exp[(f, o)] = k
    assert got == exp

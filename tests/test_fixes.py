"""Hand rows for behaviour that the derived log cannot show."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kestrel.functions.timefmt import parse_ts
from kestrel.operators import answers as A
from kestrel.operators import synth as S
from kestrel.operators.evaluation import deidentify
from kestrel.operators.parts import part_assign, part_label, row_numbers
from kestrel.plans.load_job import load_raw_folder, quarantine_path
from kestrel.session import scratch_dir
from kestrel.sources import staged as ST
from kestrel.sources.lines import scan_lines

HEADER = "User ID | ID | Subseq ID | Message | Audit Time | Action | Type | Label | Version"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_same_name_in_two_folders(spark):
    d = tempfile.mkdtemp(prefix="kestrel-same-")
    out = "Ann (ann)|{}|0|User checked {} recipe Recipe ID: 'R-1'|2024-03-01 {}:00:00|x|Recipe|GR A|v1\n"
    write(f"{d}/site=a/log.csv", HEADER + "\n" + out.format(1, "out", "10"))
    write(f"{d}/site=b/log.csv", HEADER + "\n" + out.format(2, "in", "11") + "Bob|3|0|note|12:30:00|x|Equipment|l|v1\n")
    lines = scan_lines(spark, d, scratch_dir(spark, "t"))
    assert {(r.file, r.hdr) for r in lines.collect()} == {(f"site={s}/log.csv", h) for s in "ab" for h in (True, False)}
    table = scratch_dir(spark, "t")
    t = load_raw_folder(spark, d, table)
    assert sorted(r.id for r in t.collect()) == ["1", "2", "3"] and t.filter("session_duration is not null").count() == 0
    bad = spark.read.parquet(quarantine_path(table)).collect()
    assert [(r.file, r.orig_line_no, r.raw_line, r.reason) for r in bad] == [
        ("site=b/log.csv", 3, "Bob|3|0|note|12:30:00|x|Equipment|l|v1", "BAD_TIME")]


def test_sheets_with_different_headers_and_two_actions(spark):
    d = tempfile.mkdtemp(prefix="kestrel-sheets-")
    write(f"{d}/a.csv", "User ID,Message,Audit Time\nu1,\"hello, you\",2024-01-01 00:00:00\n")
    write(f"{d}/b.csv", "message,user_id,extra\nbye,u2,z\n")
    write(f"{d}/sub/a.csv", "id,Action,type,action\n7,raw,Recipe,derived words\n")
    rows = {r.file: r for r in ST.load_typed(ST.read_staged(spark, d)).collect()}
    assert (rows["a.csv"].user_id, rows["a.csv"].message, rows["b.csv"].user_id, rows["b.csv"].message) == ("u1", "hello, you", "u2", "bye")
    assert (rows["sub/a.csv"].action_raw, rows["sub/a.csv"].action_derived, rows["sub/a.csv"].type) == ("raw", "derived words", "Recipe")


def test_load_reads_only_new_files_and_survives_a_broken_load(spark):
    d = tempfile.mkdtemp(prefix="kestrel-inc-")
    table, manifest = scratch_dir(spark, "t"), scratch_dir(spark, "m")
    write(f"{d}/a.csv", "id\n1\n2\n")
    assert ST.load_folder(spark, d, table, manifest).count() == 2
    write(f"{d}/b.csv", "id\n3\n")
    # The rows were written but the manifest was not: the same load again replaces its own rows.
    lost = scratch_dir(spark, "m")
    spark.read.parquet(manifest).write.partitionBy("load_id").parquet(lost)
    assert ST.load_folder(spark, d, table, lost).count() == 1
    assert ST.load_folder(spark, d, table, manifest).count() == 1
    assert sorted(r.id for r in ST.read_log(spark, table, manifest).collect()) == ["1", "2", "3"]
    assert ST.load_folder(spark, d, table, manifest).count() == 0


def test_time_forms(spark):
    rows = [("12:30:00", None), ("T12:30", None), ("3/5/2024, 10:00:00 AM", "2024-03-05 10:00:00"), ("3/5/2024, 10:00:00 PM", "2024-03-05 22:00:00"),
            ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05 10:00:00"), ("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T10:00:00+01:00", "2024-03-05 09:00:00"),
            ("2024-03-05 10:00:00 x", "2024-03-05 10:00:00"), ("", None), (None, None), ("soon", None)]
    df = spark.createDataFrame(rows, "s string, want string")
    assert [(r.s, r.got) for r in df.select("s", parse_ts(F.col("s")).cast("string").alias("got")).collect()] == rows


def test_part_labels_are_never_cut(spark):
    df = spark.createDataFrame([("big.csv", 0, i) for i in range(240)], "file string, blk bigint, ord bigint")
    names = {r.part_name for r in part_assign(df, 2).collect()}
    assert len(names) == 120 and {"big.parced__part01", "big.parced__part10", "big.parced__part100"} <= names
    assert spark.range(1).select(part_label(F.lit(1234)).alias("p")).first().p == "1234"
    plan = row_numbers(df, ["file"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 4


@pytest.mark.parametrize("value, text", [(1 / 3, "Result: **0.3333333333333333** (x)."), (1234.0, "Result: **1,234.0** (x)."),
                                         (-0.5, "Result: **-0.5** (x)."), (None, "Found **1** rows. Preview:\n- x=None")])
def test_format_answer_of_one_number(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert A.format_answer(df).first().answer == text


def test_format_answer_shows_missing_items(spark):
    df = spark.createDataFrame([("a",), (None,)], "username string").orderBy(F.col("username").asc_nulls_last())
    assert A.format_answer(df).first().answer == "Found **2** users. Showing 2:\n- a\n- None"


def test_shift_cannot_be_read_off_the_hash(spark):
    log = spark.createDataFrame([("u", str(i), f"2024-01-01 00:00:{i:02d}", "a", 1) for i in range(20)],
                                "user_id string, id string, t string, action_derived string, session_duration int")
    log = log.withColumn("audit_time", F.col("t").cast("timestamp"))
    a, b = (deidentify(log, "salt", s).collect() for s in ("one", "two"))
    assert {r.user_hash for r in a} == {r.user_hash for r in b} and {r.shifted_time for r in a} != {r.shifted_time for r in b}


def test_synthesis_slots_are_independent_and_quoted(spark):
    rows = [(f"K{'abcd'[i]} 1", f"O'Brien{i}", "2024-01-05 00:00:00") for i in range(4)] + [("50%_\\x 2", "z", "2024-02-05 00:00:00")]
    log = spark.createDataFrame(rows, "recipe_name string, username string, t string").withColumn("audit_time", F.col("t").cast("timestamp"))
    p = S.sample_pairs(spark, log)
    total = p.filter("template = 'total_time_keyword'").select("user_query").distinct().count()
    count = p.filter("template = 'count_recipes_keyword'").select("user_query").distinct().count()
    assert total == count == 5
    both = p.filter("template = 'user_time_keyword'").select("user_query").distinct().count()
    assert both == 5 * 5 * 2
    sql = {r.gold_sql for r in p.select("gold_sql").distinct().collect()}
    log.select("*", F.lit("r").alias("recipe_id"), F.lit(3600).alias("session_duration")).createOrReplaceTempView("audit_log")
    hit = [s for s in sql if s.startswith("SELECT SUM(session_duration) AS total_seconds") and "50" in s]
    assert len(hit) == 1 and spark.sql(hit[0].rstrip(";")).first().total_seconds == 3600
    mine = [s for s in sql if "O''Brien1" in s and "Kb" in s and s.startswith("SELECT SUM")]
    assert mine and any(spark.sql(s.rstrip(";")).first()[0] == 1.0 for s in mine)
    split = S.pattern_split(p)
    assert split.select("template", "split").distinct().count() == len(S.REPORTS)
    assert {r.split for r in split.select("split").distinct().collect()} == {"train", "test"}


def test_synthesis_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "recipe_name string, username string, audit_time timestamp")
    p = S.sample_pairs(spark, empty)
    assert p.count() == S.N_TOTAL and p.filter("user_query is null or gold_sql is null").count() == 0

import datetime as dt

from pyspark.sql import functions as F

from kestrel.operators import reports as R
from kestrel.operators.load import coerce_int, coerce_ts
from kestrel.schema import AUDIT_LOG_SCHEMA


def _log(spark, rows):
    full = []
    for r in rows:
        d = {f.name: None for f in AUDIT_LOG_SCHEMA.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in AUDIT_LOG_SCHEMA.fields))
    df = spark.createDataFrame(full, AUDIT_LOG_SCHEMA)
    return df.withColumn("audit_month", F.date_format("audit_time", "yyyy-MM"))


def test_latest_rows_null_time_first_and_ties(spark):
    t0 = dt.datetime(2024, 1, 5, 10, 0, 0)
    rows = [{"id": "b", "type": "Recipe", "session_duration": 5, "audit_time": t0},
            {"id": "a", "type": "recipe ", "session_duration": 5, "audit_time": t0},
            {"id": "z", "type": "RECIPE", "session_duration": 7, "audit_time": None},
            {"id": "c", "type": "Equipment", "session_duration": 9, "audit_time": t0},
            {"id": "d", "type": "recipe", "session_duration": 0, "audit_time": t0}]
    got = [r.id for r in R.latest_recipe_rows(_log(spark, rows), 3).collect()]
    assert got == ["z", "a", "b"]


def test_nomatch_is_typed_and_empty(spark):
    rows = [{"recipe_id": "R-1", "recipe_name": "GR Buffer 1"}]
    df = R.list_recipes_nomatch(_log(spark, rows), "buffer")
    assert df.count() == 0 and df.columns == ["recipe_id", "recipe_name"]


def test_match_names_escapes_wildcards(spark):
    rows = [{"recipe_name": n} for n in ["50% mix", "50x mix", "a_b", "axb", "back\\slash", "mixed"]]
    t = _log(spark, rows)
    assert [r.recipe_name for r in R.match_names(t, "starts", "50%").collect()] == ["50% mix"]
    assert [r.recipe_name for r in R.match_names(t, "contains", "_").collect()] == ["a_b"]
    assert [r.recipe_name for r in R.match_names(t, "ends", "\\slash").collect()] == ["back\\slash"]
    assert [r.recipe_name for r in R.match_names(t, "contains", "MIX").collect()] == ["50% mix", "50x mix", "mixed"]


def test_quarter_and_date_windows():
    assert R.quarter_window(2024, 4) == ("2024-10-01 00:00:00", "2025-01-01 00:00:00")
    assert R.quarter_window(2025, 1) == ("2025-01-01 00:00:00", "2025-04-01 00:00:00")
    assert R.date_window("2024-02-28", "2024-02-29") == ("2024-02-28 00:00:00", "2024-03-01 00:00:00")


def test_coerce_int_and_ts(spark):
    df = spark.createDataFrame([("28000",), ("12.5",), ("abc",), ("",), (" 7 ",)], "v string")
    assert [r.i for r in df.select(coerce_int(F.col("v")).alias("i")).collect()] == [28000, None, None, None, 7]
    ts = spark.createDataFrame([("2024-01-05T10:00:00.000Z",), ("nope",), ("",)], "v string")
    out = [r.t for r in ts.select(coerce_ts(F.col("v")).alias("t")).collect()]
    assert out == [dt.datetime(2024, 1, 5, 10, 0), None, None]

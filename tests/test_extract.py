from pyspark.sql import functions as F

from kestrel.functions import extract as X


def _one(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.o for r in df.select(fn(F.col("v")).alias("o")).collect()]


def test_recipe_id(spark):
    vals = ["Recipe ID: 'R-1' done", "x Recipe ID: R-2, end", "of recipe_abc, ok", "Recipe ID: ' ' x",
            "Recipe ID: 'A|B'", "nothing here", "RECIPE id: r9|z"]
    assert _one(spark, X.recipe_id, vals) == ["R-1", "R-2", "recipe_abc", "", "A", "", "r9"]


def test_split_user(spark):
    vals = ["Solo", "Ann Lee", "Ann van Lee", "Ann Lee (alee)", "Ann Lee ( a lee )", "", "(login)"]
    out = [(r.name1, r.name2, r.username) for r in _one(spark, X.split_user, vals)]
    assert out == [("Solo", "", ""), ("Ann", "Lee", ""), ("Ann", "van Lee", ""), ("Ann", "Lee", "alee"),
                   ("Ann", "Lee", "a lee"), ("", "", ""), ("(login)", "", "login")]


def test_action_derived(spark):
    assert _one(spark, X.action_derived, ["a b", "  a\tb  c d e", "", "one two three four five"]) == \
        ["a b", "a b c d", "", "one two three four"]


def test_start_end_flags(spark):
    vals = ["User checked out recipe x", "Xchecked out recipe", "CHECKED OUT RECIPE",
            "checked out recipe and checked in recipe", "System auto-check in", "discarded checkouts"]
    st = _one(spark, X.is_start, vals)
    en = _one(spark, X.is_end, vals)
    au = _one(spark, X.is_auto_end, vals)
    assert st == [True, False, True, True, False, False]
    assert en == [False, False, False, True, True, False]
    assert au == [False, False, False, False, True, False]

import datetime as dt

from pyspark.sql import functions as F

from kestrel.functions.timefmt import fmt_elapsed, iso_utc, parse_ts, time_parts


def test_parse_ts(spark):
    vals = ["2024-01-05T10:20:30.123Z", "2024-01-05T10:20:30+02:00", "2024-01-05 10:20:30",
            "2024-01-05T10:20:30.123456Z", "", "garbage", "2024-01-05 10:20:30 trailing", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = [r.t for r in df.select(parse_ts(F.col("v")).alias("t")).collect()]
    assert out[0] == dt.datetime(2024, 1, 5, 10, 20, 30, 123000)
    assert out[1] == dt.datetime(2024, 1, 5, 8, 20, 30)
    assert out[2] == dt.datetime(2024, 1, 5, 10, 20, 30)
    assert out[3] == dt.datetime(2024, 1, 5, 10, 20, 30, 123000)
    assert out[4] is None and out[5] is None and out[7] is None
    assert out[6] == dt.datetime(2024, 1, 5, 10, 20, 30)


def test_iso_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 10, 20, 30, 123000),)], "t timestamp")
    assert df.select(iso_utc(F.col("t")).alias("s")).first().s == "2024-01-05T10:20:30.123Z"


def test_fmt_elapsed(spark):
    vals = [0.0, 0.5, 1.5, 2.5, 59.6, 60.0, 3599.0, 3600.0, 90061.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = [r.s for r in df.select(fmt_elapsed(F.col("v")).alias("s")).collect()]
    assert out == ["0s", "0s", "2s", "2s", "1m 00s", "1m 00s", "59m 59s", "1h 00m 00s", "25h 01m 01s"]


# Forms a browser's date parser reads; the wanted UTC times are worked out by hand.
WRITTEN = [
    ("Tue, 05 Mar 2024 10:00:00 +0200", "2024-03-05 08:00:00"), ("March 5, 2024 10:00:00", "2024-03-05 10:00:00"),
    ("5 March 2024 10:00", "2024-03-05 10:00:00"), ("Tue Mar 05 2024 10:00:00 GMT-0530 (India)", "2024-03-05 15:30:00"),
    ("Tue Mar  5 10:00:00 2024", "2024-03-05 10:00:00"), ("Tue Mar 5 10:00:00 UTC 2024", "2024-03-05 10:00:00"),
    ("5-Mar-24 1:05 PM", "2024-03-05 13:05:00"), ("3/5/99", "1999-03-05 00:00:00"), ("3/5/2024 12:00 AM", "2024-03-05 00:00:00"),
    ("3/5/2024, 12:30:15\u202fpm", "2024-03-05 12:30:15"), ("3/5/2024 13:00 PM", None), ("Mar 5, 2024 10:00 PST", "2024-03-05 18:00:00"),
    ("mar 5 2024", "2024-03-05 00:00:00"), ("Sept. 5, 2024", "2024-09-05 00:00:00"), ("2024-3-5 7:08", "2024-03-05 07:08:00"),
    ("2024-03-05 10:00:00 +0200", "2024-03-05 08:00:00"), ("2024/03/05", "2024-03-05 00:00:00"), ("2/30/2024", None),
    ("13/5/2024", None), ("3/5/2024 25:00", None), ("Mar 5 10:00", None), ("March 2024 soon", None), ("10:00:00 GMT", None),
    ("12/31/2024 23:59:59.1239 -01", "2025-01-01 00:59:59.123"), ("Mar 5, 2024 UTC", "2024-03-05 00:00:00"),
    ("3/5/2024 10:00 +2460", None), ("\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001\u0001", None),
]


def test_written_dates(spark):
    df = spark.createDataFrame(WRITTEN, "s string, want string")
    assert [(r.s, r.got) for r in df.select("s", parse_ts(F.col("s")).cast("string").alias("got")).collect()] == WRITTEN
    staged = df.select("s", time_parts(F.col("s")).alias("p"))
    assert [(r.s, r.got) for r in staged.select("s", parse_ts(F.col("s"), F.col("p")).cast("string").alias("got")).collect()] == WRITTEN

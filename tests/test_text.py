import random

from pyspark.sql import functions as F

from kestrel.functions.text import coerce_nine, norm_header, split_pipes_quoted


def walker(line):
    """Reference character walker (test only)."""
    out, cur, inq, i = [], "", False, 0
    while i < len(line):
        ch = line[i]
        if ch == '"':
            if inq and i + 1 < len(line) and line[i + 1] == '"':
                cur += '"'
                i += 1
            else:
                inq = not inq
        elif ch == "|" and not inq:
            out.append(cur)
            cur = ""
        else:
            cur += ch
        i += 1
    out.append(cur)
    return [c.strip() for c in out]


HAND = ["", "a|b", '"a|b"', 'a"b|c"d', '""', '""""', '"a""b"', '"a|b', ' x | "  y  " | z ',
        'a "  " |b', 'x|""|y', 'x|   |y', '"a"""', '"a""b']


def test_split_hand_rows(spark):
    df = spark.createDataFrame([(x,) for x in HAND], "line string")
    got = {r.line: list(r.c) for r in df.select("line", split_pipes_quoted(F.col("line")).alias("c")).collect()}
    for x in HAND:
        assert got[x] == walker(x), x


def test_split_matches_walker_random(spark):
    rnd = random.Random(11)
    lines = ["".join(rnd.choice('ab |"\t') for _ in range(rnd.randint(0, 16))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    bad = [r for r in df.select("line", split_pipes_quoted(F.col("line")).alias("c")).collect()
           if list(r.c) != walker(r.line)]
    assert bad == []


def test_control_characters_of_a_line_stay(spark):
    rnd = random.Random(5)
    lines = ["".join(rnd.choice('a|"\u0001\u0002\u0003\u0004\u0005eocp ') for _ in range(rnd.randint(0, 14))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    bad = [r for r in df.select("line", split_pipes_quoted(F.col("line")).alias("c")).collect()
           if list(r.c) != walker(r.line)]
    assert bad == []


def test_coerce_nine(spark):
    cases = {0: [], 7: [str(i) for i in range(7)], 9: [str(i) for i in range(9)],
             10: [str(i) for i in range(10)], 12: [str(i) for i in range(12)]}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k int, cells array<string>")
    out = {r.k: (list(r.n.cols), r.n.reason) for r in df.select("k", coerce_nine(F.col("cells")).alias("n")).collect()}
    assert out[9] == ([str(i) for i in range(9)], "")
    assert out[7] == ([str(i) for i in range(7)] + ["", ""], "PADDED")
    assert out[0][1] == "PADDED" and len(out[0][0]) == 9
    assert out[10] == (["0", "1", "2", "3|4", "5", "6", "7", "8", "9"], "COERCED")
    assert out[12] == (["0", "1", "2", "3|4|5|6", "7", "8", "9", "10", "11"], "COERCED")


def test_norm_header(spark):
    df = spark.createDataFrame([("﻿User ID | ID |Sub  seq#| Action|Action",)], "line string")
    assert df.select(norm_header(F.col("line")).alias("h")).first().h == ["user_id", "id", "sub_seq", "action", "action"]

import datetime as dt
import random

from pyspark.sql import functions as F

from kestrel.operators.sessions import session_duration, session_pairs


def stack_pairs(rows):
    """Two-pass stack pairing per (file, key) (test only)."""
    stacks, out = {}, {}
    for r in rows:
        if r["st"]:
            stacks.setdefault((r["file"], r["skey"]), []).append(r)
    for r in rows:
        if not r["en"] or r["ts"] is None:
            continue
        s = stacks.get((r["file"], r["skey"]))
        if s:
            out[(r["file"], s.pop()["ord"])] = r["ord"]
    return out


def test_pairs_match_stack(spark):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        st = rnd.random() < 0.45
        en = (not st and rnd.random() < 0.8) or (st and rnd.random() < 0.05)
        ts = None if rnd.random() < 0.05 else base + dt.timedelta(seconds=rnd.randint(0, 400000))
        rows.append({"file": rnd.choice("ab"), "skey": rnd.choice(["u|", "u|r1", "v|r1"]), "ord": i,
                     "blk": i // 97, "ts": ts, "st": st, "en": en})
    df = spark.createDataFrame(
        [(r["file"], r["skey"], r["blk"], r["ord"], r["ts"], r["st"], r["en"], False) for r in rows],
        "file string, skey string, blk bigint, ord bigint, ts timestamp, is_start boolean, is_end boolean, "
        "is_auto boolean")
    got = {(r.file, r.start_ord): r.end_ord for r in session_pairs(df).collect()}
    assert got == stack_pairs(sorted(rows, key=lambda r: r["ord"]))


def test_duration_caps(spark):
    cases = [(0, False, 0), (28000, False, 28000), (28001, False, 28000), (86399, False, 28000),
             (86400, False, 28000), (172800, False, 56000), (28799, True, 28799), (28801, True, 28800),
             (-5, False, 0)]
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(base, base + dt.timedelta(seconds=s), a) for s, a, _ in cases],
                               "s timestamp, e timestamp, a boolean")
    out = [r.d for r in df.select(session_duration(F.col("s"), F.col("e"), F.col("a")).alias("d")).collect()]
    assert out == [c[2] for c in cases]

"""W3 live sessions against a brute-force causal stack on the smallest fixture."""
from collections import Counter
from datetime import datetime, timedelta

import __spark_entry__ as E
from conftest import SF_SMALL
from kestrel.operators.sessions import AUTO_END_CAP, DAY, DAY_CAP
from kestrel.plans.catalog import parsed_table
from kestrel.streaming.live import live_sessions, write_sessions


def _dur(raw, auto):
    if auto:
        return min(raw, AUTO_END_CAP)
    if raw > DAY_CAP:
        d = raw // DAY
        return DAY_CAP if d <= 1 else d * DAY_CAP
    return raw


def test_live_sessions_match_causal_stack(spark):
    got = Counter((r.file, r.skey, r.session_duration)
                  for r in E.queries()["live_sessions"](spark, SF_SMALL).collect())
    rows = parsed_table(spark, SF_SMALL).select("file", "skey", "id", "ts", "is_start", "is_end", "is_auto").collect()
    stacks, exp = {}, Counter()
    for r in sorted(rows, key=lambda r: int(r.id)):
        st = stacks.setdefault((r.file, r.skey), [])
        if r.is_start:
            st.append(r.ts)
        if r.is_end and r.ts is not None and st:
            s = st.pop()
            start = r.ts if s is None else s
            raw = max(0, int((r.ts - start).total_seconds() // 1))
            exp[(r.file, r.skey, _dur(raw, r.is_auto))] += 1
    assert got == exp and sum(exp.values()) > 0


EVENTS = "file string, skey string, ord bigint, ts timestamp, is_start boolean, is_end boolean, is_auto boolean"


class Feed:
    """Rows of one file and key as they arrive: one stored file per call, drained by the same query."""

    def __init__(self, spark, tmp_path, expiry_ms=None):
        self.spark, self.dir, self.expiry_ms = spark, str(tmp_path), expiry_ms

    def arrive(self, *rows):
        got = [("f", key, n, datetime(2024, 1, 1) + timedelta(seconds=t) if t is not None else None,
                kind == "s", kind == "e", False) for key, n, t, kind in rows]
        self.spark.createDataFrame(got, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.dir}/src")
        stream = self.spark.readStream.schema(EVENTS).parquet(f"{self.dir}/src")
        write_sessions(live_sessions(stream, self.expiry_ms), f"{self.dir}/out", f"{self.dir}/ckpt")
        out = self.spark.read.parquet(f"{self.dir}/out").collect()
        return sorted((r.skey, r.start_ord, r.end_ord or 0, r.session_duration) for r in out)


def test_live_stack_survives_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.arrive(("k", 1, 0, "s"), ("k", 2, None, "s"), ("k", 3, 20, "s")) == []
    # 3 pops first, the start without a time keeps its place, an end without a time pops nothing.
    assert feed.arrive(("k", 4, 30, "e"), ("k", 5, None, "e"), ("j", 6, 31, "e")) == [("k", 3, 4, 10)]
    assert feed.arrive(("k", 9, 60, "e"), ("k", 7, 40, "s"), ("k", 8, 50, "e"))[1:] == [
        ("k", 3, 4, 10), ("k", 7, 8, 10)]
    assert feed.arrive(("k", 10, 70, "e"), ("k", 11, 80, "e")) == [
        ("k", 1, 10, 70), ("k", 2, 9, 0), ("k", 3, 4, 10), ("k", 7, 8, 10)]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_live_starts_given_up(spark, tmp_path):
    feed = Feed(spark, tmp_path, expiry_ms=100_000)
    assert feed.arrive(("k", 1, 0, "s"), ("k", 2, 5, "s"), ("k", 3, None, "s"), ("j", 4, 0, "s")) == []
    # A pause of exactly the expiry is none.
    assert feed.arrive(("k", 5, 105, "e"), ("j", 6, 50, "s")) == [("k", 2, 5, 100)]
    # Another key's events move the watermark: k's and j's open starts go without events of their own.
    assert feed.arrive(("l", 7, 500, "s")) == [
        ("j", 4, 0, None), ("j", 6, 0, None), ("k", 1, 0, None), ("k", 2, 5, 100)]
    # After a pause a key's end meets nothing; an event behind the watermark is not lost.
    assert feed.arrive(("l", 8, 601, "e"), ("m", 9, 400, "s"), ("m", 10, 410, "e"))[-2:] == [
        ("l", 7, 0, None), ("m", 9, 10, 10)]


class StoredList:
    """Stands in for a bucket's list state; counts the calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _do(self, rows):
        self.calls += 1
        self.rows = rows

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self._do(self.rows + rows)

    def put(self, rows):
        self._do(list(rows))

    def clear(self):
        self._do([])


def test_a_bucket_takes_few_state_calls_whatever_its_keys():
    """a call to the state store for every key made the query's time."""
    import random

    import pandas as pd
    from kestrel.streaming.live import EVENT_COLUMNS, LivePairing
    rng, state, pairing = random.Random(5), StoredList(), LivePairing()
    pairing.log = state
    stacks, ord_ = {}, 0
    for batch in range(40):
        rows, exp = [], []
        for _ in range(200):
            key, start, ord_ = ("f", f"k{rng.randrange(100)}"), rng.random() < (0.6 if batch < 20 else 0.3), ord_ + 1
            rows.append((*key, ord_, ord_ * 1000, start, not start, False))
            stack = stacks.setdefault(key, [])
            if start:
                stack.append(ord_)
            elif stack:
                exp.append((*key, stack.pop(), ord_))
        state.calls = 0
        frames = pairing.handleInputRows((0,), iter([pd.DataFrame(rows, columns=EVENT_COLUMNS)]), None)
        got = [r[:4] for f in frames for r in f.itertuples(index=False, name=None)]
        assert sorted(got) == sorted(exp) and state.calls <= 3
        assert sum(n for n, _ in state.rows) <= 2 * sum(map(len, stacks.values())) + 64

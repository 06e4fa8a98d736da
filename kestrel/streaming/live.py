"""Causal session pairing on an unbounded feed (stateful streaming).

Unlike the batch rule (all starts of a file first, then ends pop), a live
feed can only pair an end with the starts seen so far: per (file, key) the
open starts form a stack in arrival order and each timed end pops the most
recent one. Never compared with the batch pairing.

Keys are dealt to BUCKETS buckets, and a bucket is the unit that Spark calls Python and the state
store for; a call for every key would cost more than the pairing. A bucket's state is a log of what
its stacks lost and gained: a micro-batch reads it and appends to it, and the log is rewritten only
when most of it is spent, so what is written follows the events, not the open starts. Starts that a
micro-batch opens and closes itself never reach the store. With an expiry, event time (the watermark)
decides: a key whose events pause for longer loses its open starts, which are reported, and a timer
(one for a bucket, at the earliest time that one of its keys is due) frees its state.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrel.operators.sessions import session_duration

OUT_COLUMNS = ["file", "skey", "start_ord", "end_ord", "start_ms", "end_ms", "is_auto"]
OUT_SCHEMA = ("file string, skey string, start_ord bigint, end_ord bigint, "
              "start_ms bigint, end_ms bigint, is_auto boolean")
# A usual pause after which a key's open starts are given up.
EXPIRY_MS = 7 * 24 * 3600 * 1000
NO_TIME = -1
# What stands for no sequence id on the way through Python: such events come last.
NO_ORD = 2**63 - 1
# Part of every checkpoint: a feed keeps the number that it began with.
BUCKETS = 4096
# Spent entries that a short log may hold.
SPENT = 64
EVENT_COLUMNS = ["file", "skey", "ord", "ms", "is_start", "is_end", "is_auto"]
# State larger than an executor's heap needs the store that spills to disk.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class LivePairing(StatefulProcessor):
    """The stacks of one bucket's (file, key)s. ``log`` holds ``n`` entries a row as JSON, as every row costs
    a pass through the store's serializer: [file, key, lost, ord, ms, latest event time of the key]. An entry
    takes ``lost`` starts off the top of a stack, then puts one start on it, unless ``ord`` is null."""

    def __init__(self, expiry_ms: int | None = None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "n int, entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stacks, length = self._replayed()
        before, added, out = self._due(stacks), [], []
        events = pd.concat(list(rows)).sort_values("ord")  # slim events of one bucket and micro-batch
        of_key: dict[tuple, list] = {}
        for file, skey, *event in zip(*(events[c].tolist() for c in EVENT_COLUMNS)):
            of_key.setdefault((file, skey), []).append(event)
        for k, own in of_key.items():
            last, stored = stacks.get(k, (NO_TIME, []))
            held, height, new = last, len(stored), []
            for ord_, ms, start, end, auto in own:
                if self.expiry_ms and last != NO_TIME and ms - last > self.expiry_ms:
                    out += _given_up(k, stored[:height] + new)
                    height, new = 0, []
                last = max(last, ms)
                if start:
                    new.append((ord_, ms))
                if end and ms != NO_TIME and (new or height):
                    if new:
                        s_ord, s_ms = new.pop()
                    else:
                        height -= 1
                        s_ord, s_ms = stored[height]
                    out.append((*k, s_ord, ord_, None if s_ms == NO_TIME else s_ms, ms, bool(auto)))
            if not self.expiry_ms:
                last = NO_TIME
            lost = len(stored) - height
            if lost or new or last != held:
                added += _entries(k, lost, new, last)
                stacks[k] = (last, stored[:height] + new)
        self._keep(stacks, length, added)
        self._set_timer(before, self._due(stacks))
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stacks, length = self._replayed()
        over = timerValues.getCurrentWatermarkInMs() - self.expiry_ms - 1
        added, out = [], []
        for k in [k for k, (last, _) in stacks.items() if last != NO_TIME and last <= over]:
            stored = stacks.pop(k)[1]
            out += _given_up(k, stored)
            added += _entries(k, len(stored), [], NO_TIME)
        self._keep(stacks, length, added)
        self._set_timer(None, self._due(stacks))  # the timer that fired is gone
        if out:
            yield _frame(out)

    def _replayed(self) -> tuple[dict, int]:
        """({(file, key): (latest time, open starts)}, entries of the log)."""
        stacks: dict[tuple, tuple] = {}
        length = 0
        if self.log.exists():
            for n, entries in self.log.get():
                length += n
                for file, skey, lost, ord_, ms, last in json.loads(entries):
                    stack = stacks[file, skey][1] if (file, skey) in stacks else []
                    del stack[len(stack) - lost:]
                    if ord_ is not None:
                        stack.append((ord_, ms))
                    stacks[file, skey] = (last, stack)
        return {k: v for k, v in stacks.items() if v[1] or v[0] != NO_TIME}, length

    def _keep(self, stacks: dict, length: int, added: list) -> None:
        live = sum(len(stack) or last != NO_TIME for last, stack in stacks.values())
        if length + len(added) <= 2 * live + SPENT:
            if added:
                self.log.appendList([(len(added), json.dumps(added))])
        elif live:
            whole = [e for k, (last, stack) in stacks.items() if stack or last != NO_TIME
                     for e in _entries(k, 0, stack, last)]
            self.log.put([(len(whole), json.dumps(whole))])
        else:
            self.log.clear()

    def _due(self, stacks: dict) -> int | None:
        """When the first of the bucket's keys expires."""
        times = [last for last, _ in stacks.values() if last != NO_TIME] if self.expiry_ms else []
        return min(times) + self.expiry_ms + 1 if times else None

    def _set_timer(self, before: int | None, due: int | None) -> None:
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _given_up(key: tuple, starts: list) -> list:
    """Open starts as sessions without an end."""
    return [(*key, s_ord, None, s_ms, None, False) for s_ord, s_ms in starts]


def _entries(key: tuple, lost: int, new: list, last: int) -> list:
    rows = [(*key, 0, ord_, ms, last) for ord_, ms in new] or [(*key, 0, None, None, last)]
    return [(*key, lost, *rows[0][3:]), *rows[1:]]


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=OUT_COLUMNS)
    whole = ["start_ord", "end_ord", "start_ms", "end_ms"]
    return out.astype(dict.fromkeys(whole, "Int64"))


def live_sessions(parsed_stream: DataFrame, expiry_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Streaming parsed rows -> closed sessions as they happen (append mode): (file, skey, start_ord,
    end_ord, session_start, session_end, session_duration).

    With ``expiry_ms`` (say EXPIRY_MS) an open start is given up when its key has no event for longer,
    measured in event time: at the key's next event or, without one, when the watermark (latest time of
    the feed less ``delay``) passes. It is returned with NULL end and duration. Events without a time
    take no part then, as nothing says when they would expire. Without ``expiry_ms`` a start waits for
    ever; one without a time takes its place and its session lasts 0 seconds. Start a query over the
    result with ``write_sessions`` or under ``state_store``.
    """
    from kestrel.session import ship_package
    ship_package(parsed_stream.sparkSession)
    is_event = F.col("is_start") | F.col("is_end")
    if expiry_ms:
        # The event time itself stays behind: Spark then drops no late event. One condition over the
        # watermark's column is not pushed into the parse, which it would repeat.
        ev = parsed_stream.withWatermark("ts", delay).filter(F.when(F.col("ts").isNotNull(), is_event))
    else:
        ev = parsed_stream.filter(is_event)
    slim = ev.select("file", "skey", F.coalesce("ord", F.lit(NO_ORD)).alias("ord"),
                     F.coalesce(F.unix_millis("ts"), F.lit(NO_TIME)).alias("ms"), "is_start", "is_end", "is_auto")
    bucket = F.pmod(F.xxhash64("file", "skey"), F.lit(BUCKETS)).alias("bucket")
    paired = slim.select(*EVENT_COLUMNS, bucket).groupBy("bucket").transformWithStateInPandas(
        LivePairing(expiry_ms), OUT_SCHEMA, "Append", "EventTime" if expiry_ms else "None")
    ords = [F.nullif(F.col(c), F.lit(NO_ORD)).alias(c) for c in ("start_ord", "end_ord")]
    times = paired.select("file", "skey", *ords, F.timestamp_millis("start_ms").alias("session_start"),
                          F.timestamp_millis("end_ms").alias("session_end"), "is_auto")
    duration = session_duration(F.col("session_start"), F.col("session_end"), F.col("is_auto"))
    return times.withColumn("session_duration", F.when(F.col("session_end").isNotNull(), duration)).drop("is_auto")


def state_store(start):
    """Run ``start`` (which starts a query on the session it gets first) with the state store that
    W3 needs; the session's own settings are put back, as a started query keeps a copy."""
    @functools.wraps(start)
    def run(spark, *args, **kwargs):
        old = {k: spark.conf.get(k, None) for k in STATE_STORE}
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        try:
            return start(spark, *args, **kwargs)
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return run


@state_store
def _start(spark, sessions: DataFrame, path: str, checkpoint: str):
    return (sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch_id={n}"))
            .trigger(availableNow=True).start())


def write_sessions(sessions: DataFrame, path: str, checkpoint: str):
    """Drain the stream into a table: each epoch overwrites its own folder, so a retried epoch
    leaves no duplicates. Returns the finished query."""
    q = _start(sessions.sparkSession, sessions, path, checkpoint)
    q.awaitTermination()
    return q

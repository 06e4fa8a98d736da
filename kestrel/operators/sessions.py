"""Pair check-out (start) rows with check-in (end) rows.

Semantics, per (file, key): every start takes a place on the key's stack in
file order; then ends, in file order, pop from the top. So the 1st end pairs
with the *last* start of the file, the 2nd end with the second-last, and so on,
whatever their relative positions. Ends with no parseable time do not pop;
starts with no time do take a place. Equivalently::

    start_rank = number of starts of (file, key) at or after this start
    end_rank   = number of timed ends of (file, key) at or before this end
    session    = starts JOIN ends ON (file, key, rank)

Ranks are computed without putting a whole (file, key) group into one task:
rows are clustered by (file, key, blk) -- ``blk`` is a bounded ordering block
of a file -- and a small per-block count table supplies the offsets from the
other blocks of the same key. The rank join then hashes on (file, key, rank),
which spreads even a key holding a third of all rows evenly over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Duration caps (seconds).
AUTO_END_CAP = 28800
DAY_CAP = 28000
DAY = 86400


def session_duration(start_ts, end_ts, is_auto):
    """Capped seconds between start and end (start time missing -> 0)."""
    end_ms = F.unix_millis(end_ts)
    start_ms = F.coalesce(F.unix_millis(start_ts), end_ms)
    raw = F.greatest(F.lit(0), F.floor((end_ms - start_ms) / 1000)).cast("long")
    days = F.floor(raw / DAY).cast("long")
    capped = (F.when(is_auto, F.least(raw, F.lit(AUTO_END_CAP)))
              .when(raw > DAY_CAP, F.when(days <= 1, F.lit(DAY_CAP)).otherwise(days * DAY_CAP))
              .otherwise(raw))
    return capped.cast("int")


def ranked_events(parsed: DataFrame) -> DataFrame:
    """Slim start/end records with their pairing ranks.

    Returns (file, skey, ord, ts, is_auto, st, en, s_rank, e_rank); ``st`` /
    ``en`` flag a start / a timed end (a row may be both).

    Shuffles: the slim rows once on (file, skey, blk) for the in-block running
    counts; the per-block totals are a partial aggregate (one row per block),
    so their offsets are computed on a small table and joined back.
    """
    slim = (parsed
            .select("file", "skey", "blk", "ord", "ts", "is_auto",
                    F.col("is_start").alias("st"),
                    (F.col("is_end") & F.col("ts").isNotNull()).alias("en"))
            .filter(F.col("st") | F.col("en")))
    blk_tot = slim.groupBy("file", "skey", "blk").agg(
        F.sum(F.col("st").cast("long")).alias("ns"),
        F.sum(F.col("en").cast("long")).alias("ne"))
    wk = Window.partitionBy("file", "skey").orderBy("blk")
    offs = blk_tot.select(
        "file", "skey", "blk", "ns",
        F.coalesce(F.sum("ns").over(wk.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("s_after"),
        F.coalesce(F.sum("ne").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("e_before"))
    wb = (Window.partitionBy("file", "skey", "blk").orderBy("ord")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = slim.select("*", F.sum(F.col("st").cast("long")).over(wb).alias("run_s"),
                        F.sum(F.col("en").cast("long")).over(wb).alias("run_e"))
    return local.join(offs, ["file", "skey", "blk"]).select(
        "file", "skey", "ord", "ts", "is_auto", "st", "en",
        (F.col("s_after") + F.col("ns") - F.col("run_s") + 1).alias("s_rank"),
        (F.col("e_before") + F.col("run_e")).alias("e_rank"))


def session_pairs(parsed: DataFrame) -> DataFrame:
    """One row per closed session: (file, skey, start_ord, end_ord, session_start, session_end,
    session_duration).

    Each ranked row yields a start record and/or an end record keyed by its
    rank; grouping on (file, skey, rank) meets the k-th start with the k-th
    end in one aggregation (no self-join, the ranked rows are computed once).
    """
    r = ranked_events(parsed)
    recs = r.select(
        "file", "skey",
        F.explode(F.array(
            F.when(F.col("st"), F.struct(F.col("s_rank").alias("rank"), F.lit(True).alias("is_s"),
                                         F.col("ord").alias("ord"), F.col("ts").alias("ts"),
                                         F.col("is_auto").alias("auto"))),
            F.when(F.col("en"), F.struct(F.col("e_rank").alias("rank"), F.lit(False).alias("is_s"),
                                         F.col("ord").alias("ord"), F.col("ts").alias("ts"),
                                         F.col("is_auto").alias("auto"))),
        )).alias("x")).filter(F.col("x").isNotNull()).select("file", "skey", "x.*")
    s_, e_ = F.col("is_s"), ~F.col("is_s")
    g = recs.groupBy("file", "skey", "rank").agg(
        F.max(F.when(s_, F.col("ord"))).alias("start_ord"),
        F.max(F.when(s_, F.col("ts"))).alias("start_ts"),
        F.max(F.when(e_, F.col("ord"))).alias("end_ord"),
        F.max(F.when(e_, F.col("ts"))).alias("end_ts"),
        F.max(F.when(e_, F.col("auto"))).alias("is_auto"))
    closed = g.filter(F.col("start_ord").isNotNull() & F.col("end_ord").isNotNull())
    return closed.select(
        "file", "skey", "start_ord", "end_ord",
        F.col("start_ts").alias("session_start"),
        F.col("end_ts").alias("session_end"),
        session_duration(F.col("start_ts"), F.col("end_ts"), F.col("is_auto")).alias("session_duration"))


def pair_sessions(parsed: DataFrame) -> DataFrame:
    """Parsed rows + session_start, session_end (TIMESTAMP) and session_duration (INT).

    The session sits on the start row. ``session_start`` is set on every start
    row with a time, closed or not; end and duration only on closed ones.
    Only start rows meet the pairs (a join on (file, ord)); all other rows pass
    through without a shuffle, so the wide rows that move are the starts alone.
    Expects ``parsed`` to be materialized (it is read by two branches).
    """
    pairs = session_pairs(parsed).select(
        "file", F.col("start_ord").alias("ord"),
        F.col("session_end").alias("_end"), F.col("session_duration").alias("_dur"))
    base = [F.col(c) for c in parsed.columns]
    starts = parsed.filter(F.col("is_start")).join(pairs, ["file", "ord"], "left").select(
        *base, F.col("ts").alias("session_start"), F.col("_end").alias("session_end"),
        F.col("_dur").alias("session_duration"))
    others = parsed.filter(~F.col("is_start")).select(
        *base, F.lit(None).cast("timestamp").alias("session_start"),
        F.lit(None).cast("timestamp").alias("session_end"),
        F.lit(None).cast("int").alias("session_duration"))
    return starts.unionByName(others)


def open_sessions(parsed: DataFrame) -> DataFrame:
    """Start rows that no end closed."""
    closed = session_pairs(parsed).select("file", F.col("start_ord").alias("ord"))
    return parsed.filter("is_start").join(closed, ["file", "ord"], "left_anti")

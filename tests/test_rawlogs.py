"""E3 raw log staging: broken lines, odd records and Parquet; A8 percentiles; the progress log."""
from datetime import datetime

from kestrel.operators import querylog as QL
from kestrel.session import scratch_dir
from kestrel.sources import rawlogs as RL
from kestrel.streaming.progress import ProgressLog, read_progress, wait_for_listeners

PATHS = {"ts": "$.when", "actor": "$.who.id", "action": "$.what", "duration_ms": "$.ms"}


def test_json_lines_and_quarantine(spark, tmp_path):
    lines = ['{"when": "2024-03-05T10:00:00Z", "who": {"id": 7}, "what": "open", "ms": 12, "x": [1]}',
             '{"when": "Tue, 05 Mar 2024 10:00:00 +0200", "what": "clos\\u00e9", "ms": "no number"}',
             '{}', '', '   ', '{"when": "2024-0', '17', '[{"what": "open"}]', 'null']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    records = RL.read_json_lines(spark, str(tmp_path))
    rows = RL.raw_log_rows(records, "app", PATHS).collect()
    assert [(r.ts, r.source, r.actor, r.action, r.object, r.duration_ms) for r in rows] == [
        (datetime(2024, 3, 5, 10), "app", "7", "open", None, 12),
        (datetime(2024, 3, 5, 8), "app", None, "closé", None, None), (None, "app", None, None, None, None)]
    assert rows[0].payload_json.toPython()["x"] == [1]
    bad = RL.raw_log_rejects(records).collect()
    assert {(r.file, r.raw_line, r.reason) for r in bad} == {
        ("a.jsonl", '{"when": "2024-0', "NOT_JSON"), ("a.jsonl", "17", "NOT_OBJECT"),
        ("a.jsonl", '[{"what": "open"}]', "NOT_OBJECT"), ("a.jsonl", "null", "NOT_OBJECT")}
    # Every line is either staged or in quarantine.
    assert len(rows) + len(bad) == len([x for x in lines if x.strip()])
    schema = RL.payload_schema(RL.raw_log_rows(records, "app", PATHS)).collect()[0]
    assert schema.records == 3 and "who: OBJECT<id: BIGINT>" in schema.payload_schema


def test_parquet_records(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT named_struct('id', 7) AS who, 'open' AS `what`, 5L AS ms, 1 AS `a.b` UNION ALL "
              "SELECT NULL, NULL, NULL, NULL").write.parquet(path)
    records = RL.read_parquet_records(spark, path)
    got = {(r.actor, r.action, r.duration_ms) for r in RL.raw_log_rows(records, "app", PATHS).collect()}
    assert got == {("7", "open", 5), (None, None, None)}
    assert RL.raw_log_rejects(records).count() == 0


def test_percentiles_from_day_sketches(spark):
    # Days of very different sizes in two weeks; one event without a time elapsed, one without a day.
    rows = [(f"2024-01-{day:02d}T00:00:00Z", float(i % 997)) for day, n in ((1, 20000), (3, 10), (8, 3000))
            for i in range(n)] + [("2024-01-09T00:00:00Z", None), ("no day", 5.0)]
    events = spark.createDataFrame(rows, "ts string, elapsed_seconds double")
    days = QL.elapsed_sketches(events)
    assert {(str(r.day), r.queries) for r in days.collect()} == {("2024-01-01", 20000), ("2024-01-03", 10), ("2024-01-08", 3000)}
    judged = QL.percentile_ranks(events, QL.elapsed_percentiles(days, [0.5, 0.99])).collect()
    assert len(judged) == 4
    for r in judged:
        assert r.rank_low - QL.RANK_ERROR <= r.p <= r.rank_high + QL.RANK_ERROR
        assert abs(r.elapsed - r.p * 997) < 997 * 2 * QL.RANK_ERROR
    assert QL.elapsed_percentiles(QL.elapsed_sketches(events.limit(0)), [0.5]).count() == 0


def test_progress_log_keeps_every_epoch(spark, tmp_path):
    log, epochs = scratch_dir(spark, "progress"), 104
    (tmp_path / "src").mkdir()
    for i in range(epochs):
        (tmp_path / "src" / f"{i}.txt").write_text("a\n" * (i + 1))
    listener = ProgressLog(spark, log, {"many"})
    spark.streams.addListener(listener)
    try:
        q = (spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "src")).writeStream
             .queryName("many").format("noop").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
        wait_for_listeners(spark)
    finally:
        spark.streams.removeListener(listener)
    got = read_progress(spark, log).filter("input_rows > 0").collect()
    assert sorted(r.input_rows for r in got) == list(range(1, epochs + 1)) and not listener.failed
    assert len(q.recentProgress) < epochs and all(r.batch_ms > 0 and r.ts for r in got)

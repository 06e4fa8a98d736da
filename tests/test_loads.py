"""Committed loads: a break between rows and commit, files that arrive or change later, clearing up."""
import pytest
from pyspark.sql import functions as F

from kestrel.sources import staged as ST


def put(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("ID,Audit Time\n" + "".join(f"{i},2024-01-0{1 + i % 9} 10:00:00\n" for i in ids))


def ids(spark, table, manifest):
    return sorted((r.file, r.id) for r in ST.read_log(spark, table, manifest).select("file", "id").collect())


@pytest.fixture
def places(tmp_path):
    return tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "log")


def break_at(monkeypatch, what):
    def lost(*_, **__):
        raise ConnectionError(what)
    monkeypatch.setattr(ST, "commit_load", lost)


def test_break_before_the_commit(spark, places, monkeypatch):
    folder, table, log = places
    put(folder, "a.csv", [1, 2])
    with monkeypatch.context() as m:
        break_at(m, "commit")
        with pytest.raises(ConnectionError):
            ST.load_folder(spark, str(folder), table, log)
    assert ids(spark, table, log) == []
    put(folder, "b.csv", [3])
    assert ST.load_folder(spark, str(folder), table, log).count() == 3
    assert ids(spark, table, log) == [("a.csv", "1"), ("a.csv", "2"), ("b.csv", "3")]
    assert ST.load_folder(spark, str(folder), table, log).count() == 0
    # The broken load's rows lie there unseen until they are cleared.
    assert spark.read.parquet(table).count() == 5
    assert ST.drop_uncommitted(spark, table, log) == 0
    assert ST.drop_uncommitted(spark, table, log, older_than_s=-5) == 1
    assert spark.read.parquet(table).count() == 3 and len(ids(spark, table, log)) == 3


def test_a_changed_file_replaces_its_rows_only(spark, places):
    folder, table, log = places
    put(folder, "a.csv", [1, 2])
    put(folder, "b.csv", [3])
    ST.load_folder(spark, str(folder), table, log)
    put(folder, "a.csv", [1, 2, 4])
    assert ST.load_folder(spark, str(folder), table, log).select("file").distinct().collect()[0].file == "a.csv"
    assert ids(spark, table, log) == [("a.csv", "1"), ("a.csv", "2"), ("a.csv", "4"), ("b.csv", "3")]
    assert ST.load_folder(spark, str(folder), table, log, again=True).count() == 4
    assert len(ids(spark, table, log)) == 4
    log_rows = ST.commits(spark, log).groupBy("file").agg(F.max("seq").alias("s"), F.count("*").alias("n")).collect()
    assert {r.file: (r.s, r.n) for r in log_rows} == {"a.csv": (3, 3), "b.csv": (3, 2)}


def test_two_loads_of_the_same_files_count_once(spark, places, monkeypatch):
    """A second load starts before the first has committed: both hold the rows, one is seen."""
    folder, table, log = places
    put(folder, "a.csv", [1, 2])
    commit = ST.commit_load

    def other_first(*args):
        monkeypatch.setattr(ST, "commit_load", commit)
        ST.load_folder(spark, str(folder), table, log)
        commit(*args)
    monkeypatch.setattr(ST, "commit_load", other_first)
    ST.load_folder(spark, str(folder), table, log)
    assert spark.read.parquet(table).count() == 4 and len(ids(spark, table, log)) == 2


def test_empty_folder_and_file_without_rows(spark, places):
    folder, table, log = places
    folder.mkdir()
    assert ST.load_folder(spark, str(folder), table, log).count() == 0
    assert ST.read_log(spark, table, log).count() == 0 and ST.drop_uncommitted(spark, table, log) == 0
    put(folder, "a.csv", [])
    put(folder, "b.csv", [5])
    assert ST.load_folder(spark, str(folder), table, log).count() == 1
    assert ST.load_folder(spark, str(folder), table, log).count() == 0
    assert {(r.file, r.rows) for r in ST.current_commits(spark, log).collect()} == {("a.csv", 0), ("b.csv", 1)}


def test_a_large_source_is_staged_by_several_tasks(spark, tmp_path):
    """One task wrote (and sorted) all rows of a source."""
    from kestrel.schema import AUDIT_COLUMNS
    cells = [F.md5(F.col("id").cast("string")).alias(c) for c in AUDIT_COLUMNS]
    sheet = spark.range(0, 4000, 1, 8).select(F.lit("a.csv").alias("file"), F.col("id").alias("ord"), *cells)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        ST.write_sheet_csv(sheet, str(tmp_path / "in"))
    finally:
        spark.conf.set(key, old)
    assert len(list((tmp_path / "in" / "file=a.csv").glob("part-*"))) > 2
    back = ST.read_staged(spark, str(tmp_path / "in")).groupBy("file").agg(F.count("id"), F.count_distinct("id")).collect()
    assert [tuple(r) for r in back] == [("a.csv", 4000, 4000)]

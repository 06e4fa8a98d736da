import os
import tempfile

from pyspark.sql import functions as F

from kestrel.operators.parse import parse_log
from kestrel.operators.parts import row_numbers
from kestrel.sources.lines import file_manifest, scan_lines


def test_scan_plain_csv_folder_with_crlf(spark):
    d = tempfile.mkdtemp(prefix="kestrel-raw-")
    hdr = "User ID | ID | Subseq ID | Message | Audit Time | Action | Type | Label | Version"
    with open(os.path.join(d, "March 2024.csv"), "w", newline="") as f:
        f.write(hdr + "\r\n")
        f.write("Ann Lee (alee)|1|0|User checked out recipe Recipe ID: 'R-1'|2024-03-01 10:00:00|x|Recipe|GR A|v1\r\n")
        f.write("\r\n")
        f.write("Ann Lee (alee)|2|0|User checked in recipe Recipe ID: 'R-1'|2024-03-01 11:00:00|x|Recipe|GR A|v1\r")
        f.write("Bob|3|0|\"note | with pipe\"|bad|x|Equipment\n")
    with open(os.path.join(d, "other.csv"), "w") as f:
        f.write(hdr + "\n" + "Cy|9|0|hello|2024-03-02T00:00:00Z|y|recipe|SR B|v2\n")
    lines = scan_lines(spark, d, tempfile.mkdtemp(prefix="kestrel-stage-") + "/s")
    got = sorted((r.file, r.hdr, r.line[:12]) for r in lines.collect())
    assert [g[0] for g in got].count("March 2024.csv") == 4 and [g[0] for g in got].count("other.csv") == 2
    assert sum(1 for g in got if g[1]) == 2
    p = {r.id: r for r in parse_log(lines).collect()}
    assert p["1"].recipe_id == "R-1" and p["1"].username == "alee" and p["1"].is_start
    assert p["3"].message == "note | with pipe" and p["3"].ts is None and p["3"].reason == "PADDED"
    assert p["9"].recipe_name == "SR B"
    numbered = {(r.file, r.rn) for r in row_numbers(lines.filter(~F.col("hdr")), ["file"]).collect()}
    assert numbered == {("March 2024.csv", 1), ("March 2024.csv", 2), ("March 2024.csv", 3), ("other.csv", 1)}
    m = {r.file: r.ym for r in file_manifest(lines).collect()}
    assert m == {"March 2024.csv": "2024-03", "other.csv": None}


def test_range_reads_only_its_files(spark, tmp_path):
    from kestrel.sources.lines import folder_manifest, read_range
    texts = {"Log January 2024.csv": "a\n\nb\n", "2024-02 log.CSV": "c\n", "sub/december 2023.csv": "d\ne\n", "2024-01.txt": "f\n", "notes.csv": "g\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    listed = {r.file: (r.ym, r["size"]) for r in folder_manifest(spark, str(tmp_path)).collect()}
    assert listed == {"Log January 2024.csv": ("2024-01", 5), "2024-02 log.CSV": ("2024-02", 2),
                      "sub/december 2023.csv": ("2023-12", 4), "notes.csv": (None, 2)}
    df = read_range(spark, str(tmp_path), "2023-12", "2024-01")
    assert sorted(map(tuple, df.collect())) == [("Log January 2024.csv", "a"), ("Log January 2024.csv", "b"),
                                                ("sub/december 2023.csv", "d"), ("sub/december 2023.csv", "e")]
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    plan.execute().count()
    assert scan.metrics().apply("numFiles").value() == 2


def test_chunks_of_a_source_keep_its_order(spark, tmp_path):
    """one task sorted and wrote all lines of a source."""
    from kestrel.plans.load_job import parse_staged
    from kestrel.sources.lines import file_id, line_block, write_line_files
    rows = [("a b.csv", n // 5, n, f"U (u)|{n}|0|m|2024-01-01 00:00:00|x|Recipe|L|v1") for n in range(1, 60)]
    rows += [("a b.csv", 0, -1, "head"), ("c.csv", 0, -1, "head"), ("c.csv", 0, 1, rows[0][3])]
    lines = spark.createDataFrame(rows, "file string, blk bigint, ord bigint, line string")
    folder = str(tmp_path / "in")
    write_line_files(lines, folder, chunk_blocks=2)
    assert len(list((tmp_path / "in").glob("file=a*/chunk=*/part-*"))) == 6
    s = scan_lines(spark, folder, str(tmp_path / "stage"))
    got = [r.line for r in s.filter("file = 'a b.csv'").orderBy("blk", "ord").collect()]
    assert got == ["head"] + [r[3] for r in rows[:59]]
    assert sorted(r.file for r in s.filter("hdr").collect()) == ["a b.csv", "c.csv"]
    raw = spark.read.option("recursiveFileLookup", "true").text(folder).select(
        file_id(spark, folder).alias("file"), line_block().alias("blk"), "value").withColumnRenamed("value", "line")
    body = parse_staged(spark, raw, str(tmp_path / "parsed"))
    assert [int(r.id) for r in body.filter("file = 'a b.csv'").orderBy("blk", "ord").collect()] == list(range(1, 60))


def test_one_row_group_is_parsed_by_all_tasks(spark, tmp_path):
    """a file of one row group was one task's parse, as its splits passed for a spread."""
    import pyarrow.parquet as pq

    from kestrel.sources.fixture import audit_lines
    n = 4000
    ev = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 3}').alias("props"))
    pq.write_table(ev.toArrow(), str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        body = audit_lines(spark, str(tmp_path)).filter(~F.col("hdr"))
        shares = [r["count"] for r in body.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(shares) == n and len(shares) >= 4 and max(shares) < n / 2


def test_line_text_is_made_after_the_spread(spark):
    """the filter on the text made each line once more in the tasks of the scan."""
    from kestrel.plans.catalog import parsed_rows
    plan = parsed_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):plan.index("FileScan")]
    assert "Filter" not in below and "concat" not in below

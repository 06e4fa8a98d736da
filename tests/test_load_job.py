"""The raw-folder load job equals the fixture-based log table, also across many small splits."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kestrel.plans.catalog import audit_log
from kestrel.plans.load_job import load_raw_folder
from kestrel.schema import AUDIT_COLUMNS
from kestrel.session import scratch_dir
from kestrel.sources.fixture import audit_lines
from kestrel.sources.lines import write_line_files


def test_load_raw_folder_small_splits(spark):
    folder = scratch_dir(spark, "raw_test")
    write_line_files(audit_lines(spark, SF_SMALL), folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = load_raw_folder(spark, folder, scratch_dir(spark, "raw_test_table"))
        cols = [c for c in AUDIT_COLUMNS]
        a = got.select(*cols)
        assert got.agg(F.countDistinct("blk")).first()[0] > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    b = audit_log(spark, SF_SMALL).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

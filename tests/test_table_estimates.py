import uuid

import pytest
from pyspark.sql import functions as F

from kestrel.operators.tablestats import analyze_table, table_estimates
from kestrel.session import scratch_dir


@pytest.mark.parametrize("by", [[], ["month"]])
def test_estimates_show_when_they_are_stale(spark, by):
    path, name = scratch_dir(spark, "est"), "est_" + uuid.uuid4().hex
    rows = spark.range(30).withColumn("month", F.col("id") % 3)

    def seen():
        r = table_estimates(spark, {name: path}).first()
        return r.table_name == name, r.estimated_rows, r.stale

    rows.write.mode("append").partitionBy(*by).parquet(path)
    spark.sql(f"CREATE TABLE `{name}` USING parquet LOCATION '{path}'")
    assert seen() == (True, None, True)
    analyze_table(spark, name, path)
    assert seen() == (True, 30, False)
    rows.withColumn("month", F.lit(7).cast("bigint")).write.mode("append").partitionBy(*by).parquet(path)
    assert seen() == (True, 30, True)
    analyze_table(spark, name, path)
    assert seen() == (True, 60, False)
    spark.sql(f"DROP TABLE `{name}`")


def test_estimates_open_no_file(spark):
    path, name = scratch_dir(spark, "est"), "est_" + uuid.uuid4().hex
    spark.range(5).write.mode("append").parquet(path)
    analyze_table(spark, name, path)
    plan = table_estimates(spark, {name: path})._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE `{name}`")
    assert "ReadSchema: struct<length:bigint>" in plan

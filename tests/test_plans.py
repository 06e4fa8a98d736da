"""Plan-shape checks: pruning and pushdown reach the scan, no shuffle where none is needed."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kestrel.operators import answers as A
from kestrel.operators import reports as R
from kestrel.operators.parse import parse_log
from kestrel.operators.querylog import run_guarded_sql, with_timeout
from kestrel.plans.catalog import audit_log
from kestrel.sources.fixture import audit_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_is_narrow(spark):
    p = _plan(parse_log(audit_lines(spark, SF_SMALL)).select("skey", "ts"))
    # the only exchange is the optional spread of a one-split input
    assert p.count("Exchange") <= 1 and "SortMergeJoin" not in p and "Window" not in p


def test_window_report_prunes_partitions_and_columns(spark):
    t = audit_log(spark, SF_SMALL)
    df = R.top_recipes_events_window(t, 10, "2024-01-08 00:00:00", "2024-01-15 00:00:00")
    p = _plan(df)
    assert "PartitionFilters: [isnotnull(audit_month" in p or "audit_month" in p.split("PartitionFilters")[1][:200]
    assert "TakeOrderedAndProject" in p
    assert "ReadSchema: struct<audit_time:timestamp,recipe_id:string,recipe_name:string>" in p


def test_recent_context_limits_groups_before_shuffle(spark):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    p = _plan(A.recent_context(conv))
    assert "WindowGroupLimit" in p


def test_guard_rejects_and_timeout_cancels(spark):
    with pytest.raises(ValueError):
        run_guarded_sql(spark, "DELETE FROM audit_log")
    slow = spark.range(0, 10**12, 1, 8).select(F.sum(F.col("id") % 7).alias("s"))
    with pytest.raises(Exception):
        with_timeout(spark, slow.collect, 2.0)

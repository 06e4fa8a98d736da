"""Every registered query against its DuckDB oracle on the smallest fixture."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from kestrel.plans.registry import GIVEN_TABLES


def _norm(v):
    import numpy as np
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str(list(v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in GIVEN_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    od = con.sql(ORACLE[name]).df()
    assert sorted(od.columns) == cols
    exp = sorted((tuple(_norm(r[c]) for c in cols) for _, r in od.iterrows()), key=repr)
    assert got == exp


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in ORACLE:
            fn(spark, SF_SMALL).limit(5).collect()


def test_entry(spark):
    assert E.entry(spark).count() >= 0

"""The text of a lone floating value, against Python's own grouping of floats."""
import pytest

from kestrel.operators.answers import format_answer

VALUES = [12345678.5, 0.0001, 0.00012345678901234567, 1e7, 1.0, 0.0, -2.5, -1234567.0, 999999999999999.9, 1e15, 1e16, 1.5e300, 1e-5, 1.25e-7,
          -3.5e-12, 0.1, 123456.789, 1234.0, 1e22, 9007199254740993.0, 0.001]


def test_floats_read_as_written_by_python(spark):
    out = None
    for i, x in enumerate(VALUES):
        one = format_answer(spark.createDataFrame([(x,)], "hours double")).selectExpr(f"{i} as i", "answer")
        out = one if out is None else out.unionByName(one)
    got = {r.i: r.answer for r in out.collect()}
    assert [got[i] for i in range(len(VALUES))] == [f"Result: **{x:,}** (hours)." for x in VALUES]

"""The gold SQL of a report gives the rows of the report of that name."""
import datetime as dt

from kestrel.operators import synth
from kestrel.operators.reports import latest_recipe_rows
from kestrel.schema import AUDIT_LOG_SCHEMA


def test_latest_recipe_rows_orders_as_the_report(spark):
    rows = []
    for i in range(12):
        r = dict.fromkeys(AUDIT_LOG_SCHEMA.names)
        time = None if i % 4 == 0 else dt.datetime(2024, 1, 1 + i % 3)
        rows.append(tuple((r | {"type": "Recipe", "session_duration": 5, "id": str(100 - i), "subseq_id": str(i), "audit_time": time}).values()))
    t = spark.createDataFrame(rows, AUDIT_LOG_SCHEMA)
    t.createOrReplaceTempView("gold_rows")
    report = next(r for r in synth.REPORTS if r.name == "latest_recipe_rows")
    order = next(x for x in vars(report).values() if isinstance(x, str) and x.startswith("ORDER BY"))
    for n in (2, 5, 12):
        gold = [r.id for r in spark.sql(f"SELECT * FROM gold_rows WHERE LOWER(TRIM(type)) = 'recipe' {order} LIMIT {n}").collect()]
        assert gold == [r.id for r in latest_recipe_rows(t, n).collect()]

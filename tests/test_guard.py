"""The report guard: only one query passes, and nothing runs before that is known."""
import pytest

from kestrel.operators.guard import analysed_reason, parsed_reason
from kestrel.operators.querylog import run_guarded_sql, run_report, with_timeout

QUERIES = [
    "SELECT 1", "SELECT recipe, COUNT(*) AS n FROM logs WHERE t > 0 GROUP BY recipe HAVING COUNT(*) > 0 ORDER BY n DESC LIMIT 3",
    "WITH q AS (SELECT * FROM logs) SELECT DISTINCT recipe FROM q", "SELECT * FROM logs a JOIN logs b ON a.t = b.t",
    "SELECT * FROM (SELECT recipe FROM logs) x WHERE recipe IN (SELECT recipe FROM logs)",
    "SELECT recipe, row_number() OVER (PARTITION BY recipe ORDER BY t) AS k FROM logs",
    "SELECT recipe, sum(t) OVER w AS k FROM logs WINDOW w AS (ORDER BY t)",
    "SELECT recipe FROM logs UNION ALL SELECT recipe FROM logs", "SELECT recipe FROM logs EXCEPT SELECT 'x'",
    "SELECT recipe FROM logs WHERE recipe ILIKE :kw", "SELECT * FROM VALUES (1, 2) AS v(a, b)",
    "SELECT explode(array(1, 2)) AS x", "SELECT * FROM logs LATERAL VIEW explode(array(1)) e AS x",
    "SELECT recipe, SUM(t) FROM logs GROUP BY ROLLUP (recipe)", "SELECT 'drop view' AS harmless",
]
REFUSED = [
    "DROP VIEW logs", "DROP  TABLE logs", "TRUNCATE TABLE logs", "CREATE TABLE x AS SELECT 1", "CREATE OR REPLACE TEMP VIEW logs AS SELECT 1",
    "MERGE INTO logs USING x ON true WHEN MATCHED THEN DO NOTHING", "SET spark.sql.ansi.enabled=false", "ADD JAR /tmp/x.jar",
    "REFRESH TABLE logs", "CACHE TABLE logs", "EXPLAIN SELECT 1", "DELETE FROM logs", "SELECT 1; SELECT 2; SELECT 3", "SELECT 1; SELECT 2",
    "hello", "", "INSERT INTO logs VALUES (1)", "SELECT 1 /* x */", "USE default", "SHOW TABLES",
]


@pytest.fixture(autouse=True)
def logs(spark):
    spark.createDataFrame([("mix", 1), ("buffer", 2)], "recipe string, t int").createOrReplaceTempView("logs")


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_pass(spark, sql):
    assert parsed_reason(spark, sql) is None
    run_guarded_sql(spark, sql + ";", {"kw": "%mix%"} if ":kw" in sql else None).collect()


@pytest.mark.parametrize("sql", REFUSED)
def test_other_statements_are_refused(spark, sql):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(ValueError):
        run_guarded_sql(spark, sql)
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    assert spark.table("logs").count() == 2


def test_report_is_written_and_read_back(spark):
    got = run_report(spark, "SELECT recipe FROM logs WHERE t = 2;")
    assert [r.recipe for r in got.collect()] == ["buffer"] and "Scan parquet" in got._jdf.queryExecution().toString()


def test_report_stops_in_time(spark):
    with pytest.raises(Exception):
        run_report(spark, "SELECT sum(a.id % 7) AS s FROM range(1000000) a JOIN range(1000000) b ON a.id <> b.id", timeout_s=2.0)
    assert with_timeout(spark, lambda: spark.range(3).count(), 30.0) == 3


SET = "reflect('java.lang.System', 'setProperty', 'kestrel.probe', '1')"
REACHING_OUT = [
    f"SELECT {SET} FROM logs", f"SELECT * FROM logs WHERE {SET} IS NOT NULL", f"SELECT 1 AS x ORDER BY {SET}",
    f"SELECT recipe FROM logs GROUP BY recipe HAVING max({SET}) IS NULL", f"WITH q AS (SELECT {SET} AS x) SELECT * FROM q",
    f"SELECT (SELECT {SET}) AS x", f"SELECT recipe FROM logs WHERE recipe IN (SELECT {SET})",
    f"SELECT recipe FROM logs WHERE EXISTS (SELECT {SET} AS y)", f"SELECT * FROM VALUES ({SET}) AS v(a)",
    f"SELECT explode(array({SET})) AS x", f"SELECT * FROM logs LATERAL VIEW explode(array({SET})) e AS x",
    f"SELECT transform(array(1), x -> {SET}) AS x FROM logs", f"SELECT sum(t) OVER (ORDER BY {SET}) AS x FROM logs",
    f"SELECT count(*) FILTER (WHERE {SET} = '1') AS x FROM logs", f"SELECT * FROM logs a JOIN logs b ON {SET} = a.recipe",
    f"SELECT * FROM logs, LATERAL (SELECT {SET} AS z)", f"SELECT CASE WHEN t = 1 THEN {SET} END AS x FROM logs",
    SET.replace("reflect", "SELECT java_method"), SET.replace("reflect", "SELECT try_reflect"), SET.replace("reflect", "SELECT system.builtin.reflect"),
    SET.replace("reflect", "SELECT IDENTIFIER('reflect')"), "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM csv.`/etc/passwd`",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x", "WITH text AS (SELECT 1) SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`", "SELECT * FROM stored", "SELECT * FROM default.stored",
    "SELECT recipe FROM logs WHERE t IN (SELECT t FROM stored)", "SELECT * FROM sql_keywords()", "SELECT plus_one(t) AS x FROM logs",
    "SELECT current_user() AS x", "SELECT input_file_name() AS x FROM logs", "SELECT version() AS x", "SELECT * FROM IDENTIFIER('stored')",
    "SELECT xpath_string('<a>b</a>', 'a') AS x", "SELECT TRANSFORM(recipe) USING 'cat' AS (x) FROM logs", "TABLE stored", "SELECT raise_error('x') AS x",
    "FROM logs SELECT TRANSFORM(recipe) USING 'cat'", "WITH stored2 AS (SELECT 1 AS a) SELECT * FROM (SELECT * FROM stored) x, stored2",
]


@pytest.fixture(scope="module")
def outside(spark, tmp_path_factory):
    """A stored table and a function of the session, neither of them a registered view."""
    path = str(tmp_path_factory.mktemp("stored") / "t")
    spark.range(2).selectExpr("cast(id as int) as t").write.parquet(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS stored USING parquet LOCATION '{path}'")
    spark.udf.register("plus_one", lambda x: x + 1, "int")
    yield
    spark.sql("DROP TABLE stored")
    spark.sql("DROP TEMPORARY FUNCTION plus_one")


@pytest.mark.parametrize("sql", REACHING_OUT)
def test_nothing_beyond_the_views(spark, outside, sql):
    system = spark._jvm.java.lang.System
    with pytest.raises(ValueError):
        run_guarded_sql(spark, sql).collect()
    assert system.getProperty("kestrel.probe") is None


def test_a_function_that_takes_a_built_in_name_is_refused(spark):
    other = spark.newSession()
    other.createDataFrame([("mix", 1)], "recipe string, t int").createOrReplaceTempView("logs")
    other.udf.register("upper", lambda x: x, "string")
    with pytest.raises(ValueError, match="function not allowed"):
        run_guarded_sql(other, "SELECT upper(recipe) AS x FROM logs")


def test_a_view_may_be_made_of_anything(spark, outside):
    spark.sql("SELECT t, plus_one(t) AS u FROM stored").createOrReplaceTempView("made")
    got = run_guarded_sql(spark, "WITH q AS (SELECT * FROM made) SELECT sum(u) AS s FROM q WHERE t IN (SELECT t FROM made)")
    assert got.first().s == 3
    assert analysed_reason(spark.table("stored")) and analysed_reason(spark.table("made")) is None

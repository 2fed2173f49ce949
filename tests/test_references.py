"""SQL of users by its parsed plan: what may run over secured tables, and in which order steps run."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from retailops.operators import security, status
from retailops.operators.references import reads
from retailops.plans import steps
from retailops.plans.steps import Step


@pytest.mark.parametrize(
    ("sql", "tables"),
    [
        ("SELECT a FROM t JOIN s.u USING (a) WHERE x IN (SELECT y FROM V) ORDER BY (SELECT max(q) FROM w) LIMIT 3", {"t", "s.u", "v", "w"}),
        ("WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a, c) SELECT * FROM b", {"t", "c"}),
        ("WITH a AS (SELECT * FROM a) SELECT * FROM a", {"a"}),
        ("SELECT * FROM a WHERE EXISTS (WITH a AS (SELECT 1) SELECT * FROM a)", {"a"}),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r, t) SELECT * FROM r", {"t"}),
        ("WITH a AS (WITH b AS (SELECT * FROM t) SELECT * FROM b) SELECT * FROM a, b", {"t", "b"}),
        ("SELECT count(*) FILTER (WHERE x IN (SELECT y FROM hid)) FROM t GROUP BY GROUPING SETS ((a), (b)) HAVING sum(x) > (SELECT 1 FROM h2)", {"t", "hid", "h2"}),
        ("SELECT * FROM t, LATERAL (SELECT * FROM u WHERE u.x = t.x)", {"t", "u"}),
        ("SELECT 1", set()),
    ],
)
def test_tables_of_a_statement(spark, sql, tables):
    found = reads(spark, sql)
    assert (found.tables, found.kinds) == (tables, set())


@pytest.fixture
def people(spark):
    spark.createDataFrame([(1, "s")], "id int, secret string").createOrReplaceTempView("other_people")
    return spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 7)], "id int, grp string, pay int")


def run(spark, people, sql, **more):
    return security.run_secured(spark, sql, {"People": people, "not_granted": people}, {"People": ["id", "grp"]}, {"grp": ["a"]}, **more)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM other_people", "SELECT * FROM not_granted", "SELECT * FROM default.people", "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM csv.`/etc/passwd`",
        "WITH x AS (WITH y AS (SELECT * FROM other_people) SELECT * FROM y) SELECT * FROM x", "SELECT id FROM people WHERE id IN (SELECT id FROM other_people)", "SELECT (SELECT max(secret) FROM other_people) FROM people",
        "SELECT * FROM people UNION SELECT id, secret FROM other_people", "SELECT * FROM people) UNION SELECT id, secret FROM other_people WHERE (1 = 1", "SELECT * FROM IDENTIFIER('other_' || 'people')",
        "SELECT * FROM range(5)", "SELECT * FROM sql_keywords()", "SELECT TRANSFORM (id) USING 'cat' FROM people", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM people", "SELECT input_file_name() FROM people", "SELECT spark_catalog.default.f(id) FROM people", "SELECT my_own(id) FROM people",
        "SHOW TABLES", "DROP VIEW other_people", "INSERT INTO people SELECT 1, 'x'", "CREATE TABLE z AS SELECT * FROM people", "SET spark.x = 1", "EXPLAIN SELECT * FROM people", "CACHE TABLE people", "DESCRIBE people", "USE default",
        "SELECT 1; SELECT 2", "SELEC", "",
    ],
)
def test_refused_statements(spark, people, sql):
    spark.udf.register("my_own", lambda x: x)
    with pytest.raises(PermissionError):
        run(spark, people, sql)


def test_secured_statements(spark, people):
    assert [tuple(r) for r in run(spark, people, "SELECT * FROM people ORDER BY id DESC;").collect()] == [(3, "a"), (1, "a")]
    assert run(spark, people, "WITH p AS (SELECT grp, count(*) AS n FROM PEOPLE GROUP BY grp) SELECT n FROM p JOIN people USING (grp) LIMIT 1").first().n == 2
    assert run(spark, people, "SELECT 7 AS x").first().x == 7
    assert run(spark, people, "WITH people AS (SELECT 'mine' AS id) SELECT id FROM people").first().id == "mine"
    for sql in ("SELECT pay FROM people", "SELECT people.pay FROM people"):
        with pytest.raises(Exception, match="pay"):
            run(spark, people, sql)
    with pytest.raises(PermissionError, match="masked"):
        run(spark, people, "SELECT id AS PAY FROM people", masked=["pay"])
    names = {t.name for t in spark.catalog.listTables()}
    assert "people" not in names and not any(n.startswith("_secured_") for n in names)


def test_steps_find_their_own_order(spark):
    by = [Step("last", "SELECT (SELECT sum(x) FROM `Mid`) AS s, count(*) AS n FROM first WHERE x > {{low}}"), Step("mid", "WITH first2 AS (SELECT * FROM first) SELECT x * 2 AS x FROM first2"), Step("first", "SELECT explode(sequence(1, 3)) AS x")]
    assert [s.name for s in steps.order(by, spark)] == ["first", "mid", "last"]
    assert [(o.name, o.status) for o in steps.run(spark, by, {"low": 1})] == [("first", "done"), ("mid", "done"), ("last", "done")]
    assert tuple(spark.table("last").first()) == (12, 2)
    with pytest.raises(ValueError, match="cycle"):
        steps.order([Step("a", "SELECT * FROM b"), Step("b", "SELECT * FROM c"), Step("c", "SELECT * FROM a")], spark)
    assert [s.name for s in steps.order([Step("b", "SELECT * FROM b"), Step("a", "SELECT bad syntax from from")], spark)] == ["b", "a"]
    assert [s.name for s in steps.order([Step("b", "SELECT 1"), Step("a", "SELECT 1", ("c",)), Step("c", "SELECT 1")], spark)] == ["b", "c", "a"]
    with pytest.raises(ValueError, match="identifiers"):
        steps.order([Step("a", "SELECT 1"), Step("A", "SELECT 1")])


def test_selects_are_saved(spark):
    steps.save(spark, "saved_t", "SELECT 1 AS x;")
    steps.save(spark, "saved_t", "SELECT x + 1 AS x, 'new' AS y FROM saved_t")
    assert tuple(spark.table("saved_t").first()) == (2, "new")
    steps.save(spark, "saved_v", "SELECT x FROM saved_t", view=True)
    steps.save(spark, "saved_t", "SELECT 9 AS x")
    assert spark.table("saved_v").first().x == 9
    steps.save(spark, "saved_v", "SELECT 3 AS z")
    assert spark.table("saved_v").columns == ["z"]
    for name, sql in (("1x", "SELECT 1"), ("a.b", "SELECT 1"), ("ok", "DROP TABLE saved_t"), ("ok", "SELECT 1; SELECT 2"), ("ok", "INSERT INTO saved_t SELECT 1")):
        with pytest.raises(ValueError):
            steps.save(spark, name, sql)


def test_incidents_of_one_entity_take_time_in_proportion(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("entity_id"), (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("checked_at"), "id", F.when(F.col("id") % 1000 == 0, "Online").when(F.col("id") % 7 == 0, "Error").otherwise("Degraded").alias("status"))
        began = time.perf_counter()
        found = status.incidents(rows, spark.createDataFrame([(1, True)], "entity_id long, is_critical boolean")).agg(F.count("*").alias("n"), F.count("resolved_at").alias("done")).first()
        assert tuple(found) == (n // 1000, n // 1000 - 1)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(500_000) < 40  # a frame that is read anew for each row takes hours

import pytest
from pyspark.sql import functions as F

from tabloom.plans import guard

GOOD = ["SELECT * FROM dataset", "SELECT k, sum(v) FROM DATASET GROUP BY k HAVING sum(v) > 1 ORDER BY 2 DESC LIMIT 3", "WITH t AS (SELECT k FROM dataset) SELECT count(*) FROM t", "SELECT * FROM (SELECT v FROM dataset WHERE v > (SELECT avg(v) FROM dataset)) x", "SELECT a.k FROM dataset a JOIN dataset b ON a.k = b.k", "SELECT rank() OVER (PARTITION BY k ORDER BY v) FROM dataset", "SELECT k, count(*) FROM dataset GROUP BY CUBE (k)", "SELECT * FROM dataset LIMIT ALL"]
BAD = ["DROP TABLE dataset", "INSERT INTO dataset VALUES (1)", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM other", "SELECT * FROM read_csv('x')", "SET spark.a = 1", "CREATE TABLE t AS SELECT 1", "WITH t AS (SELECT * FROM z) SELECT * FROM t", "SELECT * FROM dataset WHERE k IN (SELECT k FROM z)", "SELECT (SELECT max(v) FROM z) FROM dataset", "SELECT java_method('java.lang.System', 'nanoTime') FROM dataset", "SELECT reflect('java.lang.System', 'nanoTime') FROM dataset", "SELECT input_file_name() FROM dataset", "SELECT * FROM dataset UNION SELECT * FROM dataset", "SELECT * FROM dataset UNION ALL SELECT * FROM z", "DESCRIBE dataset", "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE dataset", "TABLE z", "SELECT * FROM range(10)", "SELECT * FROM dataset d, LATERAL explode(array(1))", "", "SELECT * FROM dataset JOIN csv.`/x` ON true", "SELECT * FROM dataset WHERE exists (SELECT 1 FROM hidden)", "ADD JAR '/tmp/x.jar'", "SELECT * FROM global_temp.dataset"]


@pytest.mark.parametrize("sql", GOOD)
def test_reads_pass(spark, sql):
    guard.validate(spark, sql)


@pytest.mark.parametrize("sql", BAD)
def test_others_do_not(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.validate(spark, sql)


def test_ceiling_and_timeout(spark):
    df = spark.range(20_000).withColumnRenamed("id", "v")
    assert guard.guarded(df, "SELECT v FROM dataset").count() == guard.MOST_ROWS
    assert guard.guarded(df, "SELECT v FROM dataset LIMIT 7").count() == 7
    small = spark.range(2_500).withColumnRenamed("id", "v")
    slow = guard.guarded(small, "SELECT count(*) FROM dataset a CROSS JOIN dataset b CROSS JOIN dataset c WHERE a.v + b.v + c.v = -1")
    with pytest.raises(TimeoutError):
        guard.collect_within(slow, 2)
    assert guard.collect_within(guard.guarded(df, "SELECT count(*) FROM dataset"), 60)[0][0] == 20_000


def test_session_stays_as_it_is(spark):
    df = spark.range(5).toDF("x")
    spark.range(1).toDF("mine").createOrReplaceTempView("dataset")
    spark.udf.register("own_function", lambda x: x)
    assert guard.guarded(df, "SELECT sum(x) AS s FROM dataset -- a remark").first()["s"] == 10
    assert spark.table("dataset").columns == ["mine"]
    with pytest.raises(guard.GuardError):
        guard.guarded(df, "SELECT own_function(x) FROM dataset")
    rows, evidence = guard.answered(df.withColumn("y", F.lit(1)), "SELECT x FROM dataset WHERE x > 2")
    assert len(rows) == 2 and evidence.columns == ["x"] and evidence.rows_in_scope == 2 and evidence.rows_total == 5
    spark.catalog.dropTempView("dataset")


def test_evidence_is_of_the_plan(spark, tmp_path):
    """Columns are those that the plan reads, not words of the text; the scope is what conditions let through, whatever is made of it."""
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 10).alias("b"), F.lit("x").alias("tax"), (F.col("id") % 3).alias("c"))
    df.write.parquet(str(tmp_path / "t"))
    for source in (df, spark.read.parquet(str(tmp_path / "t")), df.limit(1000)):
        got = lambda sql, source=source: (lambda e: (e.columns, e.rows_in_scope, e.rows_total))(guard.answered(source, sql)[1])
        assert got("SELECT b, sum(a) FROM dataset WHERE c = 1 GROUP BY b") == (["a", "b", "c"], 333, 1000)
        assert got("SELECT count(*), 'tax' AS t FROM dataset") == ([], 1000, 1000)
        assert got("SELECT max(a) FROM (SELECT * FROM dataset WHERE b < 5) WHERE c = 0 LIMIT 1") == (["a", "b", "c"], 167, 1000)
        assert got("WITH t AS (SELECT a, c FROM dataset WHERE b = 2) SELECT c, count(*) FROM t GROUP BY c")[1:] == (100, 1000)
        assert got("SELECT x.a FROM dataset x JOIN dataset y ON x.a = y.b WHERE x.b = 3")[0] == ["a", "b"]
        assert got("SELECT a FROM dataset WHERE a > (SELECT avg(c) FROM dataset)")[0] == ["a", "c"]
        assert got("SELECT a FROM dataset WHERE c = 7") == (["a", "c"], 0, 1000)


def test_standing_subqueries_are_planned_with_their_values(spark):
    """A bound on a rank that a subquery gives keeps groups out of the window; subqueries that refer outwards stay as they are."""
    df = spark.range(200).selectExpr("id", "id % 2 AS g", "CAST(id % 7 AS INT) AS n")
    top = "WITH t AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY id DESC) AS k FROM dataset) SELECT id FROM t WHERE k <= (SELECT max(n) FROM dataset)"
    got = guard.guarded(df, top)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in got.collect()) == list(range(188, 200))
    outer = "SELECT count(*) AS c FROM dataset a WHERE n = (SELECT max(b.n) FROM dataset b WHERE b.g = a.g)"
    assert guard.guarded(df, outer).first()["c"] == sum(i % 7 == 6 for i in range(200))
    shadowed = "WITH dataset AS (SELECT 1 AS n) SELECT (SELECT max(n) FROM dataset) AS m"
    assert guard.guarded(df, shadowed).first()["m"] == 1
    assert guard.guarded(df, "SELECT (SELECT max(n) FROM dataset WHERE id < 0) AS m, (SELECT min(n) - 3 FROM dataset) AS l").first().asDict() == {"m": None, "l": -3}
    assert guard.answered(df, "SELECT g FROM dataset WHERE id <= (SELECT max(n) FROM dataset)")[1].columns == ["id", "g", "n"]

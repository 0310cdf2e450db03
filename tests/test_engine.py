"""The statement layer, against hand-checked facts."""

import pytest

from tallyforge.engine import Engine
from tallyforge.errors import InvalidArgument, NotFound, ParseError, Unsupported


@pytest.fixture
def engine(spark, tmp_path):
    ticks = iter(range(100, 100000, 100))
    out = Engine(spark, f"file://{tmp_path}/data", clock=lambda: next(ticks))
    yield out
    for name in [*out.catalog.tables, *out.catalog.views]:
        spark.catalog.dropTempView(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_create_insert_update_delete(engine):
    engine.sql("CREATE TABLE dbo.users (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL, active BIT DEFAULT true)")
    assert engine.scalar("INSERT INTO users VALUES (1, 'Alice', true), (2, 'Bob', false)") == 2
    engine.sql("INSERT INTO users (id, name) VALUES (3, 'O''Hara, Carol')")
    assert rows(engine.sql("SELECT * FROM users")) == [(1, "Alice", True), (2, "Bob", False), (3, "O'Hara, Carol", True)]
    assert engine.scalar("UPDATE users SET name = upper(name), active = NOT active WHERE id > 1 AND (active OR name LIKE 'B%')") == 2
    assert rows(engine.sql("SELECT id, name, active FROM users WHERE id > 1")) == [(2, "BOB", True), (3, "O'HARA, CAROL", False)]
    assert engine.scalar("DELETE FROM users WHERE active") == 2
    assert rows(engine.sql("SELECT id FROM users")) == [(3,)]
    with pytest.raises(InvalidArgument):
        engine.sql("INSERT INTO users VALUES (1, 'x')")


def test_delete_keeps_rows_with_null(engine):
    engine.batch("CREATE TABLE t (id INT, val INT); INSERT INTO t VALUES (1, 10), (2, NULL), (3, 30)")
    assert engine.scalar("DELETE FROM t WHERE val > 5") == 2
    assert rows(engine.sql("SELECT * FROM t")) == [(2, None)]
    assert engine.scalar("DELETE FROM t") == 1


def test_all_types(engine):
    engine.sql("CREATE TABLE every (a INT, b BIGINT, c SMALLINT, d TINYINT, e VARCHAR(5), f NVARCHAR(5), g TEXT, h FLOAT, i REAL, j DECIMAL(18,2), k NUMERIC(10,4), l BIT, m BOOLEAN, n DATE, o TIMESTAMP, p JSON, q UUID, r BYTEA, s ARRAY)")
    kinds = [f.dataType.simpleString() for f in engine.sql("SELECT * FROM every").schema]
    assert kinds == ["int", "bigint", "smallint", "tinyint", "string", "string", "string", "double", "float", "decimal(18,2)", "decimal(10,4)", "boolean", "boolean", "date", "timestamp_ntz", "string", "string", "binary", "array<string>"]
    with pytest.raises(ParseError):
        engine.sql("CREATE TABLE bad (a NOTYPE)")


def test_alter_and_identity(engine):
    engine.batch("CREATE TABLE t (id INT IDENTITY, v INT); INSERT INTO t (v) VALUES (5), (6)")
    assert rows(engine.sql("SELECT id FROM t")) == [(1,), (2,)]
    engine.sql("ALTER TABLE t ADD COLUMN s VARCHAR(5) DEFAULT 'x'")
    engine.sql("ALTER TABLE t ALTER COLUMN v TYPE BIGINT")
    assert engine.sql("SELECT v, s FROM t").dtypes == [("v", "bigint"), ("s", "string")]
    engine.sql("ALTER TABLE t DROP COLUMN s")
    assert engine.sql("SELECT * FROM t").columns == ["id", "v"]
    engine.sql("DROP TABLE t")
    with pytest.raises(NotFound):
        engine.sql("DROP TABLE t")
    assert engine.scalar("DROP TABLE IF EXISTS t") == "absent"


def test_merge(engine):
    engine.batch("CREATE TABLE target (id INT, val INT); INSERT INTO target VALUES (1, 10), (2, 20)")
    n = engine.scalar("MERGE INTO target USING (VALUES (2, 99), (3, 30)) AS source (id, val) ON target.id = source.id WHEN MATCHED THEN UPDATE SET val = source.val WHEN NOT MATCHED THEN INSERT (id, val) VALUES (source.id, source.val)")
    assert n == 2
    assert rows(engine.sql("SELECT * FROM target")) == [(1, 10), (2, 99), (3, 30)]
    engine.sql("MERGE INTO target t USING (VALUES (1), (2)) s (k) ON t.id = s.k WHEN MATCHED AND t.val > 50 THEN DELETE WHEN NOT MATCHED BY SOURCE THEN UPDATE SET val = 0")
    assert rows(engine.sql("SELECT * FROM target")) == [(1, 10), (3, 0)]
    engine.sql("MERGE INTO target USING (VALUES (7)) s (k) ON target.id = s.k WHEN NOT MATCHED THEN INSERT (id) VALUES (s.k)")
    assert (7, None) in rows(engine.sql("SELECT * FROM target"))
    with pytest.raises(InvalidArgument):
        engine.sql("MERGE INTO target USING (VALUES (1, 1), (1, 2)) s (k, v) ON target.id = s.k WHEN MATCHED THEN UPDATE SET val = s.v")


def test_transactions_and_savepoints(engine):
    engine.batch("CREATE TABLE users (id INT, name TEXT); INSERT INTO users VALUES (1, 'Alice')")
    engine.sql("BEGIN TRANSACTION")
    engine.sql("INSERT INTO users VALUES (2, 'Bob')")
    assert engine.scalar("SELECT count(*) FROM users") == 2
    engine.sql("SAVEPOINT a")
    engine.sql("DELETE FROM users")
    engine.sql("ROLLBACK TO SAVEPOINT a")
    assert engine.scalar("SELECT count(*) FROM users") == 2
    engine.sql("RELEASE SAVEPOINT a")
    with pytest.raises(NotFound):
        engine.sql("ROLLBACK TO a")
    engine.sql("ROLLBACK")
    assert engine.scalar("SELECT count(*) FROM users") == 1
    with pytest.raises(InvalidArgument):
        engine.sql("COMMIT")
    engine.batch("BEGIN; INSERT INTO users VALUES (3, 'Cy'); COMMIT")
    assert engine.scalar("SELECT count(*) FROM users") == 2
    engine.sql("BEGIN")
    with pytest.raises(InvalidArgument):
        engine.sql("BEGIN")


def test_log_replays_what_was_committed(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    engine = Engine(spark, f"file://{tmp_path}/a", log)
    engine.batch("CREATE TABLE logged (id INT); INSERT INTO logged VALUES (1); BEGIN; INSERT INTO logged VALUES (2); ROLLBACK; BEGIN; INSERT INTO logged VALUES (3); COMMIT")
    with open(tmp_path / "log" / "000000000009.json", "w") as f:
        f.write('{"sql": "INSERT INTO logged VALUES (9')  # a torn last line
    again = Engine(spark, f"file://{tmp_path}/b", log)
    assert again.replay() == 3
    assert rows(again.sql("SELECT * FROM logged")) == [(1,), (3,)]


def test_system_versions(engine):
    engine.batch("CREATE TABLE t_hist (id INT, v INT) WITH (SYSTEM_VERSIONING = ON); INSERT INTO t_hist VALUES (1, 100)")  # at 100
    engine.sql("UPDATE t_hist SET v = 150 WHERE id = 1")  # at 200, the new row at 300
    assert rows(engine.sql("SELECT * FROM t_hist")) == [(1, 150)]
    assert rows(engine.sql("SELECT v FROM t_hist FOR SYSTEM_TIME AS OF 150")) == [(100,)]
    assert rows(engine.sql("SELECT v FROM t_hist FOR SYSTEM_TIME AS OF 18446744073709551615")) == [(150,)]
    assert rows(engine.sql("SELECT v FROM t_hist FOR SYSTEM_TIME BETWEEN 0 AND 9999")) == [(100,), (150,)]
    assert engine.sql("SELECT * FROM t_hist FOR SYSTEM_TIME ALL").count() == 2
    assert rows(engine.version_counts("t_hist")) == [(1, 2)]
    engine.sql("DELETE FROM t_hist")
    assert engine.sql("SELECT * FROM t_hist").count() == 0
    assert engine.sql("SELECT * FROM t_hist FOR SYSTEM_TIME ALL").count() == 2


def test_views_indexes_procedures_functions(engine):
    engine.batch("CREATE TABLE t (id INT, dept INT); INSERT INTO t VALUES (1, 1), (2, 1), (3, 2)")
    engine.sql("CREATE VIEW v AS SELECT dept, count(*) AS n FROM t GROUP BY dept")
    assert rows(engine.sql("SELECT * FROM v")) == [(1, 2), (2, 1)]
    with pytest.raises(InvalidArgument):
        engine.sql("CREATE VIEW v AS SELECT 1 AS x")
    engine.sql("CREATE OR ALTER VIEW v AS SELECT 1 AS x")
    engine.sql("DROP VIEW v")
    engine.sql("CREATE INDEX ix ON t (dept)")
    assert engine.catalog.indexes == {"ix": ("t", "dept")}
    engine.sql("DROP INDEX ix")
    engine.sql("CREATE PROCEDURE add_row (@id INT, @dept INT) AS BEGIN INSERT INTO t VALUES (@id, @dept); SELECT count(*) FROM t END")
    assert engine.scalar("EXEC add_row 4, 2") == 4
    engine.sql("CREATE FUNCTION twice (@x INT) RETURNS INT AS BEGIN RETURN @x * 2 END")
    assert engine.scalar("SELECT twice(21)") == 42
    engine.sql("CREATE TYPE pair AS TABLE (a INT, b TEXT)")
    assert [c.type for c in engine.table_types["pair"]] == ["int", "string"]
    with pytest.raises(NotFound):
        engine.sql("EXEC nothing")


def test_view_follows_its_table(engine):
    engine.batch("CREATE TABLE t (id INT); CREATE VIEW n AS SELECT count(*) AS n FROM t; INSERT INTO t VALUES (1), (2)")
    assert engine.scalar("SELECT n FROM n") == 2


def test_pivot_recursion_extensions(engine):
    engine.batch("CREATE TABLE sales (dept INT, qtr INT, amt INT); INSERT INTO sales VALUES (1, 1, 100), (1, 2, 200), (2, 1, 150)")
    assert rows(engine.sql("SELECT * FROM sales PIVOT (SUM(amt) FOR qtr IN ([1], [2])) AS p")) == [(1, 100, 200), (2, 150, None)]
    engine.batch("CREATE TABLE employees (id INT, manager_id INT, name TEXT); INSERT INTO employees VALUES (1, 0, 'CEO'), (2, 1, 'a'), (3, 1, 'b'), (4, 2, 'c'), (5, 2, 'd')")
    tree = "WITH RECURSIVE org AS (SELECT id, manager_id FROM employees WHERE manager_id = 0 UNION ALL SELECT e.id, e.manager_id FROM employees e JOIN org ON e.manager_id = org.id) SELECT id FROM org"
    assert engine.sql(tree).count() == 5
    assert rows(engine.sql("WITH RECURSIVE one AS (SELECT 1 AS x UNION SELECT 1 FROM one) SELECT x FROM one")) == [(1,)]
    with pytest.raises(RecursionError):
        engine.sql("WITH RECURSIVE up AS (SELECT 1 AS x UNION SELECT x + 1 FROM up) SELECT x FROM up OPTION (MAXRECURSION 3)")
    assert engine.sql("SELECT dept FROM sales SIMILAR TO dept x'01' WITHIN HAMMING DISTANCE 0 TIER hot").count() == 2
    assert engine.hints == {"tier": "hot"}
    assert engine.scalar("SELECT COUNT(DISTINCT dept) FROM sales APPROXIMATE WITHIN 5% CONFIDENCE 95%") == 2
    assert engine.scalar("SELECT JSON_VALUE('{\"a\":{\"b\":7}}', '$.a.b')") == "7"
    assert engine.scalar("SELECT JSON_VALUE('{\"a\":{\"b\":7}}', '$.a')") is None
    assert engine.scalar("SELECT JSON_QUERY('{\"a\":{\"b\":7}}', '$.a')") == '{"b":7}'


def test_files_and_upkeep(engine, spark, tmp_path):
    engine.batch("CREATE TABLE t (id INT, name TEXT); INSERT INTO t VALUES (1, 'a,b'), (2, NULL)")
    assert engine.scalar(f"COPY t TO '{tmp_path}/out'") == 2
    engine.sql("DELETE FROM t")
    assert engine.scalar(f"COPY t FROM '{tmp_path}/out'") == 2
    assert rows(engine.sql("SELECT * FROM t")) == [(1, "a,b"), (2, None)]
    assert engine.scalar("VACUUM") >= 1
    assert engine.sql("SELECT * FROM t").count() == 2
    assert engine.backup(f"{tmp_path}/bak") == ["t"]
    engine.sql("DROP TABLE t")
    assert engine.restore(f"{tmp_path}/bak") == ["t"]
    assert engine.sql("SELECT * FROM t").count() == 2
    assert "Scan" in engine.scalar("EXPLAIN SELECT * FROM t") or "Relation" in engine.scalar("EXPLAIN SELECT * FROM t")
    assert engine.scalar("ANALYZE SELECT * FROM t") > 0
    assert engine.scalar("CHECKPOINT") == "checkpoint"


def test_read_only_and_parameters(engine):
    with pytest.raises(Unsupported):
        engine.query("DELETE FROM t")
    assert engine.query("SELECT 1 AS x").first()[0] == 1
    assert engine.sql("SELECT :a + 1 AS x", a=41).first()[0] == 42
    assert [d.first()[0] for d in engine.batch("SELECT 1; SELECT ';' AS s")] == [1, ";"]


def test_loading(engine, spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,score\n1,Alice,100\n2,Bob,\n")
    engine.load_csv(f"{tmp_path}/x.csv", "people")
    assert engine.sql("SELECT * FROM people").dtypes == [("id", "bigint"), ("name", "string"), ("score", "bigint")]
    (tmp_path / "y.csv").write_text("1,x\n2,y\n")
    assert engine.load_csv(f"{tmp_path}/y.csv", "bare", header=False).columns == ["col_0", "col_1"]
    spark.range(5).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(f"{tmp_path}/p")
    df = engine.load_parquet_for(f"{tmp_path}/p", "p", "SELECT b FROM p WHERE id > 1")
    assert df.columns == ["id", "b"]

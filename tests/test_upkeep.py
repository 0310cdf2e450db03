"""Every query over files, views, upkeep, sketches and bitmaps against its oracle; versions as lists of files; constraints."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.engine import Engine
from tallyforge.errors import InvalidArgument
from tallyforge.functions.datetimes import make_time
from tallyforge.plans import upkeep
from tallyforge.plans.registry import TABLES
from tallyforge.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__closure__ and any(getattr(c.cell_contents, "__module__", "") == upkeep.__name__ for c in f.__closure__)]


@pytest.mark.parametrize("name", [*NAMES, "time_now", "time_make", "timestamp_split"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_time_make_in_a_plain_session(spark):
    """The answers do not rest on Spark's switch for TIME, which is off by default."""
    plain = spark.newSession()
    plain.conf.set("spark.sql.timeType.enabled", "false")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{SF}/nation.parquet')")
    df = QUERIES["time_make"](plain, SF)
    assert sorted(map(tuple, df.select("n_nationkey", "at").collect())) == sorted(con.execute(ORACLES["time_make"]).fetchall())
    parts = "h int, m int, s decimal(16,6)"
    made = lambda *row: plain.createDataFrame([row], parts).select(make_time(F.col("h"), F.col("m"), F.col("s"))).first()[0]
    for row in ((0, 0, Decimal(0)), (23, 59, Decimal("59.999999")), (1, 2, Decimal("3.500000")), (None, 2, Decimal(3)), (1, 2, None)):
        assert made(*row) == con.execute("SELECT CAST(make_time(?::INT, ?::INT, ?::DOUBLE) AS VARCHAR)", row).fetchone()[0]
    for row in ((24, 0, Decimal(0)), (1, 60, Decimal(0)), (1, 2, Decimal(60)), (-1, 2, Decimal(3))):
        with pytest.raises(PySparkException):
            made(*row)


def test_changes_leave_other_files(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE listed (id INT, name TEXT)")
    for k in range(3):
        e.sql(f"INSERT INTO listed VALUES ({k}, 'a'), ({k + 10}, 'b')")
    before = set(e.catalog.get("listed").files)
    e.sql("INSERT INTO listed VALUES (99, 'z')")
    after = set(e.catalog.get("listed").files)
    assert before < after and spark.read.parquet(*(after - before)).count() == 1
    assert e.sql("UPDATE listed SET name = 'c' WHERE id = 11").first().rows_affected == 1
    changed = set(e.catalog.get("listed").files)
    gone = after - changed
    assert spark.read.parquet(*gone).where("id = 11").count() == 1 and spark.read.parquet(*gone).count() == spark.read.parquet(*(changed - after)).count() < 7
    assert e.sql("DELETE FROM listed WHERE id > 1000").first().rows_affected == 0 and set(e.catalog.get("listed").files) == changed
    assert sorted(r.id for r in e.sql("SELECT id FROM listed WHERE name = 'c'").collect()) == [11]
    assert e.sql("SELECT count(*) AS n FROM listed").first().n == 7


def test_constraints(spark):
    e = Engine(spark)
    e.batch("CREATE TABLE strict (id INT PRIMARY KEY, name TEXT NOT NULL); INSERT INTO strict VALUES (1, 'a'), (2, 'b')")
    for wrong in ("INSERT INTO strict VALUES (1, 'x')", "INSERT INTO strict VALUES (3, 'x'), (3, 'y')", "INSERT INTO strict VALUES (4, NULL)", "UPDATE strict SET name = NULL WHERE id = 1", "UPDATE strict SET id = 2 WHERE id = 1"):
        with pytest.raises(InvalidArgument):
            e.sql(wrong)
    assert e.sql("UPDATE strict SET id = 5 WHERE id = 1").first().rows_affected == 1
    assert sorted(r.id for r in e.sql("SELECT id FROM strict").collect()) == [2, 5]


def test_cursor(spark):
    e = Engine(spark)
    e.register("paged", spark.range(7))
    assert [len(p) for p in e.cursor("SELECT * FROM paged", 3)] == [3, 3, 1]
    with pytest.raises(InvalidArgument):
        next(e.cursor("SELECT 1", 0))

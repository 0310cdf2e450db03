"""Operators and functions, against hand-checked facts and, over random tables with nulls, against DuckDB."""

import datetime
import math
import random

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import casts, datetimes, json, strings
from tallyforge.operators import recursive, relational, similarity, sketches
from tallyforge.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
VALUE = st.one_of(st.none(), st.integers(-3, 3))
NAME = st.one_of(st.none(), st.sampled_from(["", "a", "b", "A%", "_"]))
TABLE = st.lists(st.tuples(VALUE, VALUE, NAME), min_size=1, max_size=15)

QUERIES = [
    "SELECT a, b FROM t WHERE a > b OR c = 'a'",
    "SELECT a FROM t WHERE NOT (a = 1 AND c <> 'a')",
    "SELECT a, CAST(sum(b) AS BIGINT) AS s, count(b) AS n, count(*) AS m, avg(b) AS v, min(c) AS lo FROM t GROUP BY a",
    "SELECT c, count(DISTINCT a) AS n FROM t GROUP BY c HAVING count(*) > 1",
    "SELECT t.a, u.b FROM t LEFT JOIN u ON t.a = u.a AND u.b > 0",
    "SELECT t.a AS x, u.a AS y FROM t FULL JOIN u ON t.a = u.a AND t.b = u.b",
    "SELECT a FROM t WHERE a NOT IN (SELECT a FROM u)",
    "SELECT a FROM t WHERE a IN (SELECT b FROM u)",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.a = t.b)",
    "SELECT a, b FROM t UNION SELECT a, b FROM u",
    "SELECT a, b FROM t INTERSECT SELECT a, b FROM u",
    "SELECT a, b FROM t EXCEPT SELECT a, b FROM u",
    "SELECT a, c, count(*) AS n FROM t GROUP BY CUBE (a, c)",
    "SELECT a, CAST(sum(b) OVER (PARTITION BY a) AS BIGINT) AS s FROM t",
    "SELECT a, CAST(rank() OVER (PARTITION BY c ORDER BY a NULLS LAST) AS BIGINT) AS r FROM t",
    "SELECT DISTINCT c FROM t WHERE c LIKE 'a%' OR c IS NULL",
    "SELECT a, CASE WHEN a > 0 THEN 'p' WHEN a < 0 THEN 'n' END AS k FROM t",
    "SELECT a IS NOT DISTINCT FROM b AS same FROM t",
]


@SLOW
@given(TABLE, TABLE)
def test_sql_with_nulls_as_duckdb(spark, left, right):
    con = duckdb.connect()
    for name, data in (("t", left), ("u", right)):
        spark.createDataFrame(data, "a int, b int, c string").createOrReplaceTempView(name)
        con.execute(f"CREATE TABLE {name} (a INT, b INT, c VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", [list(r) for r in data])
    for sql in QUERIES:
        assert rows(spark.sql(sql)) == sorted(con.execute(sql).fetchall(), key=str), sql


def test_join_kinds(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, x int")
    b = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "j int, y string")
    kinds = {"inner": 1, "left": 3, "right": 3, "full": 5, "semi": 1, "anti": 2}
    assert {k: relational.join(a, b, [("k", "j")], k).count() for k in kinds} == kinds
    assert relational.cross(a, b).count() == 9
    assert relational.join(a, b, [("k", "j")], "left", F.col("y") == "none").where("y IS NOT NULL").count() == 0
    assert relational.not_in(a, "k", b, "j").count() == 0
    assert rows(relational.not_in(a, "k", b.where("j = 1"), "j").select("k")) == [(2,)]
    assert rows(relational.not_in(a, "k", b.where("j = 9"), "j").select("k")) == sorted([(1,), (2,), (None,)], key=str)
    assert rows(relational.not_in(a, "k", a.where("k = 1"), "k").select("k")) == [(2,)]


def test_asof_over_days(spark):
    """Buckets without a row of the right side take over what came before; null keys and times match nothing."""
    rnd = random.Random(3)
    when = lambda: rnd.choice([None, *[datetime.datetime(2024, 1, 1 + d, h) for d in (0, 1, 2, 5, 6) for h in (0, 7, 23)]])
    left = [(rnd.choice(["a", "b", None]), when(), k) for k in range(60)]
    right = list({(k, t): (k, t, n) for n in range(25) if (k := rnd.choice(["a", "b", None]), t := when())}.values())
    got = relational.asof_join(spark.createDataFrame(left, "k string, ts timestamp_ntz, n int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v int"), "k", "ts", ["v"])
    best = lambda k, t: max(((u, v) for j, u, v in right if k and t and j == k and u and u <= t), default=(None, None))[1]
    assert rows(got) == sorted([(k, t, n, best(k, t)) for k, t, n in left], key=str)


def test_range_asof_topk(spark):
    v = spark.createDataFrame([(1.0,), (5.0,), (9.99,), (-3.0,)], "v double")
    r = spark.createDataFrame([(0.0, 5.0), (5.0, 10.0), (4.0, 6.0), (7.0, 7.0)], "lo double, hi double")
    assert rows(relational.range_join(v, r, "v", "lo", "hi", 2.0)) == sorted([(1.0, 0.0, 5.0), (5.0, 5.0, 10.0), (5.0, 4.0, 6.0), (9.99, 5.0, 10.0)], key=str)
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, ts int")
    right = spark.createDataFrame([("a", 2, None), ("a", 5, 7), ("b", 10, 1)], "k string, ts int, v int")
    assert rows(relational.asof_join(left, right, "k", "ts", ["v"])) == [("a", 1, None), ("a", 5, 7), ("b", 9, None)]
    for width in (1, 3, 100):
        assert rows(relational.asof_join(left, right, "k", "ts", ["v"], lambda c: F.floor(c / width))) == [("a", 1, None), ("a", 5, 7), ("b", 9, None)]
    top = relational.top_k_per_group(spark.range(10).selectExpr("id % 2 AS g", "id"), ["g"], [F.desc("id")], 2)
    assert rows(top) == [(0, 6), (0, 8), (1, 7), (1, 9)]


def test_pivot_unpivot_grouping(spark):
    t = spark.createDataFrame([(1, 1, 100), (1, 2, 200), (2, 1, 150), (2, 2, 250)], "dept int, quarter int, amount int")
    assert rows(relational.pivot(t, "dept", "quarter", [1, 2], "amount")) == [(1, 100, 200), (2, 150, 250)]
    wide = spark.createDataFrame([(1, 100, 200), (2, 150, None)], "dept int, q1 int, q2 int")
    assert rows(relational.unpivot(wide, ["dept"], ["q1", "q2"], "q", "v")) == [(1, "q1", 100), (1, "q2", 200), (2, "q1", 150), (2, "q2", None)]
    assert relational.cube(t, ["dept"], F.count("*")).count() == relational.rollup(t, ["dept"], F.count("*")).count() == 3
    assert relational.grouping_sets(t, ["dept", "quarter"], [["dept"], ["quarter"]], F.sum("amount")).count() == 4


def test_window_facts(spark):
    t = spark.createDataFrame([(10,), (20,), (20,), (30,)], "v int")
    w = Window.orderBy("v")
    got = t.select("v", F.rank().over(w), F.dense_rank().over(w), F.lag("v", 1, 0).over(w)).collect()
    assert [tuple(r)[1:3] for r in got] == [(1, 1), (2, 2), (2, 2), (4, 3)] and got[0][3] == 0


def test_triangles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 1), (4, 5), (5, 3)], "a int, b int")
    assert rows(relational.triangles(e)) == [(1, 2, 3), (3, 4, 5)]


def test_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    step = edges.selectExpr("a AS b", "b AS c")
    got = recursive.fixpoint(edges, lambda new: new.join(step, "b").select("a", "c"))
    assert got.count() == 10
    with pytest.raises(RecursionError):
        recursive.fixpoint(edges, lambda new: new.join(step, "b").select("a", "c"), 1)


def test_strings(spark):
    t = spark.createDataFrame([("héllo\t",), ("",), (None,)], "s string")
    s = F.col("s")
    got = t.select(strings.substring(s, -4, 2), strings.substring(s, 2), strings.substring(s, 1, 0), strings.char_length(s), strings.trim(s), strings.position(s, "l"), strings.left(s, -1), strings.right(s, 2), strings.replace(s, "", "x"), strings.position(s, "")).collect()
    assert tuple(got[0]) == ("hé", "éllo\t", "", 6, "héllo", 3, "", "o\t", "héllo\t", 1)
    assert tuple(got[1])[:5] == ("", "", "", 0, "") and got[2][3] is None


def test_dates(spark):
    t = spark.sql("SELECT timestamp_ntz'2024-01-31 23:59:58.123456' AS ts, date'2024-01-31' AS d")
    got = t.select(*[datetimes.part(F.col("ts"), p).alias(p) for p in ("millisecond", "us", "dow", "isodow", "doy", "epoch", "decade", "century", "millennium", "q")]).first()
    assert tuple(got) == (123, 123456, 3, 3, 31, 1706745598, 202, 21, 3, 1)
    assert str(t.select(datetimes.add_months(F.col("d"), 1)).first()[0]) == "2024-02-29"
    assert str(t.select(datetimes.truncate(F.col("ts"), "quarter")).first()[0]) == "2024-01-01 00:00:00"
    assert str(t.select(datetimes.add_interval(F.col("ts"), 1500, "microseconds")).first()[0]) == "2024-01-31 23:59:58.124956"
    assert t.select(datetimes.parse_timestamp(F.lit("2024-01-01T10:00:00")), datetimes.parse_date(F.lit("nope"))).first()[1] is None
    with pytest.raises(ValueError):
        datetimes.part(F.col("ts"), "eon")


def test_json(spark):
    doc = '{"name":"Alice","age":30,"active":true,"none":null,"items":["apple","banana","cherry"]}'
    t = spark.createDataFrame([(doc,), ("not json",), (None,)], "d string")
    d = F.col("d")
    got = t.select(json.json_value(d, "$.name"), json.json_value(d, "$.age"), json.json_value(d, "$.active"), json.json_value(d, "$.items"), json.json_value(d, "$.items[2]"), json.json_value(d, "$.none"), json.json_query(d, "$.items"), json.json_query(d, "$.name"), json.is_json(d), json.json_exists(d, "$.none"), json.json_exists(d, "$.zip")).collect()
    assert tuple(got[0]) == ("Alice", "30", "true", None, "cherry", None, '["apple","banana","cherry"]', None, True, True, False)
    assert tuple(got[1]) == (None,) * 8 + (False, None, None) and got[2][8] is None
    kinds = [spark.range(1).select(json.is_json(F.lit(x))).first()[0] for x in ('"hello"', "42", "true", "{invalid", "[1] 2", "")]
    assert kinds == [True, True, True, False, False, False]
    assert json.modified('{"a":[1]}', "append $.a", "2") == '{"a":[1,2]}'
    assert json.modified('{"a":{"b":1}}', "$.a.b", None) == '{"a":{}}'
    assert json.modified('{"a":1}', "$.b", "x") == '{"a":1,"b":"x"}'
    assert json.modified("bad", "$.b", "x") == "bad" and json.modified(None, "$.b", "x") is None
    assert rows(json.openjson(spark.createDataFrame([('{"a":1,"b":[1],"c":null}',)], "d string"), "d").select("key", "value", "type")) == [("a", "1", "int"), ("b", "[1]", "array"), ("c", None, "null")]
    listed = spark.createDataFrame([('[{"x":1},{"x":2,"y":"q"}]',)], "d string")
    assert rows(json.openjson_with(listed, "d", {"x": ("int", "$.x"), "y": ("string", "$.y")}).select("x", "y")) == [(1, None), (2, "q")]
    assert json.for_json(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), ["k"]).first()[0] == '[{"k":1,"v":"a"},{"k":2,"v":"b"}]'


def test_casts(spark):
    t = spark.createDataFrame([(" 12 ",), ("x",), ("YES",), (None,), ("1.5",)], "s string")
    s = F.col("s")
    assert [tuple(r) for r in t.select(casts.to_long(s), casts.to_double(s), casts.to_boolean(s)).collect()] == [(12, 12.0, None), (None, None, None), (None, None, True), (None, None, None), (None, 1.5, None)]


def test_sketches(spark):
    t = spark.range(20000).selectExpr("id % 1000 AS k", "CAST(id AS DOUBLE) AS v")
    halves = [sketches.count_min(t.where(f"k % 2 = {r}"), "k", 5, 4096) for r in (0, 1)]
    got = sketches.count_min_estimate(sketches.count_min_merge(*halves), t, "k", 5, 4096)
    assert got.where("estimate < 20").count() == 0 and got.count() == 1000
    e = sketches.approximate_mean(t, "v", 0.2)
    assert abs(e.value - 9999.5) <= max(e.half_width, 1e-6)
    assert math.isnan(sketches.approximate_mean(t.where("v < 0"), "v", 0.1).value)
    h = sketches.histogram(t, "v", 10)
    assert h.count() == 10 and abs(sketches.range_selectivity(h, 0, 9999.5) - 0.5) < 0.01
    assert sketches.through_join(3.0, 0.01, 2.0, 0.02, 2.0) == (5.0, 0.03)
    assert sketches.agm_triangle(4, 9, 1) == 6.0 and sketches.prefers_multiway(1, 3)
    c = sketches.CorrectedSelectivity(0.5)
    c.observe(0.1, 0.2)
    assert c(0.1) == pytest.approx(0.15)


def test_count_min_exact(spark):
    """Right where some, most or all of the counters are shared, for a key that has most rows, for rows without a key, and for none."""
    t = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id % 900 WHEN id % 7 > 0 THEN -id END AS k", "CAST(id % 50 AS STRING) AS s")
    for c, depth, width in (("k", 6, 1 << 16), ("k", 3, 2048), ("k", 2, 100), ("k", 1, 1), ("s", 2, 70)):
        got = sketches.count_min_exact(t, c, depth, width)
        assert got.columns == [c, "n"]
        assert rows(got) == rows(t.groupBy(c).count()), (c, depth, width)
    assert rows(sketches.count_min_exact(t.where("k > 5000"), "k")) == []


def test_similarity(spark):
    t = spark.createDataFrame([(0b1010, [1.0, 0.0]), (0b1011, [0.0, 2.0]), (0, [0.0, 0.0])], "x long, v array<double>")
    assert rows(similarity.within_hamming(t, "x", 0b1010, 1).select("x")) == [(10,), (11,)]
    got = [r[0] for r in t.select(similarity.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0)))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[2] is None
    s = similarity.signatures(t, "v", 2, tables=3, bits=4)
    assert s.count() == 9 and s.agg(F.max("lsh_signature")).first()[0] < 16
    assert rows(similarity.bit_slices(t, "x", 4)) == [(0, 1), (1, 2), (2, 0), (3, 2)]
    kinds = {"int": ["1", "2", None], "double": ["1.23456789", "-20.5e10"], "text": ["abc", "b"], "boolean": ["true", "FALSE"], "null": [None]}
    assert {k: similarity.column_kind(spark.createDataFrame([(x,) for x in v], "c string"), "c") for k, v in kinds.items()} == {k: k for k in kinds}


def test_files(spark, tmp_path):
    (tmp_path / "n.tbl").write_text("n_nationkey|n_name|n_regionkey|n_comment\n1|A|2|x\n")
    assert rows(files.read_tpch_csv(spark, f"{tmp_path}/n.tbl", "nation")) == [(1, "A", 2, "x")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception):
        files.read_csv(spark, f"{tmp_path}/bad.csv").collect()
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert files.parquet_columns(spark, f"{tmp_path}/p") == ["id"]
    assert files.compact(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/q").count() == 3

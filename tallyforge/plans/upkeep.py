"""Files, views, catalog, log, upkeep, sketches and indexes, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.catalog import data_folder
from tallyforge.engine import Engine
from tallyforge.functions import datetimes
from tallyforge.operators import bitmaps, similarity, sketches
from tallyforge.plans.registry import Tables, query, same
from tallyforge.sources import files


def _folder(t: Tables) -> str:
    return data_folder(t.spark, None)


# ---------------------------------------------------------------- files


@query("scan_column_names", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem)")
def _names(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(c,) for c in files.parquet_columns(t.spark, f"{t.sf_dir}/lineitem.parquet")], "name string")


@query("scan_needed_columns", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def _needed(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    text = "SELECT o_custkey, count(*) AS n FROM needed_orders WHERE o_totalprice > 1000 GROUP BY o_custkey"
    e.load_parquet_for(f"{t.sf_dir}/orders.parquet", "needed_orders", text)
    return e.sql(text)


@query("csv_scan", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_nationkey * 10 AS BIGINT) AS ten FROM nation")
def _csv(t: Tables) -> DataFrame:
    path = f"{_folder(t)}/nation"
    t.nation.selectExpr("n_nationkey", "n_name", "n_nationkey * 10 AS ten").write.csv(path, header=True)
    return files.read_csv(t.spark, path)


@query("csv_scan_without_header", "SELECT CAST(n_nationkey AS BIGINT) AS col_0, n_name AS col_1 FROM nation")
def _csv_plain(t: Tables) -> DataFrame:
    path = f"{_folder(t)}/nation"
    t.nation.select("n_nationkey", "n_name").write.csv(path, header=False)
    return files.read_csv(t.spark, path, header=False)


@query("csv_scan_tpch", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, 'of ' || r_name AS r_comment FROM region")
def _csv_tpch(t: Tables) -> DataFrame:
    path = f"{_folder(t)}/region"
    t.region.selectExpr("r_regionkey", "r_name", "'of ' || r_name AS r_comment").write.csv(path, header=True, sep="|")
    return files.read_tpch_csv(t.spark, path, "region")


@query("copy_to_and_from", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _copy(t: Tables) -> DataFrame:
    e, path = Engine(t.spark), f"{_folder(t)}/customer"
    e.register("copied_from", t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment"))
    e.sql(f"COPY copied_from TO '{path}'")
    kind = t.customer.schema["c_custkey"].dataType.simpleString()
    e.sql(f"CREATE TABLE copied_to (c_custkey {kind}, c_mktsegment TEXT)")
    e.sql(f"COPY copied_to FROM '{path}'")
    return e.sql("SELECT * FROM copied_to")


@query("backup_and_restore", "SELECT s_suppkey, s_acctbal FROM supplier")
def _backup(t: Tables) -> DataFrame:
    e, path = Engine(t.spark), f"{_folder(t)}/backup"
    e.register("backup_supplier", t.supplier.select("s_suppkey", "s_acctbal"))
    e.backup(path)
    other = Engine(t.spark)
    other.restore(path)
    return other.sql("SELECT * FROM backup_supplier")


def _changed(t: Tables, **how) -> Engine:
    """A table that has been inserted into, updated and deleted from."""
    e = Engine(t.spark, **how)
    e.sql("CREATE TABLE kept_nation (id INT, name TEXT)")
    values = ", ".join(f"({k}, 'n{k}')" for k in range(25))
    e.batch(f"INSERT INTO kept_nation VALUES {values}; UPDATE kept_nation SET name = 'even' WHERE id % 2 = 0; DELETE FROM kept_nation WHERE id > 20")
    return e


_CHANGED = "SELECT CAST(n_nationkey AS INTEGER) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'n' || n_nationkey END AS name FROM nation WHERE n_nationkey <= 20"


@query("checkpoint_statement", _CHANGED)
def _checkpoint(t: Tables) -> DataFrame:
    e = _changed(t)
    e.sql("CHECKPOINT")
    return e.sql("SELECT * FROM kept_nation")


@query("vacuum_statement", _CHANGED)
def _vacuum(t: Tables) -> DataFrame:
    e = _changed(t)
    if e.sql("VACUUM").first().rows_affected < 1:
        raise AssertionError("nothing was freed")
    return e.sql("SELECT * FROM kept_nation")


@query("log_replay", _CHANGED)
def _replay(t: Tables) -> DataFrame:
    path = f"{_folder(t)}/log"
    _changed(t, log_path=path)
    other = Engine(t.spark, log_path=path)
    other.replay()
    return other.sql("SELECT * FROM kept_nation")


@query("cursor_pages", "SELECT CAST(n_nationkey // 10 AS BIGINT) AS page, count(*) AS n FROM nation GROUP BY 1")
def _cursor(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("cursor_nation", t.nation)
    pages = [(k, len(page)) for k, page in enumerate(e.cursor("SELECT * FROM cursor_nation ORDER BY n_nationkey", 10))]
    return t.spark.createDataFrame(pages, "page long, n long")


# ---------------------------------------------------------------- views, tables, indexes, constraints


@query("view_of_view", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 2000 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def _view(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("viewed_orders", t.orders)
    e.batch("CREATE VIEW dear_orders AS SELECT * FROM viewed_orders WHERE o_totalprice > 1; CREATE OR ALTER VIEW dear_orders AS SELECT * FROM viewed_orders WHERE o_totalprice > 2000; CREATE VIEW done_orders AS SELECT * FROM dear_orders WHERE o_orderstatus = 'F'")
    return e.sql("SELECT o_orderpriority, count(*) AS n FROM done_orders GROUP BY o_orderpriority")


@query("view_dropped", "SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def _view_dropped(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("viewed_region", t.region)
    e.batch("CREATE VIEW few_regions AS SELECT * FROM viewed_region; DROP VIEW few_regions; DROP VIEW IF EXISTS few_regions; CREATE VIEW few_regions AS SELECT r_regionkey FROM viewed_region WHERE r_regionkey > 2")
    return e.sql("SELECT * FROM few_regions")


@query("table_dropped", "SELECT 'second' AS name, CAST(2 AS BIGINT) AS n")
def _dropped(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.batch("CREATE TABLE passing (id INT); INSERT INTO passing VALUES (1); DROP TABLE passing; DROP TABLE IF EXISTS passing; CREATE TABLE passing (name TEXT, n BIGINT); INSERT INTO passing VALUES ('second', 2)")
    return e.sql("SELECT * FROM passing")


@query("schema_qualified", "SELECT n_name FROM nation WHERE n_nationkey < 5")
def _schema(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    t.nation.createOrReplaceTempView("schema_nation")
    e.batch("CREATE SCHEMA sales; CREATE TABLE sales.few (n_name TEXT); INSERT INTO sales.few SELECT n_name FROM schema_nation WHERE n_nationkey < 5")
    return e.sql("SELECT * FROM sales.few")


@query("index_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _index(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("indexed_orders", t.orders)
    e.batch("CREATE INDEX by_customer ON indexed_orders (o_custkey)")
    return e.sql("SELECT o_orderkey, o_totalprice FROM indexed_orders WHERE o_custkey = 7")


@query("constraints", "SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(n_nationkey + 1 AS BIGINT) AS number FROM nation WHERE n_nationkey < 10")
def _constraints(t: Tables) -> DataFrame:
    """Rows that break a constraint are refused, and the table stays as it was."""
    from tallyforge.errors import InvalidArgument

    e = Engine(t.spark)
    t.nation.createOrReplaceTempView("constraint_nation")
    e.batch("CREATE TABLE parents (id INT PRIMARY KEY); INSERT INTO parents VALUES (1); CREATE TABLE children (id INT PRIMARY KEY, number BIGINT IDENTITY, up INT REFERENCES parents)")
    e.sql("INSERT INTO children (id, up) SELECT n_nationkey, 1 FROM (SELECT * FROM constraint_nation WHERE n_nationkey < 10 ORDER BY n_nationkey)")
    for wrong in ("(3, 1)", "(NULL, 1)", "(50, 2)"):
        try:
            e.sql(f"INSERT INTO children (id, up) VALUES {wrong}")
        except InvalidArgument:
            continue
        raise AssertionError(wrong)
    return e.sql("SELECT id, number FROM children")


# ---------------------------------------------------------------- versions, procedures, session, plans


def _temporal(t: Tables) -> Engine:
    ticks = iter(range(1000, 10**9, 1000))
    e = Engine(t.spark, clock=lambda: next(ticks))
    t.nation.createOrReplaceTempView("temporal_source")
    e.batch("CREATE TABLE aging (id INT, name TEXT) WITH (SYSTEM_VERSIONING = ON); INSERT INTO aging SELECT n_nationkey, n_name FROM temporal_source; UPDATE aging SET name = 'x' WHERE id > 3; DELETE FROM aging WHERE id > 20")
    return e


@query("temporal_version_counts", "SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(CASE WHEN n_nationkey > 3 THEN 2 ELSE 1 END AS BIGINT) AS versions FROM nation")
def _versions(t: Tables) -> DataFrame:
    return _temporal(t).version_counts("aging")


@query("temporal_all", "SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(n_nationkey AS INTEGER), 'x' FROM nation WHERE n_nationkey > 3")
def _all(t: Tables) -> DataFrame:
    return _temporal(t).versions("aging").select("id", "name")


@query("temporal_between", "SELECT CAST(n_nationkey AS INTEGER) AS id, CASE WHEN n_nationkey > 3 THEN 'x' ELSE n_name END AS name FROM nation")
def _between(t: Tables) -> DataFrame:
    return _temporal(t).sql("SELECT id, name FROM aging FOR SYSTEM_TIME BETWEEN 3500 AND 3600")


@query("table_type_argument", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (3, 5, 8)")
def _table_type(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("typed_orders", t.orders)
    e.sql("CREATE TYPE id_list AS TABLE (id BIGINT)")
    e.sql("CREATE PROCEDURE orders_of (@ids id_list READONLY) AS SELECT o_orderkey, o_totalprice FROM typed_orders WHERE o_custkey IN (SELECT id FROM @ids)")
    return e.sql("EXEC orders_of ((VALUES (3), (5), (8)))")


@query("session_context", "SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def _context(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("context_customer", t.customer)
    e.set_context("segment", t.customer.agg(F.min("c_mktsegment")).first()[0])
    return e.sql("SELECT c_custkey FROM context_customer WHERE c_mktsegment = SESSION_CONTEXT(N'segment')")


@query("explain_statement", "SELECT true AS reads_two_columns, true AS pushes_filter")
def _explain(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("explained_orders", t.orders)
    plan = e.sql("EXPLAIN SELECT sum(o_totalprice) FROM explained_orders WHERE o_custkey = 7")
    return plan.select(F.regexp_like("plan", F.lit(r"ReadSchema: struct<o_custkey:\w+,o_totalprice:\w+>")).alias("reads_two_columns"), F.regexp_like("plan", F.lit(r"PushedFilters: \[[^\]]*EqualTo\(o_custkey,7\)")).alias("pushes_filter"))


@query("analyze_statement", "SELECT true AS timed")
def _analyze(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("analyzed_orders", t.orders)
    return e.sql("ANALYZE SELECT count(*) FROM analyzed_orders").select((F.col("execution_time_ms") > 0).alias("timed"))


@query("count_distinct_spelling", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def _spelling(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("spelled_orders", t.orders)
    return e.sql("SELECT COUNT_DISTINCT(o_custkey) AS n FROM spelled_orders")


same("time_now", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate < now() GROUP BY o_orderstatus")
same("timestamp_split", "SELECT event_id, CAST(ts AS DATE) AS d, date_format(ts, 'HH:mm:ss') AS s FROM events", "SELECT event_id, CAST(ts AS DATE) AS d, strftime(ts, '%H:%M:%S') AS s FROM events")


@query("time_make", "SELECT n_nationkey, CAST(make_time(n_nationkey % 24, n_nationkey * 2, CAST(n_nationkey AS DOUBLE)) AS VARCHAR) AS at FROM nation")
def _time_make(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select(k, datetimes.make_time((k % 24).cast("int"), (k * 2).cast("int"), k.cast("decimal(16,6)")).alias("at"))


# ---------------------------------------------------------------- sketches, with the true values beside what they must be near to


@query("hll_per_group", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS within FROM lineitem GROUP BY l_returnflag")
def _hll(t: Tables) -> DataFrame:
    e, n = sketches.hll_estimate(sketches.hll("l_partkey", 12)), F.count_distinct("l_partkey")
    return t.lineitem.groupBy("l_returnflag").agg(n.alias("n"), (F.abs(e / n - 1) < 4 * sketches.hll_error(12)).alias("within"))


@query("count_min_narrow", "SELECT l_suppkey, count(*) AS n, true AS within FROM lineitem GROUP BY l_suppkey")
def _count_min(t: Tables) -> DataFrame:
    """A sketch that is too narrow to be exact: never below the count, and above it by at most e / width of all rows (for e**-depth of the keys; here
    the depth leaves none)."""
    s = sketches.count_min(t.lineitem, "l_suppkey", 12, 64)
    told = sketches.count_min_estimate(s, t.lineitem, "l_suppkey", 12, 64)
    rows = t.lineitem.agg(F.count("*").alias("all"))
    both = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).join(told, "l_suppkey").join(F.broadcast(rows))
    return both.select("l_suppkey", "n", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.col("all") * 2.72 / 64)).alias("within"))


@query("quantiles_per_group", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS median, true AS within FROM orders GROUP BY o_orderstatus")
def _quantiles(t: Tables) -> DataFrame:
    """The KLL sketch's median lies between the exact 47th and 53rd percentiles."""
    told = sketches.kll_quantile(sketches.kll("o_totalprice"), 0.5)
    exact = F.percentile("o_totalprice", [0.47, 0.5, 0.53])
    return t.orders.groupBy("o_orderstatus").agg(exact.alias("p"), told.alias("told")).select("o_orderstatus", F.col("p")[1].alias("median"), F.col("told").between(F.col("p")[0], F.col("p")[2]).alias("within"))


@query("approximate_percentile", "SELECT o_orderstatus, true AS within FROM orders GROUP BY o_orderstatus")
def _percentile(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("percentile_orders", t.orders)
    told = e.sql("SELECT o_orderstatus, PERCENTILE(o_totalprice, 0.9) AS told FROM percentile_orders GROUP BY o_orderstatus APPROXIMATE WITHIN 1% CONFIDENCE 99%")
    exact = t.orders.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", [0.88, 0.92]).alias("p"))
    return told.join(exact, "o_orderstatus").select("o_orderstatus", F.col("told").between(F.col("p")[0], F.col("p")[1]).alias("within"))


@query("error_through_join", "SELECT r_regionkey AS k, round(sqrt(power(0.01 * (r_regionkey + 1), 2) + power(0.02 * 3, 2)), 12) AS error, round(CAST(0.05 + 0.01 * (r_regionkey + 1) AS DOUBLE), 12) AS chance FROM region")
def _through(t: Tables) -> DataFrame:
    rows = [(k, *(round(x, 12) for x in sketches.through_join(0.01 * (k + 1), 0.05, 0.02, 0.01 * (k + 1), 3.0))) for k in range(5)]
    return t.spark.createDataFrame(rows, "k int, error double, chance double")


@query("join_size_bounds", "WITH c AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM nation) AS n) SELECT round(sqrt(CAST(o AS DOUBLE) * c * n), 3) AS triangle, round(CAST(o AS DOUBLE) * n, 3) AS chain, CAST(least(o, c) AS BIGINT) AS by_key FROM c")
def _bounds(t: Tables) -> DataFrame:
    """The AGM bound of a triangle and of a chain a-b-c-d, whose middle relation needs no weight."""
    o, c, n = (df.count() for df in (t.orders, t.customer, t.nation))
    triangle = sketches.agm_bound({"r": ("a", "b"), "s": ("b", "c"), "t": ("a", "c")}, {"r": o, "s": c, "t": n})
    chain = sketches.agm_bound({"r": ("a", "b"), "s": ("b", "c"), "t": ("c", "d")}, {"r": o, "s": c, "t": n})
    return t.spark.createDataFrame([(round(triangle, 3), round(chain, 3), sketches.join_estimate(o, c))], "triangle double, chain double, by_key long")


# ---------------------------------------------------------------- bitmaps, slices, zones, filters


@query("bitmap_algebra", "SELECT CAST(o_orderkey AS BIGINT) AS row FROM orders WHERE o_totalprice > 1000 AND (o_orderstatus = 'F' OR o_custkey < 50) AND NOT o_orderkey % 3 = 0")
def _algebra(t: Tables) -> DataFrame:
    of = lambda text: bitmaps.bitmap(t.orders, "o_orderkey", F.expr(text))
    found = bitmaps.both(of("o_totalprice > 1000"), bitmaps.either(of("o_orderstatus = 'F'"), of("o_custkey < 50")))
    return bitmaps.set_indices(bitmaps.without(found, of("o_orderkey % 3 = 0"))).select(F.col("row").cast("long"))


@query("bitmap_popcount", "SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE o_totalprice > 1000")
def _popcount(t: Tables) -> DataFrame:
    return bitmaps.popcount(bitmaps.bitmap(t.orders, "o_orderkey", F.col("o_totalprice") > 1000))


@query("bit_sliced_equal", "SELECT CAST(o_orderkey AS BIGINT) AS row FROM orders WHERE o_custkey = 11")
def _sliced(t: Tables) -> DataFrame:
    index = bitmaps.bit_sliced_index(t.orders, "o_orderkey", "o_custkey", 24)
    return bitmaps.set_indices(bitmaps.find_equal(index, 11, 24)).select(F.col("row").cast("long"))


@query("zone_pruning", "WITH z AS (SELECT CAST(o_orderkey // 1024 AS BIGINT) AS zone, count(*) AS rows, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders GROUP BY 1) SELECT * FROM z WHERE max_o_custkey >= 10 AND min_o_custkey <= 20")
def _zones(t: Tables) -> DataFrame:
    return bitmaps.zones_with(bitmaps.zones(t.orders, "o_orderkey", ["o_custkey"]), "o_custkey", 10, 20)


@query("join_bloom_filter", "SELECT count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem JOIN (SELECT * FROM orders WHERE o_totalprice > 3000 AND o_orderkey % 7 = 0) ON l_orderkey = o_orderkey")
def _bloom(t: Tables) -> DataFrame:
    few = t.orders.where("o_totalprice > 3000 AND o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return bitmaps.reduced(t.lineitem.select("l_orderkey", "l_quantity"), few, "l_orderkey").join(few, "l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@query("index_advice", 'WITH c AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_orderstatus) AS c FROM orders) SELECT unnest([\'o_orderkey\', \'o_custkey\', \'o_orderstatus\']) AS "column", unnest([a / n > 0.1, b / n > 0.1, c / n > 0.1]) AS use_index FROM c')
def _advice(t: Tables) -> DataFrame:
    return bitmaps.should_use_index(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("column_kinds", "SELECT 'o_orderkey' AS c, 'int' AS kind UNION ALL SELECT 'o_totalprice', 'double' UNION ALL SELECT 'o_orderstatus', 'text' UNION ALL SELECT 'paid', 'boolean' UNION ALL SELECT 'nothing', 'null'")
def _kinds(t: Tables) -> DataFrame:
    df = t.orders.selectExpr("CAST(o_orderkey AS STRING) AS o_orderkey", "CAST(o_totalprice AS STRING) AS o_totalprice", "o_orderstatus", "CAST(o_totalprice > 1000 AS STRING) AS paid", "CAST(NULL AS STRING) AS nothing")
    return t.spark.createDataFrame([(c, similarity.column_kind(df, c)) for c in df.columns], "c string, kind string")


@query("lsh_lookup", "SELECT CAST(50 AS BIGINT) AS asked, true AS finds_itself, true AS scores_are_exact")
def _lsh(t: Tables) -> DataFrame:
    """Fifty vectors looked up among all: the union of their buckets over the tables, then exact scores."""
    table = t.embeddings.select("vec_id", "embedding")
    asked = table.where("vec_id < 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    found = similarity.lsh_lookup(table, "embedding", asked, "asked", 64, tables=4, bits=8)
    exact = F.abs(F.col("score") - similarity.cosine(F.col("embedding"), F.col("asked"))) < 1e-12
    itself = F.max(F.when(F.col("query_id") == F.col("vec_id"), F.col("score")).otherwise(F.lit(-1.0)))
    per = found.groupBy("query_id").agg((itself > 0.999999).alias("itself"), F.bool_and(exact).alias("exact"))
    return per.agg(F.count("*").alias("asked"), F.bool_and("itself").alias("finds_itself"), F.bool_and("exact").alias("scores_are_exact"))

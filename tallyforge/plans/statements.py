"""What the statement layer leaves behind after changes, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyforge.engine import Engine
from tallyforge.plans.registry import Tables, query


def _engine(t: Tables, name: str, source: DataFrame, temporal: bool = False) -> Engine:
    ticks = iter(range(1000, 10**9, 1000))
    engine = Engine(t.spark, clock=lambda: next(ticks))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString().replace('string', 'text')}" for f in source.schema)
    engine.sql(f"CREATE TABLE {name} ({columns})" + " WITH (SYSTEM_VERSIONING = ON)" * temporal)
    source.createOrReplaceTempView(f"{name}_source")
    engine.sql(f"INSERT INTO {name} SELECT * FROM {name}_source")
    return engine


@query("dml_insert", "SELECT p_partkey, p_size FROM part UNION ALL VALUES (-1, NULL), (-2, 7)")
def _insert(t: Tables) -> DataFrame:
    e = _engine(t, "dml_part", t.part.select("p_partkey", "p_size"))
    e.sql("INSERT INTO dml_part (p_partkey) VALUES (-1)")
    e.sql("INSERT INTO dml_part VALUES (-2, 7)")
    return e.sql("SELECT * FROM dml_part")


@query("dml_update", "SELECT p_partkey, CASE WHEN p_size > 25 AND p_type = 'PROMO' THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def _update(t: Tables) -> DataFrame:
    e = _engine(t, "dml_part", t.part.select("p_partkey", "p_size", "p_type"))
    e.sql("UPDATE dml_part SET p_size = p_size + 100 WHERE p_size > 25 AND p_type = 'PROMO'")
    return e.sql("SELECT p_partkey, p_size FROM dml_part")


@query("dml_delete", "SELECT p_partkey FROM part WHERE NOT (p_size > 25 OR p_brand LIKE '%1')")
def _delete(t: Tables) -> DataFrame:
    e = _engine(t, "dml_part", t.part.select("p_partkey", "p_size", "p_brand"))
    e.sql("DELETE FROM dml_part WHERE p_size > 25 OR p_brand LIKE '%1'")
    return e.sql("SELECT p_partkey FROM dml_part")


@query("dml_merge", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), 'new' FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey >= 20")
def _merge(t: Tables) -> DataFrame:
    e = _engine(t, "dml_nation", t.nation.where("n_nationkey < 20").selectExpr("n_nationkey AS id", "n_name AS name"))
    t.nation.where("n_nationkey % 2 = 0").createOrReplaceTempView("dml_evens")
    e.sql("MERGE INTO dml_nation t USING dml_evens s ON t.id = s.n_nationkey WHEN MATCHED THEN UPDATE SET name = 'even' WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.n_nationkey + 100, 'new')")
    return e.sql("SELECT * FROM dml_nation")


@query("txn_rollback", "SELECT count(*) AS n FROM nation")
def _rollback(t: Tables) -> DataFrame:
    e = _engine(t, "dml_nation", t.nation)
    e.batch("BEGIN; DELETE FROM dml_nation WHERE n_nationkey > 3; SAVEPOINT a; DELETE FROM dml_nation; ROLLBACK TO a; ROLLBACK")
    return e.sql("SELECT count(*) AS n FROM dml_nation")


@query("temporal_as_of", "SELECT n_nationkey, n_name FROM nation")
def _as_of(t: Tables) -> DataFrame:
    e = _engine(t, "dml_nation", t.nation.select("n_nationkey", "n_name"), temporal=True)
    e.sql("UPDATE dml_nation SET n_name = 'x' WHERE n_nationkey > 3")
    return e.sql("SELECT * FROM dml_nation FOR SYSTEM_TIME AS OF 1500")


@query("alter_table", "SELECT r_regionkey, CAST(7 AS BIGINT) AS extra FROM region")
def _alter(t: Tables) -> DataFrame:
    e = _engine(t, "dml_region", t.region)
    e.batch("ALTER TABLE dml_region ADD COLUMN extra INT DEFAULT 7; ALTER TABLE dml_region ALTER COLUMN extra TYPE BIGINT; ALTER TABLE dml_region DROP COLUMN r_name")
    return e.sql("SELECT * FROM dml_region")


@query("procedure_exec", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def _procedure(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("customer", t.customer)
    e.sql("CREATE PROCEDURE per_segment (@least INT) AS SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > @least GROUP BY c_mktsegment")
    return e.sql("EXEC per_segment 1000")


@query("pivot_statement", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O FROM orders GROUP BY o_orderpriority")
def _pivot(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("pivot_orders", t.orders.select("o_orderpriority", "o_orderstatus", "o_orderkey"))
    return e.sql("SELECT * FROM pivot_orders PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ([F], [O])) AS p")


@query("similar_to", "SELECT o_orderkey FROM orders WHERE bit_count(xor(o_orderkey, 255)) <= 2")
def _similar(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.register("similar_orders", t.orders)
    return e.sql("SELECT o_orderkey FROM similar_orders SIMILAR TO o_orderkey x'FF' WITHIN HAMMING DISTANCE 2 TIER hot")

"""Files in and out: Parquet, CSV with or without header, pipe-separated TPC-H files, COPY, backup and restore."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.errors import InvalidArgument, NotFound

#: The columns of the TPC-H tables; i BIGINT, f DOUBLE, d DATE, s STRING.
TPCH = {
    "region": "r_regionkey:i r_name:s r_comment:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i n_comment:s",
    "customer": "c_custkey:i c_name:s c_address:s c_nationkey:i c_phone:s c_acctbal:f c_mktsegment:s c_comment:s",
    "supplier": "s_suppkey:i s_name:s s_address:s s_nationkey:i s_phone:s s_acctbal:f s_comment:s",
    "part": "p_partkey:i p_name:s p_mfgr:s p_brand:s p_type:s p_size:i p_container:s p_retailprice:f p_comment:s",
    "partsupp": "ps_partkey:i ps_suppkey:i ps_availqty:i ps_supplycost:f ps_comment:s",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f o_orderdate:d o_orderpriority:s o_clerk:s o_shippriority:i o_comment:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:d l_commitdate:d l_receiptdate:d l_shipinstruct:s l_shipmode:s l_comment:s",
}
_KINDS = {"i": T.LongType(), "f": T.DoubleType(), "d": T.DateType(), "s": T.StringType()}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_columns(spark: SparkSession, path: str) -> list[str]:
    """From the footer alone."""
    return spark.read.parquet(path).columns


def needed_columns(spark: SparkSession, path: str, name: str, sql: str) -> list[str]:
    """The columns of ``path`` that ``sql`` over the table ``name`` reads, as the optimizer prunes them."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    plan = spark.sql(sql)._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    names: set[str] = set()
    for k in range(leaves.size()):
        for used in _names(plan, leaves.apply(k)):
            names.add(used)
    return [c for c in parquet_columns(spark, path) if c in names]


def _names(plan, leaf) -> list[str]:
    out = leaf.output()
    every = {out.apply(k).exprId().id(): out.apply(k).name() for k in range(out.size())}
    used: set[int] = set()
    stack = [plan]
    while stack:
        node = stack.pop()
        children = node.children()
        refs = node.references().toSeq()
        used |= {refs.apply(k).exprId().id() for k in range(refs.size())}
        if node is plan:
            top = node.outputSet().toSeq()
            used |= {top.apply(k).exprId().id() for k in range(top.size())}
        stack += [children.apply(k) for k in range(children.size())]
    return [n for i, n in every.items() if i in used]


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV: a column whose values are all integers is BIGINT, others are text; without header the names are col_0, col_1, ...
    Rows with more or fewer values than the first are an error."""
    if schema is not None:
        return spark.read.csv(path, header=header, schema=schema, sep=sep, mode="FAILFAST")
    text = spark.read.csv(path, header=header, sep=sep, mode="FAILFAST", enforceSchema=False)
    if not header:
        text = text.toDF(*[f"col_{k}" for k in range(len(text.columns))])
    whole = text.agg(*[(F.count_if(F.col(f"`{c}`").try_cast("long").isNull() & F.col(f"`{c}`").isNotNull()) == 0).alias(c) for c in text.columns]).first()
    return text.select(*[F.col(f"`{c}`").cast("long").alias(c) if whole[c] else F.col(f"`{c}`") for c in text.columns])


def tpch_schema(table: str) -> T.StructType:
    if table not in TPCH:
        raise NotFound(f"no TPC-H table {table!r}")
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(":") for c in TPCH[table].split())])


def read_tpch_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Pipe-separated, with a header row."""
    return read_csv(spark, path, True, tpch_schema(table), "|")


def write_csv(df: DataFrame, path: str) -> int:
    """COPY TO: a folder of CSV files, one per task, each with a header. Returns the rows written, counted as they are."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(path, header=True)
    return seen.get["n"]


def backup(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Each table as Parquet, and a manifest as JSON."""
    rows = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, df.schema.json()))
    if rows:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return [r[0] for r in rows]


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = spark.read.schema("name string, schema string").json(f"{path}/_manifest").collect()
    return {r.name: spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.name}") for r in manifest}


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """Rewrite a table of many small files."""
    if rows_per_file < 1:
        raise InvalidArgument("rows_per_file must be positive")
    n = max(1, -(-df.count() // rows_per_file))
    df.repartition(n).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are asked for: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the tables that it names."""
        words = set(text.lower().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in TABLES:
            if name in words:
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, oracle: str | None = None):
    """Register ``f(tables)`` under ``name``."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def same(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL that both dialects read alike, or ``oracle`` for the other one."""
    query(name, oracle or text)(lambda t: t.sql(text))

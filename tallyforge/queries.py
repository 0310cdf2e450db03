"""The registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import catalogue, statements, tpch, upkeep, web, windows  # noqa: F401  they register their queries
from tallyforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "entry_query"]


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["tpch_q01"](spark, sf_dir)

"""Recursion to a fixed point with set semantics, for cyclic data that ``WITH RECURSIVE`` would not end on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rounds if nothing else is said, and the most if told 0.
DEFAULT_ROUNDS, NO_LIMIT = 100, 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file://{tempfile.gettempdir()}/tallyforge-shared").rstrip("/")


def fixpoint(anchor: DataFrame, body: Callable[[DataFrame], DataFrame], max_rounds: int = DEFAULT_ROUNDS) -> DataFrame:
    """``anchor`` and all that ``body`` makes of the rows that the round before was the first to give. Rows are distinct.

    Ends when a round gives nothing new; more than ``max_rounds`` rounds (0: no limit) is an error. Every round is a written table in
    the shared folder, which cuts lineage and outlives executors.
    """
    spark = anchor.sparkSession
    base = f"{shared_folder(spark)}/recursion-{uuid.uuid4().hex}"
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        paths.append(f"{base}/{len(paths)}")
        df.write.parquet(paths[-1])
        return spark.read.schema(anchor.schema).parquet(paths[-1])

    new = put(anchor.distinct())
    rounds = 0
    while not new.isEmpty():
        if rounds >= (max_rounds or NO_LIMIT):
            raise RecursionError(f"no fixed point after {rounds} rounds")
        rounds += 1
        seen = spark.read.schema(anchor.schema).parquet(*paths)
        new = put(body(new).toDF(*anchor.columns).subtract(seen))
    return spark.read.schema(anchor.schema).parquet(*paths)

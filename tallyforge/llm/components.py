"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import dropped, stored

#: A component of n nodes needs about the square of log n rounds; this is far beyond.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``a, b`` (long, undirected; null ends and loops are ignored) to ``node, label``: the least node of its component, for every node with an edge.

    Every round is a written table, so lost executors cost that round's tasks at most. A node with very many edges is one side of joins that
    AQE splits, and minima are taken in each task first.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, now = now, stored(small, "edges")
        dropped(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            if scratch is not None:
                scratch.append(now)
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")

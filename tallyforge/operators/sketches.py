"""Mergeable sketches and approximate answers.

HyperLogLog and quantile sketches are Spark's own; Count-Min is kept as a table of counters, so that it can be merged and asked in SQL.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import bitmaps


def hll_error(p: int) -> float:
    """Relative standard error with 2**p registers."""
    return 1.04 / math.sqrt(1 << p)


def hll(c: Column | str, p: int = 12) -> Column:
    """Aggregate: a sketch that merges."""
    return F.hll_sketch_agg(c, p)


def hll_merge(sketch: Column | str) -> Column:
    return F.hll_union_agg(sketch)


def hll_estimate(sketch: Column | str) -> Column:
    return F.hll_sketch_estimate(sketch)


def approximate_distinct(c: Column | str, p: int = 12) -> Column:
    return F.approx_count_distinct(c, hll_error(p))


def _buckets(c: str, depth: int, width: int) -> list[Column]:
    """The key's bucket in each row."""
    return [F.pmod(F.xxhash64(F.lit(d), c), F.lit(width)) for d in range(depth)]


def _cells(c: str, depth: int, width: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(d).alias("row"), bucket.alias("bucket")) for d, bucket in enumerate(_buckets(c, depth, width))]))


def count_min(df: DataFrame, c: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """``row, bucket, n``: at most depth x width counters, summed in each task first."""
    return df.where(F.col(c).isNotNull()).select(_cells(c, depth, width).alias("b")).groupBy("b.row", "b.bucket").agg(F.count("*").alias("n"))


def count_min_merge(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def count_min_estimate(sketch: DataFrame, keys: DataFrame, c: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """``c, estimate`` per distinct key: never below the true count."""
    asked = keys.select(c).distinct().select(c, _cells(c, depth, width).alias("b")).select(c, "b.row", "b.bucket")
    return asked.join(sketch, ["row", "bucket"], "left").groupBy(c).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def count_min_exact(df: DataFrame, c: str, depth: int = 5, width: int = 2048) -> DataFrame:
    """``c, n`` per distinct key, null among them: the true counts, however many keys there are.

    The counters also hold their least and greatest key. One that has a single key is exact, and so that key's estimate. Keys that share
    all their counters are counted in a second pass, as are rows without a key, which are in no counter. The filter for these is one row
    of a bit for each counter, so its broadcast is bounded whatever the table's size."""
    cells = df.where(F.col(c).isNotNull()).select(c, _cells(c, depth, width).alias("b")).groupBy("b.row", "b.bucket")
    counters = cells.agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"))
    told = counters.where("low = high").groupBy(F.col("low").alias(c)).agg(F.min("n").alias("n"))
    # ``n > 1`` follows from the rest; with it this reads the same columns as ``told``, so Spark fills the counters once for both.
    placed = counters.withColumn("cell", F.col("row").cast("long") * width + F.col("bucket"))
    none = df.sparkSession.range(-(-depth * width // 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bitmaps.either(none, bitmaps.bitmap(placed, "cell", (F.col("n") > 1) & (F.col("low") != F.col("high"))))
    shared = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("_shared"))
    at = [F.lit(d).cast("long") * width + bucket for d, bucket in enumerate(_buckets(c, depth, width))]
    all_shared = reduce(Column.__and__, [F.getbit(F.get("_shared", F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1 for x in at])
    rest = df.select(c).join(F.broadcast(shared)).where(F.col(c).isNull() | all_shared)
    return told.unionByName(rest.groupBy(c).agg(F.count("*").alias("n")))


def quantiles(c: Column | str, at: list[float], accuracy: int = 10_000) -> Column:
    """Aggregate: approximate quantiles, off by a rank of at most 1/accuracy."""
    return F.percentile_approx(c, at, accuracy)


def kll(c: Column | str, k: int = 200) -> Column:
    """Aggregate: a mergeable quantile sketch of doubles (KLL)."""
    return F.kll_sketch_agg_double(c, F.lit(k))


def kll_quantile(sketch: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


@dataclass(frozen=True)
class Estimate:
    """An answer that is within ``half_width`` of the true one with the asked confidence, from ``fraction`` of the rows."""

    value: float
    half_width: float
    fraction: float
    rows: int


def bernstein_half_width(variance: float, spread: float, n: int, delta: float) -> float:
    """Empirical Bernstein bound of a mean of n values."""
    if n < 2:
        return math.inf
    log = math.log(3 / delta)
    return math.sqrt(2 * variance * log / n) + 3 * spread * log / n


#: Shares of the rows read one after the other; the last reads all.
FRACTIONS = (0.01, 0.03, 0.1, 0.3, 1.0)


def approximate_mean(df: DataFrame, c: str, within: float, confidence: float = 0.95, total: bool = False, seed: int = 11) -> Estimate:
    """Mean (or sum) of a column by samples that grow until the bound is met; a few rounds, the last of which is exact.

    ``within`` is relative to the value. Each round shares the error probability. Nulls are left out; an empty column gives nan.
    """
    stats = df.agg(F.min(c).cast("double"), F.max(c).cast("double"), F.count(c)).first()
    low, high, n_all = stats
    if not n_all:
        return Estimate(math.nan, 0.0, 1.0, 0)
    delta = (1 - confidence) / len(FRACTIONS)
    scale = n_all if total else 1
    for f in FRACTIONS:
        part = df if f == 1 else df.sample(False, f, seed)
        n, mean, var = part.agg(F.count(c), F.avg(F.col(c).cast("double")), F.var_pop(F.col(c).cast("double"))).first()
        half = 0.0 if f == 1 else bernstein_half_width(var or 0.0, high - low, n, delta)
        if f == 1 or n and half <= within * abs(mean):
            return Estimate(mean * scale, half * scale, f, n)
    raise AssertionError


def through_join(eps_r: float, delta_r: float, eps_s: float, delta_s: float, spread: float) -> tuple[float, float]:
    """Error and its probability after a join of two approximate inputs."""
    return math.sqrt(eps_r**2 + (eps_s * spread) ** 2), delta_r + delta_s


def histogram(df: DataFrame, c: str, buckets: int = 100) -> DataFrame:
    """``bucket`` (1..buckets), ``low``, ``high`` and ``n`` of equal widths between the least and the greatest value; empty ones are left out."""
    low, high = df.agg(F.min(c).cast("double"), F.max(c).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bucket long, low double, high double, n long")
    width = (high - low) / buckets or 1.0
    at = F.least(F.floor((F.col(c).cast("double") - low) / width) + 1, F.lit(buckets)).cast("long")
    return df.where(F.col(c).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n")).select("bucket", (F.lit(low) + (F.col("bucket") - 1) * width).alias("low"), (F.lit(low) + F.col("bucket") * width).alias("high"), "n")


def range_selectivity(hist: DataFrame, low: float, high: float) -> float:
    """Share of the rows between two values, evenly spread within buckets."""
    inside = F.greatest(F.lit(0.0), F.least("high", F.lit(high)) - F.greatest("low", F.lit(low))) / (F.col("high") - F.col("low"))
    got = hist.agg(F.sum(F.col("n") * inside), F.sum("n")).first()
    return float(got[0] / got[1]) if got[1] else 0.0


def join_estimate(left: int, right: int) -> int:
    """Rows of a foreign-key join."""
    return min(left, right)


def agm_triangle(r: int, s: int, t: int) -> float:
    """Most rows of a triangle join of three relations."""
    return math.sqrt(r * s * t)


def agm_bound(relations: dict[str, tuple[str, ...]], rows: dict[str, int]) -> float:
    """Most rows of a natural join of relations over attributes: the product of rows ** weight over the least fractional edge cover.

    The cover is a corner of a polytope of as many dimensions as there are relations (a query's, so few); all corners are tried."""
    names = sorted(relations)
    if any(rows[r] == 0 for r in names):
        return 0.0
    attributes = sorted({a for r in names for a in relations[r]})
    planes = [([float(a in relations[r]) for r in names], 1.0) for a in attributes] + [([float(r == s) for s in names], 0.0) for r in names]
    cost = np.log([rows[r] for r in names])
    best = math.inf
    for corner in itertools.combinations(planes, len(names)):
        matrix = np.array([p[0] for p in corner])
        if abs(np.linalg.det(matrix)) > 1e-9:
            x = np.linalg.solve(matrix, [p[1] for p in corner])
            if all(np.dot(p, x) >= least - 1e-9 for p, least in planes):
                best = min(best, float(cost @ x))
    return math.exp(best)


def prefers_multiway(agm: float, pairwise: float) -> bool:
    return agm < pairwise / 2


class CorrectedSelectivity:
    """Estimates times a running mean of actual over predicted."""

    def __init__(self, weight: float = 0.2):
        self.weight, self.factor = weight, 1.0

    def observe(self, predicted: float, actual: float) -> None:
        if predicted > 0:
            self.factor += self.weight * (actual / predicted - self.factor)

    def __call__(self, estimate: float) -> float:
        return min(1.0, max(0.0, estimate * self.factor))

"""Relational operators: thin helpers over DataFrames with ANSI semantics (null keys never match, outer joins pad with null)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], kind: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi-join on pairs of columns, with a further condition if given. Both sides' key columns stay."""
    on = reduce(Column.__and__, [left[a] == right[b] for a, b in keys])
    return left.join(right, on if residual is None else on & residual, JOIN_KINDS[kind])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def exists(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], negated: bool = False) -> DataFrame:
    """Rows of ``left`` with (or without) a match."""
    return join(left, right, keys, "anti" if negated else "semi")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """NOT IN as SQL has it: no row if ``right`` has a null, no row whose value is null unless ``right`` is empty.

    One aggregate tells which case holds, so what remains is a plain anti join: Catalyst broadcasts its right side only below the checked
    size, where a null-aware one is broadcast whatever its size.
    """
    values = right.select(F.col(other).alias("_not_in"))
    n, nulls = values.agg(F.count("*"), F.count_if(F.col("_not_in").isNull())).first()
    if not n:
        return left
    if nulls:
        return left.where(F.lit(False))
    return left.where(F.col(column).isNotNull()).join(values.distinct(), F.col(column) == F.col("_not_in"), "left_anti")


def intersect_sorted(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that all inputs have, each once. Pre-aggregating each side keeps the joins at one row per key."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [s.select(key).where(F.col(key).isNotNull()).distinct() for s in sets])


def triangles(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``x < y < z`` of all triangles of an undirected graph: each edge from the end of the smaller degree (ties: smaller id), so no
    vertex fans out by more than the square root of twice the edges."""
    e = edges.where(f"`{a}` <> `{b}`").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    degree = e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    rank = lambda c: F.struct(F.col(f"d_{c}"), F.col(c))
    for c in "uv":
        e = e.join(degree.select(F.col("n").alias(c), F.col("d").alias(f"d_{c}")), c)
    up = e.select(F.when(rank("u") < rank("v"), F.col("u")).otherwise(F.col("v")).alias("s"), F.when(rank("u") < rank("v"), F.col("v")).otherwise(F.col("u")).alias("t"))
    wedges = up.alias("p").join(up.alias("q"), F.col("p.s") == F.col("q.s")).where("p.t < q.t").select(F.col("p.s").alias("s"), F.col("p.t").alias("u"), F.col("q.t").alias("v"))
    closed = wedges.join(e.select("u", "v"), ["u", "v"], "left_semi")
    corners = F.array_sort(F.array("s", "u", "v"))
    return closed.select(corners[0].alias("x"), corners[1].alias("y"), corners[2].alias("z"))


def union_all(*parts: DataFrame) -> DataFrame:
    """By position; the first part's names win."""
    return reduce(DataFrame.unionAll, parts)


def union(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def pivot(df: DataFrame, group: str, on: str, values: Sequence, column: str, how: str = "sum", fill=None) -> DataFrame:
    """One column per value; a cell without rows is null, or ``fill``."""
    out = df.groupBy(group).pivot(on, list(values)).agg(AGGREGATES[how](column))
    return out if fill is None else out.fillna(fill, [str(v) for v in values])


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str, value: str) -> DataFrame:
    """A row per key and column, nulls included."""
    return df.unpivot(list(keys), list(columns), label, value)


def grouping_sets(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggregates)


def cube(df: DataFrame, columns: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.cube(*columns).agg(*aggregates)


def rollup(df: DataFrame, columns: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.rollup(*columns).agg(*aggregates)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Spark keeps k rows per task and merges them."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Row numbers up to k; Spark keeps k rows per group in each task before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with ``low <= value < high``. Intervals are cut into buckets of ``width``, which makes it an equi-join without repeats."""
    bucket = F.floor(F.col(value) / width)
    cut = right.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))).where(F.col(low) < F.col(high))
    return left.withColumn("_bucket", bucket).join(cut, "_bucket").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, values: Sequence[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row of ``left`` with the values of the last row of ``right`` at or before its time. Null keys and times match nothing.

    A union of both, sorted per key and ``bucket`` of the time, which must not decrease as time grows (timestamps: their day; others: one
    bucket, unless given). So a key that holds a third of the rows is many sorts. What a bucket takes over from those before it is one row per
    key and bucket.
    """
    from pyspark.sql import Window

    if bucket is None:
        days = isinstance(left.schema[time].dataType, (T.TimestampType, T.TimestampNTZType))
        bucket = (lambda c: F.date_trunc("day", c)) if days else (lambda c: F.lit(0))
    names = [f"right_{v}" for v in values]
    mine = left.withColumn("_side", F.lit(1))
    for v in values:
        mine = mine.withColumn(f"right_{v}", F.lit(None).cast(right.schema[v].dataType))
    known = right.where(F.col(by).isNotNull() & F.col(time).isNotNull())
    other = known.select(by, time, F.lit(0).alias("_side"), *[F.col(v).alias(f"right_{v}") for v in values])
    both = mine.unionByName(other, allowMissingColumns=True).withColumn("_bucket", bucket(F.col(time)))
    row, theirs = F.struct(*names), F.col("_side") == 0
    window = Window.partitionBy(by, "_bucket").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last(F.when(theirs, row), ignorenulls=True).over(window)).where("_side = 1")
    ends = both.groupBy(by, "_bucket").agg(F.max_by(F.when(theirs, row), F.when(theirs, F.col(time))).alias("_end"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(by, "_bucket", "_carried")
    out = inside.join(carried, [by, "_bucket"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return out.select(*left.columns, *[F.col(f"_last.{n}").alias(n) for n in names])

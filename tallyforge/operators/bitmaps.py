"""Bitmaps over row numbers, bit-sliced indexes and zone maps, as tables.

A bitmap is ``word, bits``: of the rows 64 * word to 64 * word + 63 those whose bits are set; words without any are left out. Every function is
an aggregate or a join by word, so nothing is as long as the table anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD, _BIT = "CAST(floor({0} / 64) AS LONG)", "shiftleft(1L, CAST(pmod({0}, 64) AS INT))"


def bitmap(df: DataFrame, row: str, condition: Column) -> DataFrame:
    """The rows, numbered by the column ``row``, for which the condition holds."""
    return df.where(condition).groupBy(F.expr(_WORD.format(row)).alias("word")).agg(F.bit_or(F.expr(_BIT.format(row))).alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND."""
    return a.join(b.withColumnRenamed("bits", "_bits"), "word").select("word", F.col("bits").bitwiseAND(F.col("_bits")).alias("bits")).where("bits <> 0")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND NOT. NOT is ``without`` of the bitmap of all rows."""
    joined = a.join(b.withColumnRenamed("bits", "_bits"), "word", "left")
    return joined.select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_bits", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")


def popcount(a: DataFrame) -> DataFrame:
    """``n``: how many rows are set."""
    return a.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def set_indices(a: DataFrame) -> DataFrame:
    """``row``: the rows that are set."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    return a.select("word", F.explode(on).alias("k")).select((F.col("word") * 64 + F.col("k")).alias("row"))


def bit_sliced_index(df: DataFrame, row: str, c: str, bits: int = 64) -> DataFrame:
    """``bit, word, bits``: for each bit of a column of longs (bit -1: not null), the bitmap of the rows that have it."""
    has = F.filter(F.sequence(F.lit(-1), F.lit(bits - 1)), lambda b: (b < 0) | (F.getbit(F.col(c).cast("long"), F.greatest(b, F.lit(0))) == 1))
    rows = df.where(F.col(c).isNotNull()).select(F.col(row).alias("_row"), F.explode(has).alias("bit"))
    return rows.groupBy("bit", F.expr(_WORD.format("_row")).alias("word")).agg(F.bit_or(F.expr(_BIT.format("_row"))).alias("bits"))


def find_equal(index: DataFrame, value: int, bits: int = 64) -> DataFrame:
    """The bitmap of the rows whose value is this one: every slice, or its complement, in one aggregate."""
    wanted = [b for b in range(bits) if value >> b & 1]
    all_ones = F.lit(-1).cast("long")
    has = F.bit_and(F.when(F.col("bit").isin(-1, *wanted), F.col("bits")).otherwise(all_ones))
    others = F.bit_or(F.when(~F.col("bit").isin(-1, *wanted), F.col("bits")).otherwise(F.lit(0).cast("long")))
    count = F.count_if(F.col("bit").isin(-1, *wanted))
    found = index.groupBy("word").agg(has.alias("has"), others.alias("others"), count.alias("n")).where(F.col("n") == len(wanted) + 1)
    return found.select("word", F.col("has").bitwiseAND(F.bitwise_not("others")).alias("bits")).where("bits <> 0")


def zones(df: DataFrame, row: str, columns: list[str], size: int = 1024) -> DataFrame:
    """``zone, rows`` and the least and greatest value of each column, per ``size`` rows numbered by ``row``."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.expr(f"CAST(floor({row} / {size}) AS LONG)").alias("zone")).agg(F.count("*").alias("rows"), *ends)


def zones_with(zone_map: DataFrame, c: str, low, high) -> DataFrame:
    """The zones that may hold a value from ``low`` to ``high``."""
    return zone_map.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))


def reduced(left: DataFrame, right: DataFrame, key: str, longs: int = 1 << 14) -> DataFrame:
    """The rows of ``left`` whose key may be in ``right``, by a Bloom filter of a fixed number of longs (128 KB): what it drops matches
    nothing. The filter is one row, so its broadcast is bounded whatever the tables' sizes."""
    places = [F.pmod(F.xxhash64(F.lit(k), key), F.lit(longs * 64)) for k in range(2)]
    bits = right.where(F.col(key).isNotNull()).select(F.explode(F.array(*places)).alias("at"))
    words = bits.groupBy(F.expr("CAST(at div 64 AS INT)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))
    every = left.sparkSession.range(longs).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    # At most ``longs`` entries in one row.
    filled = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("_filter"))
    inside = [F.getbit(F.get("_filter", F.expr(f"CAST(pmod(xxhash64({k}, `{key}`), {longs * 64}) div 64 AS INT)")), F.expr(f"CAST(pmod(xxhash64({k}, `{key}`), {longs * 64}) % 64 AS INT)")) == 1 for k in range(2)]
    return left.join(F.broadcast(filled)).where(reduce(Column.__and__, inside)).drop("_filter")


def should_use_index(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """``column, use_index``: whether a column has so many distinct values per row that an index pays."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(F.col(c), F.col("_rows")) > least, F.lit(False)).alias("use_index")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")

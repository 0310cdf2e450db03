"""Hamming and cosine similarity, hyperplane LSH, and bit-sliced and zone statistics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column | int) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(F.lit(b) if isinstance(b, int) else b))


def within_hamming(df: DataFrame, c: str, value: int, most: int) -> DataFrame:
    return df.where(hamming(F.col(c).cast("long"), value) <= most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hyperplanes(dim: int, tables: int, bits: int, seed: int = 42) -> list[list[list[float]]]:
    rnd = random.Random(seed)
    return [[[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(bits)] for _ in range(tables)]


def signatures(df: DataFrame, vector: str, dim: int, tables: int = 10, bits: int = 12, seed: int = 42) -> DataFrame:
    """``df`` with a row per hash table: ``lsh_table`` and ``lsh_signature``, the sides of its hyperplanes."""
    out = []
    for t, planes in enumerate(hyperplanes(dim, tables, bits, seed)):
        sign = F.lit(0)
        for k, plane in enumerate(planes):
            side = dot(F.col(vector), F.array(*map(F.lit, plane))) >= 0
            sign = sign + F.when(side, 1 << k).otherwise(0)
        out.append(F.struct(F.lit(t).alias("lsh_table"), sign.alias("lsh_signature")))
    return df.select("*", F.explode(F.array(*out)).alias("_s")).select(*df.columns, "_s.lsh_table", "_s.lsh_signature")


def lsh_lookup(df: DataFrame, vector: str, queries: DataFrame, query_vector: str, dim: int, tables: int = 10, bits: int = 12, seed: int = 42) -> DataFrame:
    """Each row of ``queries`` with the rows of ``df`` that share a bucket with it in some table, once, and their cosine as ``score``.

    The columns of the two must differ. Buckets are joined by a plain shuffle, so AQE splits a full one."""
    asked = signatures(queries, query_vector, dim, tables, bits, seed)
    pairs = signatures(df, vector, dim, tables, bits, seed).join(asked, ["lsh_table", "lsh_signature"]).drop("lsh_table", "lsh_signature").distinct()
    return pairs.withColumn("score", cosine(F.col(vector), F.col(query_vector)))


def bit_slices(df: DataFrame, c: str, bits: int = 64) -> DataFrame:
    """``bit, n``: rows that have each bit of an integer column set."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.struct(b.alias("bit"), F.getbit(F.col(c).cast("long"), b).alias("on")))
    return df.select(F.explode(slices).alias("s")).groupBy("s.bit").agg(F.sum("s.on").cast("long").alias("n"))


def zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value per partition, as Parquet keeps them per row group."""
    return df.groupBy(F.spark_partition_id().alias("zone")).agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def column_kind(df: DataFrame, c: str) -> str:
    """The type that describes a text column's values in the fewest bits: null, boolean, int, double or text. One aggregate."""
    text = F.col(c).cast("string")
    is_bool = F.lower(text).isin("true", "false")
    n, ints, doubles, bools, length = df.agg(F.count(c), F.count(text.try_cast("int")), F.count(text.try_cast("double")), F.count_if(is_bool), F.sum(F.length(text))).first()
    if not n:
        return "null"
    # Bits for values of the type, and for those that need an exception as text.
    chars = 8 * (length or 0) / n
    cost = {"boolean": bools + (n - bools) * (chars + 64), "int": 32 * ints + (n - ints) * (chars + 64), "double": 64 * doubles + (n - doubles) * (chars + 64), "text": n * (chars + 32)}
    return min(cost, key=cost.get)

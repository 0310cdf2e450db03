"""Event-time windows, alike over streams and tables. On a stream the watermark bounds the state and drops rows that come too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, lateness: str) -> DataFrame:
    """Streams need a time with zone for their watermark; tables keep theirs."""
    if not df.isStreaming:
        return df
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def _bounds(df: DataFrame, *columns: str) -> DataFrame:
    bound = lambda k: F.col(f"window.{k}").cast("timestamp_ntz").alias(f"window_{k}")
    return df.select(bound("start"), bound("end"), *columns)


def tumbling(df: DataFrame, time: str, size: str, by: list[str], *aggregates: Column, lateness: str = "10 minutes") -> DataFrame:
    return sliding(df, time, size, size, by, *aggregates, lateness=lateness)


def sliding(df: DataFrame, time: str, size: str, step: str, by: list[str], *aggregates: Column, lateness: str = "10 minutes") -> DataFrame:
    """``window_start, window_end``, keys and aggregates; windows of ``size`` begin every ``step``."""
    out = _late(df, time, lateness).groupBy(F.window(time, size, step).alias("window"), *by).agg(*aggregates)
    return _bounds(out, *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], *aggregates: Column, lateness: str = "10 minutes") -> DataFrame:
    """Windows that end ``gap`` after their last row."""
    out = _late(df, time, lateness).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggregates)
    return _bounds(out, *[c for c in out.columns if c != "window"])


def first_of_key(df: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """One row per key: on a stream within the watermark, in a table the earliest."""
    if df.isStreaming:
        return _late(df, time, lateness).dropDuplicatesWithinWatermark(keys)
    others = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.struct(time, *[c for c in others if c != time])).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])

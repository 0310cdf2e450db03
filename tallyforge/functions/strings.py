"""String functions with defined edges: starts below 1 count as 1, lengths of 0 or less give the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(s: Column, start: int | Column, length: int | Column | None = None) -> Column:
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    if length is None:
        return F.substr(s, start)
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(length <= 0, F.when(s.isNotNull(), "")).otherwise(F.substr(s, start, length))


def char_length(s: Column) -> Column:
    return F.char_length(s).cast("long")


def trim(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def position(s: Column, part: Column | str) -> Column:
    """Place of the first occurrence, from 1; 0 where there is none; 1 for the empty string."""
    return F.position(F.lit(part) if isinstance(part, str) else part, s).cast("long")


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(max(n, 0)))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(max(n, 0)))


def replace(s: Column, needle: str, by: str) -> Column:
    """An empty needle leaves the string as it is."""
    return F.replace(s, F.lit(needle), F.lit(by)) if needle else s


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE with % and _ and an escape character."""
    return F.like(s, F.lit(pattern), F.lit(escape))


def count_containing(s: Column, part: str) -> Column:
    """Aggregate: rows that contain ``part``."""
    return F.count_if(F.contains(s, F.lit(part)))


def count_starting(s: Column, part: str) -> Column:
    """Aggregate: rows that start with ``part``."""
    return F.count_if(F.startswith(s, F.lit(part)))

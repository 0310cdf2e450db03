"""Casts that give null where they fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for truth and falsehood.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")


def to_long(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("long")


def to_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def iif(condition: Column, yes, no) -> Column:
    """``no`` where the condition is false or null."""
    return F.when(condition, yes).otherwise(no)


def safe_divide(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_divide(a, b)

"""Date and time parts, truncation and intervals on zone-less timestamps and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short names of date parts.
ABBREVIATIONS = {"y": "year", "yr": "year", "mon": "month", "d": "day", "h": "hour", "hr": "hour", "min": "minute", "m": "minute", "s": "second", "sec": "second", "ms": "millisecond", "us": "microsecond", "w": "week", "q": "quarter"}


def _micros(c: Column) -> Column:
    """Microseconds within the second."""
    return F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))


_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "hour": lambda c: F.hour(c.cast("timestamp")),
    "minute": lambda c: F.minute(c.cast("timestamp")),
    "second": lambda c: F.second(c.cast("timestamp")),
    "millisecond": lambda c: F.floor(_micros(c) / 1000),
    "microsecond": _micros,
    "dow": lambda c: F.dayofweek(c) - 1,
    "isodow": lambda c: F.weekday(c) + 1,
    "doy": F.dayofyear,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "epoch": lambda c: F.unix_seconds(c.cast("timestamp")),
    "decade": lambda c: F.floor(F.year(c) / 10),
    "century": lambda c: F.floor((F.year(c) - 1) / 100) + 1,
    "millennium": lambda c: F.floor((F.year(c) - 1) / 1000) + 1,
}


def part(c: Column, name: str) -> Column:
    """A date part as BIGINT, by its name or a short one. dow counts from Sunday, 0; isodow from Monday, 1; weeks are ISO's."""
    key = ABBREVIATIONS.get(name.lower(), name.lower())
    if key not in _PARTS:
        raise ValueError(f"unknown date part {name!r}")
    return _PARTS[key](c).cast("long")


def truncate(c: Column, unit: str) -> Column:
    """The timestamp at the start of its year, quarter, month, week, day, hour, minute or second, without zone."""
    return F.date_trunc(ABBREVIATIONS.get(unit, unit), c).cast("timestamp_ntz")


def add_months(c: Column, n: int) -> Column:
    """A date ``n`` months later, at most the month's last day."""
    return F.add_months(c, n)


def add_interval(c: Column, n: int, unit: str) -> Column:
    """``c`` plus n units (year to microsecond)."""
    unit = ABBREVIATIONS.get(unit.rstrip("s"), unit.rstrip("s"))
    if unit in ("year", "quarter", "month"):
        return c + F.make_ym_interval(F.lit(0), F.lit(n * {"year": 12, "quarter": 3, "month": 1}[unit]))
    days = {"week": 7, "day": 1}.get(unit)
    if days:
        return c + F.make_dt_interval(days=F.lit(n * days))
    seconds = {"hour": 3600, "minute": 60, "second": 1, "millisecond": 0.001, "microsecond": 0.000001}[unit]
    return c + F.make_dt_interval(secs=F.lit(n * seconds).cast("decimal(18,6)"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier).cast("long")


def make_date(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """A time of day as text, HH:MM:SS and the microseconds without their last zeros: Spark's TIME needs a switch of the session. Null if a part is
    null, an error beyond 0-23, 0-59 and 0-59.999999."""
    below = F.when(second >= 60, F.raise_error(F.lit("seconds must be below 60"))).otherwise(second)
    at = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), hour, minute, below)
    return F.substring(at.cast("string"), 12, 15)


def parse_date(text: Column) -> Column:
    """A date from yyyy-mm-dd, or null."""
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """A zone-less timestamp from date and time parted by blank or T, or null."""
    return text.try_cast("timestamp_ntz")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

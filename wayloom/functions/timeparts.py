"""Parts of days, weeks and months as column expressions; times are seconds since 1970, wall clock UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
PARTS = ("morning", "afternoon", "evening", "night")


def epoch(ts) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    ts = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1.0e6D")


def second_of_day(t: Column) -> Column:
    return t - F.floor(t / DAY) * DAY


def part_of_day(t: Column) -> Column:
    """0 morning from 6, 1 afternoon from 12, 2 evening from 18, 3 night from 22; each starts with its hour."""
    h = second_of_day(t) / 3600
    return F.when((h >= 6) & (h < 12), 0).when((h >= 12) & (h < 18), 1).when((h >= 18) & (h < 22), 2).otherwise(3)


def slot_of_day(t: Column) -> Column:
    """Slots that end with their hour: (6,9], (9,18], (18,21], and the rest."""
    s = second_of_day(t)
    between = lambda a, b: (s > a * 3600) & (s <= b * 3600)
    return F.when(between(6, 9), "06-09").when(between(9, 18), "09-18").when(between(18, 21), "18-21").otherwise("21-06")


def is_weekend(t: Column) -> Column:
    """1970-01-01 was a Thursday."""
    return F.pmod(F.floor(t / DAY) + 3, F.lit(7)) >= 5


def month_index(ts) -> Column:
    """Months since year 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_pairs(month: Column) -> Column:
    """The two-month windows that a month of a year lies in, by first month; January and December lie in one."""
    return F.filter(F.array(month - 1, month), lambda m: (m >= 1) & (m <= 11))

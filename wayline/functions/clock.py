"""Service-day seconds, clock texts, dates and holidays. Seconds count from midnight and may pass 86,400."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def half_up(x: Column) -> Column:
    """floor(x + 0.5) as a long: halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def micro(x: Column) -> Column:
    """Rounded to six decimals, halves up, so that engines agree on the result."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def seconds_of(text: Column) -> Column:
    """Seconds of ``H:MM:SS`` or ``H:MM``; parts that are no numbers count as 0, null stays null."""
    part = lambda i: F.coalesce(F.get(F.split(text, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    return part(0) * 3600 + part(1) * 60 + part(2)


def clock_text(seconds: Column) -> Column:
    """HH:MM within the day; times before or after it wrap around."""
    s = F.pmod(seconds, F.lit(DAY))
    pad = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(pad(s / 3600), F.lit(":"), pad((s % 3600) / 60))


def parse_clock(text: Column, most_hours: int = 47) -> Column:
    """Seconds of a well-formed H:MM[:SS] with hours up to ``most_hours``; else null."""
    m = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2}):([0-5]\d)(?::([0-5]\d))?\s*$", i)
    sec = m(1).try_cast("int") * 3600 + m(2).try_cast("int") * 60 + F.coalesce(m(3).try_cast("int"), F.lit(0))
    return F.when(m(1).try_cast("int") <= most_hours, sec)


def wrapped_difference(actual: Column, planned: Column) -> Column:
    """actual - planned around the clock: from -43,200 to 43,199 seconds."""
    return F.pmod(F.pmod(actual - planned, F.lit(DAY)) + DAY + DAY // 2, F.lit(DAY)) - DAY // 2


def local_time(ts: Column, zone: str = "Europe/Warsaw") -> Column:
    return F.from_utc_timestamp(ts, zone)


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1


def easter(year: Column) -> Column:
    """Easter Sunday of a year (Gregorian), by whole-number steps only."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, F.lit(100)), year % 100
    h = (19 * a + b - div(b, F.lit(4)) - div(b - div(b + 8, F.lit(25)) + 1, F.lit(3)) + 15) % 30
    w = (32 + 2 * (b % 4) + 2 * div(c, F.lit(4)) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * w, F.lit(451))
    n = h + w - 7 * m + 114
    return F.make_date(year.cast("int"), div(n, F.lit(31)).cast("int"), (n % 31 + 1).cast("int"))


#: Polish holidays of fixed date (month-day).
HOLIDAYS = ["01-01", "01-06", "05-01", "05-03", "08-15", "11-01", "11-11", "12-25", "12-26"]
#: Days after Easter Sunday that are holidays too (Sunday, Monday, Whit Sunday, Corpus Christi).
AFTER_EASTER = [0, 1, 49, 60]


def is_holiday(day: Column) -> Column:
    fixed = F.date_format(day, "MM-dd").isin(HOLIDAYS)
    return fixed | F.datediff(day, easter(F.year(day))).isin(AFTER_EASTER)

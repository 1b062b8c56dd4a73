"""Which services run on which days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.clock import is_holiday

#: Columns of the calendar's day flags, from Sunday on.
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


def _flag(day):
    w, out = F.dayofweek(day) - 1, F.lit(0)
    for i, name in enumerate(DAYS):
        out = F.when(w == i, F.col(name)).otherwise(out)
    return out


def runs_on(date: str):
    """Predicate: the weekday's flag is set and the YYYYMMDD date is within the bounds, of which empty ones are open."""
    day = F.to_date(F.lit(date), "yyyyMMdd")
    bound = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (_flag(day) > 0) & ((bound("start_date") == "") | (bound("start_date") <= date)) & ((bound("end_date") == "") | (bound("end_date") >= date))


def active_services(calendar: DataFrame, dates: DataFrame, date: str, everything: DataFrame | None = None) -> DataFrame:
    """(service): those of the weekday and those added, less those removed (exc 1 and 2).

    ``everything``: services to fall back on, used only when both tables are empty, as one join on an empty test.
    """
    added = dates.where((F.col("date") == date) & (F.col("exc") == 1)).select("service")
    removed = dates.where((F.col("date") == date) & (F.col("exc") == 2)).select("service")
    out = calendar.where(runs_on(date)).select("service").union(added).distinct().join(removed, "service", "left_anti")
    if everything is None:
        return out
    known = calendar.select(F.lit(1).alias("x")).limit(1).union(dates.select(F.lit(1).alias("x")).limit(1)).agg(F.count("*").alias("known"))
    rest = everything.select("service").distinct().crossJoin(F.broadcast(known)).where("known = 0").select("service")
    return out.union(rest)


def expanded(calendar: DataFrame, dates: DataFrame, default: tuple[str, str]) -> DataFrame:
    """(service, day): every day of each service. Open bounds take the default's; days of one service are bounded by its dates."""
    bound = lambda c, d: F.to_date(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)), "yyyyMMdd")
    rows = calendar.select("service", *DAYS, bound("start_date", default[0]).alias("a"), bound("end_date", default[1]).alias("b")).where("a <= b")
    days = rows.select("service", *DAYS, F.explode(F.sequence("a", "b")).alias("day")).where(_flag(F.col("day")) > 0).select("service", "day")
    extra = dates.select("service", F.to_date("date", "yyyyMMdd").alias("day"), "exc")
    return days.union(extra.where("exc = 1").select("service", "day")).distinct().join(extra.where("exc = 2"), ["service", "day"], "left_anti")


def services_by_days(days: DataFrame) -> DataFrame:
    """(key, services): services that run on exactly the same days are one group; key is a hash of the days."""
    sets = days.groupBy("service").agg(F.sha1(F.array_join(F.array_sort(F.collect_set(F.date_format("day", "yyyyMMdd"))), ",")).alias("key"))
    return sets.groupBy("key").agg(F.array_sort(F.collect_set("service")).alias("services"))


def weekday_masks(days: DataFrame) -> DataFrame:
    """(service, mask, holidays): bit k of the mask is set if the service ran on weekday k (0: Sunday) that was no holiday; and on how many holidays it ran."""
    plain = ~is_holiday(F.col("day"))
    weekday = F.dayofweek("day") - 1
    mask = sum((F.max(F.when(plain & (weekday == i), 1 << i).otherwise(0)) for i in range(7)), F.lit(0))
    return days.groupBy("service").agg(mask.cast("long").alias("mask"), F.count_if(~plain).alias("holidays"))

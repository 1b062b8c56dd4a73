"""Trips, stop sequences and departures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trip_rows(stop_times: DataFrame) -> DataFrame:
    """(trip, route, service, stops, arrs, deps): each trip's calls in order, in one shuffle. A trip's calls are few by nature."""
    calls = F.array_sort(F.collect_list(F.struct("seq", "stop", "arr", "dep")))
    rows = stop_times.groupBy("trip", "route", "service").agg(calls.alias("c"))
    return rows.select("trip", "route", "service", F.col("c.stop").alias("stops"), F.col("c.arr").alias("arrs"), F.col("c.dep").alias("deps"))


def pattern_key(stops: Column) -> Column:
    """A stop sequence as text."""
    return F.array_join(F.transform(stops, lambda s: s.cast("string")), ">")


def patterns(trips: DataFrame) -> DataFrame:
    """(route, pattern, stops, n_trips, first_dep, last_dep): trips of a route with the same stops. The key is hashed in the shuffle, counts combine before it."""
    return trips.groupBy("route", "stops").agg(F.count("*").alias("n_trips"), F.min(F.get("deps", F.lit(0))).alias("first_dep"), F.max(F.get("deps", F.lit(0))).alias("last_dep")).select("route", pattern_key(F.col("stops")).alias("pattern"), F.size("stops").cast("long").alias("n_stops"), "n_trips", "first_dep", "last_dep")


def signature(*columns: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the values, joined."""
    return F.substring(F.sha1(F.concat_ws("|", *columns)), 1, 16)


def merged_variants(trips: DataFrame) -> DataFrame:
    """(base, variant, signature, days): trips of one base id. Equal content is one variant with all its days; others are numbered by first day."""
    same = trips.groupBy("base", "signature").agg(F.array_sort(F.collect_set("day")).alias("days"))
    number = F.row_number().over(Window.partitionBy("base").orderBy(F.get("days", F.lit(0)), "signature"))
    return same.withColumn("variant", number)


def departures_by_hour(stop_times: DataFrame) -> DataFrame:
    """(stop, hour, minutes): distinct minutes of departures for each stop and hour of the service day; hours may pass 24."""
    return stop_times.select("stop", F.floor(F.col("dep") / 3600).alias("hour"), F.floor(F.col("dep") % 3600 / 60).alias("m")).groupBy("stop", "hour").agg(F.array_sort(F.collect_set("m")).alias("minutes"))


def representative_trips(trips: DataFrame) -> DataFrame:
    """(route, trip, n): of each route the least trip id of its commonest stop sequence (ties: the shorter key text first in order)."""
    counted = trips.groupBy("route", pattern_key(F.col("stops")).alias("pattern")).agg(F.count("*").alias("n"), F.min("trip").alias("trip"))
    return counted.groupBy("route").agg(F.min(F.struct((-F.col("n")).alias("less"), "pattern", "trip")).alias("x")).select("route", "x.trip", (-F.col("x.less")).alias("n"))


def by_frequency(templates: DataFrame) -> DataFrame:
    """Trips of templates (trip, start, end, headway, deps): one every headway from start to end, both included; deps are shifted to begin there."""
    at = templates.where("headway > 0 and start <= end").select("*", F.explode(F.sequence("start", "end", "headway")).alias("at"))
    first = F.get("deps", F.lit(0))
    return at.select("trip", "at", F.transform("deps", lambda d: d - first + F.col("at")).alias("deps"))


def past_midnight(calls: DataFrame, key: str, order: str, sec: str) -> DataFrame:
    """Adds ``day_sec``: clock times of a run, where each step back in time is a new day."""
    w = Window.partitionBy(key).orderBy(order)
    back = F.when(F.col(sec) < F.lag(sec).over(w), 1).otherwise(0)
    return calls.withColumn("__back", back).withColumn("day_sec", F.col(sec) + F.sum("__back").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 86_400).drop("__back")


def fifo_groups(trips: DataFrame, boarding: bool = False) -> DataFrame:
    """(route, pattern, trip, chain): trips of a pattern in chains in which none overtakes another, each put to the first chain that it fits.

    In order of first departure, then trip; greedy, so the trips of one pattern on one service are read in order by one task, in batches; what is held is the
    last departures of each chain only. ``boarding``: trips of a chain also arrive (``arrs``) in its order, and leave no stop at the same time unless all their times are equal, so that the
    least departure names the one to board.
    """
    group = ["route", "service", "pattern"]

    def fits(one: np.ndarray, two: np.ndarray) -> bool:
        n = len(one) // 2
        return bool((one <= two).all() and (not boarding or (one[:n] < two[:n]).all() or (one == two).all()))

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, []
        for pdf in batches:
            out = []
            for key, deps in zip(pdf[group].itertuples(index=False, name=None), pdf["deps"], strict=True):
                if key != now:
                    now, last = key, []
                deps = np.asarray(deps)
                k = next((i for i, d in enumerate(last) if fits(d, deps)), len(last))
                last[k : k + 1] = [deps]
                out.append(k)
            yield pdf[[*group, "trip"]].assign(chain=out)

    rows = trips.select("route", "service", pattern_key(F.col("stops")).alias("pattern"), "trip", (F.concat("deps", "arrs") if boarding else F.col("deps")).alias("deps"), F.get("deps", F.lit(0)).alias("first"))
    return rows.repartition(*group).sortWithinPartitions(*group, "first", "trip").mapInPandas(chains, "route long, service long, pattern string, trip long, chain long")


def chained(stop_times: DataFrame) -> DataFrame:
    """Calls whose ``route`` names a chain: trips of one route, service and stop sequence of which none overtakes another, neither in leaving nor in arriving.

    In a chain the next departure is the best one to board, whatever overtakes on the line as a whole; so searches ask each chain, of which a line has as many as trips pass one another at once.
    """
    rows = trip_rows(stop_times)
    chain = fifo_groups(rows, boarding=True).select("trip", F.concat_ws(":", "route", "service", "pattern", "chain").alias("__line"))
    return stop_times.join(chain, "trip").withColumn("route", F.col("__line")).drop("__line")


def spaced(rows: DataFrame, key: list[str], order: list[str], at: str, most: int, apart: int) -> DataFrame:
    """Of each key's rows in the given order those kept greedily: at most ``most``, any two ``apart`` seconds apart.

    The rows of a key are read in order, in batches; what is held is the ``most`` kept times only, so a hot key costs time but no memory.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for pdf in batches:
            take = []
            for k, t in zip(pdf[key].itertuples(index=False, name=None), pdf[at].tolist(), strict=True):
                if k != now:
                    now, kept = k, []
                ok = len(kept) < most and all(abs(t - x) >= apart for x in kept)
                if ok:
                    kept.append(t)
                take.append(ok)
            yield pdf[take]

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(keep, rows.schema)

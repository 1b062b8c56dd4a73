"""Vehicles against the timetable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.spatial import near_places
from wayline.operators.tables import tasks


def schedule_matches(vehicles: DataFrame, stop_times: DataFrame, stops: DataFrame, metres: float = 350.0, early: int = 300, late: int = 5400) -> DataFrame:
    """(vehicle, trip, score, delay, metres): every trip of the vehicle's route that calls within ``metres`` of it, from ``early`` seconds before to ``late`` after its time.

    First the stops near each place of vehicles, by a grid, and of these only those at which the route calls; then their calls, by route, stop and quarter hour: a vehicle meets only calls that may fit.
    The score is |delay| + 2 metres, small is good; of a trip's calls the best counts.
    """
    a = vehicles.select("vehicle", "route", "sec", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stops.select("stop", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    lines = stop_times.select("route", "stop").distinct()
    b = b.join(lines.select("stop").distinct(), "stop", "left_semi")
    spots = near_places(a, b, metres, "right").join(b, ["b_lat", "b_lon"]).join(lines, "stop").select("route", "a_lat", "a_lon", "stop", F.floor(F.col("metres") + 0.5).alias("metres"))
    near = a.join(spots, ["route", "a_lat", "a_lon"]).select("vehicle", "route", "sec", "stop", "metres")
    asked = near.select("*", F.explode(F.sequence(F.floor((F.col("sec") - late) / 900), F.floor((F.col("sec") + early) / 900))).alias("slot"))
    calls = stop_times.select("route", "stop", "trip", "dep", F.floor(F.col("dep") / 900).alias("slot"))
    met = asked.repartition(tasks(vehicles.sparkSession), "route", "stop", "slot").join(calls, ["route", "stop", "slot"]).withColumn("delay", F.col("sec") - F.col("dep")).where(F.col("delay").between(-early, late))
    met = met.withColumn("score", F.abs("delay") + 2 * F.col("metres"))
    return met.groupBy("vehicle", "trip").agg(F.min(F.struct("score", "delay", "metres")).alias("x")).select("vehicle", "trip", "x.score", "x.delay", "x.metres")


def one_to_one(matches: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(vehicle, trip, delay): each vehicle's best trip, and of the vehicles that chose one trip the best; the others keep their row with nulls.

    Two aggregates of least structs: no window over a hot trip.
    """
    own = matches.groupBy("vehicle").agg(F.min(F.struct("score", "trip", "delay")).alias("x")).select("vehicle", "x.*")
    winner = own.groupBy("trip").agg(F.min(F.struct("score", "vehicle", "delay")).alias("x")).select("trip", "x.vehicle", "x.delay")
    return vehicles.select("vehicle").join(winner, "vehicle", "left").select("vehicle", "trip", "delay")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, at: str, other: str, most: int) -> DataFrame:
    """``left`` rows with the ``right`` row of the same key nearest in circular time of day, at most ``most`` seconds off; ties: the least other columns in their order. Repeated rows each keep theirs.

    Times ask, not rows: of a key's rows at one time of day the least stands for all. They are dealt to slots of ``most`` seconds; within a slot one window carries the last time before each one that asks and the first after it, and the
    slots around get a slot's first and last time only, also across midnight. So no pairs are made, and a window holds the times of one key and slot.
    """
    slots = -(-86_400 // most)
    clock = lambda c: F.pmod(F.col(c), F.lit(86_400))
    rest = [c for c in right.columns if c != key]
    slot = F.floor(F.col("__t") / most)
    b = right.groupBy(key, clock(other).alias("__t")).agg(F.min(F.struct(*rest)).alias("__b")).withColumn("__slot", slot)
    ends = b.groupBy(key, "__slot").agg(F.min(F.struct("__t", "__b")).alias("lo"), F.max(F.struct("__t", "__b")).alias("hi"))
    sent = [ends.select(key, (F.col("__slot") + i).alias("__to"), f"{end}.*") for i in (-2, -1, 1, 2) for end in ("lo", "hi")]
    turn = F.floor(F.col("__to") / slots)
    told = b.select(key, "__slot", "__t", "__b")
    for x in sent:
        told = told.unionByName(x.select(key, (F.col("__to") - turn * slots).alias("__slot"), (F.col("__t") - turn * 86_400).alias("__t"), "__b"))
    asked = left.select(key, clock(at).alias("__t")).distinct().select(key, slot.alias("__slot"), "__t", F.lit(None).cast(b.schema["__b"].dataType).alias("__b"))
    w = Window.partitionBy(key, "__slot").orderBy("__t")
    x = F.when(F.col("__b").isNotNull(), F.struct("__t", "__b"))
    around = told.unionByName(asked).select(key, "__t", F.col("__b").isNull().alias("__asks"), F.max(x).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("lo"), F.min(x).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("hi")).where("__asks")
    far = lambda c: F.abs(F.pmod(F.col("__t") - F.col(f"{c}.__b.{other}") + 43_200, F.lit(86_400)) - 43_200)
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(far(c).alias("gap"), F.col(f"{c}.__b").alias("b")))
    found = around.select(key, "__t", F.least(one("lo"), one("hi")).alias("x")).where(F.col("x.gap") <= most)
    out = left.withColumn("__t", clock(at)).join(found, [key, "__t"])
    return out.select(*left.columns, "x.gap", *[f"x.b.{c}" for c in rest])


def peer_delays(waiting: DataFrame, samples: DataFrame, span: int = 2700, share: float = 0.8, least: int = 120, needed: int = 2) -> DataFrame:
    """(trip, estimate, n): a trip's delay from others of its route within ``span`` seconds: ``share`` of their median, if that is at least ``least`` and there are ``needed``.

    Samples of one second and delay are counted first and trips that wait alike ask once, so the work is bounded by the seconds of a route, not by its samples.
    """
    slot = F.floor(F.col("at") / span)
    asked = waiting.select("route", "at").distinct().select("route", "at", F.explode(F.sequence(slot - 1, slot + 1)).alias("slot"))
    heard = samples.groupBy("route", F.col("at").alias("s_at"), "delay").agg(F.count("*").alias("k")).withColumn("slot", F.floor(F.col("s_at") / span))
    met = asked.join(heard, ["route", "slot"]).where(F.abs(F.col("at") - F.col("s_at")) <= span)
    out = met.groupBy("route", "at").agg(F.percentile("delay", F.lit(0.5), F.col("k")).alias("m"), F.sum("k").alias("n")).where(F.col("n") >= needed)
    told = out.select("route", "at", F.floor(F.col("m") * share + 0.5).cast("long").alias("estimate"), "n").where(F.abs("estimate") >= least)
    return waiting.select("trip", "route", "at").join(told, ["route", "at"]).select("trip", "estimate", "n")


def smoothed(samples: DataFrame, key: str, at: str, value: str, span: float = 15.0, also: list[str] | None = None) -> DataFrame:
    """Adds ``smooth``: exponential smoothing in time, with weight 1 - exp(-gap / span) for each new sample. One ordered pass; a key's state is two numbers. Samples of one time follow one another by ``also``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, s = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for k, t, v in zip(pdf[key], pdf[at].astype(float), pdf[value].astype(float), strict=True):
                s = v if k != now else s + (1 - np.exp(-(t - last) / span)) * (v - s)
                now, last = k, t
                out.append(s)
            yield pdf.assign(smooth=np.array(out, float))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", smooth double"
    return samples.repartition(key).sortWithinPartitions(key, at, *(also or [])).mapInPandas(run, schema)


def fresh(samples: DataFrame, at: str, now: int, behind: int = 120, ahead: int = 15) -> DataFrame:
    """Samples no older than ``behind`` and no more than ``ahead`` seconds early; early ones count as taken now."""
    return samples.where(F.col(at).between(now - behind, now + ahead)).withColumn(at, F.least(F.col(at), F.lit(now)))


def with_previous(matches: DataFrame, previous: DataFrame, bonus: int = 240) -> DataFrame:
    """Matches (vehicle, trip, score, ...) whose score is less by ``bonus`` where the vehicle had that trip (vehicle, trip) before."""
    had = previous.select("vehicle", "trip", F.lit(bonus).alias("__less"))
    return matches.join(had, ["vehicle", "trip"], "left").withColumn("score", F.col("score") - F.coalesce("__less", F.lit(0))).drop("__less")


def best_window(profile, deps):
    """struct(error, start): where a run of seconds between stops fits best into a trip's departures, by the sum of absolute differences from the first of each; null if the trip is shorter."""
    m = F.size(profile)

    def error(i):
        own = F.slice(deps, i + 1, m)
        return F.struct(F.aggregate(F.zip_with(own, profile, lambda d, p: F.abs((d - F.get(own, F.lit(0))) - (p - F.get(profile, F.lit(0))))), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("error"), i.alias("start"))

    starts = F.sequence(F.lit(0), F.size(deps) - m)
    return F.when((m > 0) & (F.size(deps) >= m), F.array_min(F.transform(F.when(F.size(deps) >= m, starts), error)))

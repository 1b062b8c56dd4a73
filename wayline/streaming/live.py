"""Streams with state that ends: the live table of vehicles, rides under way, updates that are kept for a while.

State is kept by ``transformWithState``; the session's state store must be the RocksDB one (``state_store``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.sinks import versions

#: Of a poll's row: what the live table keeps beside feed and vehicle.
ROW = "poll long, ms long, lat double, lon double, delay double"
CHANGE = f"feed string, vehicle string, {ROW}, kind string"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Vehicles(StatefulProcessor):
    """The vehicles of one part of a feed: rows by vehicle, and the last poll that has ended."""

    def __init__(self, stale: float, step: float):
        self.stale, self.step = int(stale * 1000), int(step * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "vehicle string", ROW)
        self.ended = handle.getValueState("ended", "poll long")

    def _keep(self, vehicle: str, row: tuple) -> None:
        self.rows.updateValue((vehicle,), row)
        self.handle.registerTimer(-(-(row[1] + self.stale) // self.step) * self.step)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self._keep(r.vehicle, (int(r.poll), int(r.ms), r.lat, r.lon, r.delay))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended = self.ended.get()[0] if self.ended.exists() else -1
        pdf = pd.concat(list(rows)).sort_values(["poll", "vehicle", "ms"], na_position="last")
        out = []
        for poll, part in pdf.groupby("poll", sort=True):
            for r in part.itertuples(index=False):
                if poll <= ended:
                    continue  # the poll is over: what comes late was gone or is newer already
                if r.vehicle is not None:
                    row = (int(poll), int(r.ms), r.lat, r.lon, r.delay)
                    self._keep(r.vehicle, row)
                    out.append((key[0], r.vehicle, *row, "seen"))
                    continue
                for (vehicle,), row in list(self.rows.iterator()):
                    if row[0] < poll:
                        self.rows.removeKey((vehicle,))
                        out.append((key[0], vehicle, int(poll), *row[1:], "gone"))
                ended = int(poll)
                self.ended.update((ended,))
        yield pd.DataFrame(out, columns=["feed", "vehicle", "poll", "ms", "lat", "lon", "delay", "kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (vehicle,), row in list(self.rows.iterator()):
            if row[1] + self.stale <= now:
                self.rows.removeKey((vehicle,))
                out.append((key[0], vehicle, *row, "expired"))
        yield pd.DataFrame(out, columns=["feed", "vehicle", "poll", "ms", "lat", "lon", "delay", "kind"])

    def close(self) -> None:
        pass


def _parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to parts of their feed; a row without a vehicle, the end of a poll, goes to all of them."""
    own = F.array(F.pmod(F.xxhash64("vehicle"), F.lit(parts)).cast("int"))
    return rows.withColumn("part", F.explode(F.when(F.col("vehicle").isNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(own)))


def live_changes(polls: DataFrame, stale: float = 120.0, late: str = "0 seconds", parts: int = 64, initial: DataFrame | None = None) -> DataFrame:
    """Changes of the live table: each row of a poll (``seen``), vehicles that a poll lacks (``gone``), and those not heard of for ``stale`` seconds of event time (``expired``).

    ``polls``: (feed, poll, vehicle, ts, lat, lon, delay); a row with a null vehicle ends its poll, and vehicles of earlier polls that it lacks go. Rows of a poll that has ended are dropped, null ts too. Poll numbers grow
    within a feed. ``initial``: rows of a restored table (feed, vehicle, poll, ts, lat, lon, delay). A feed's vehicles are dealt to ``parts`` states, so a feed of any size is no hot key; an end mark goes to each.
    """
    rows = polls.select("feed", F.col("poll").cast("long").alias("poll"), "vehicle", "ts", F.unix_millis("ts").alias("ms"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "delay")]).where("ts is not null")
    begin = None if initial is None else _parts(initial.select("feed", "vehicle", "poll", F.unix_millis("ts").alias("ms"), "lat", "lon", "delay"), parts).groupBy("feed", "part")
    out = _parts(rows.withWatermark("ts", late), parts).groupBy("feed", "part").transformWithStateInPandas(_Vehicles(stale, min(stale, 10.0)), CHANGE, "append", "EventTime", begin)
    return out.select("feed", "vehicle", "poll", F.timestamp_millis("ms").alias("ts"), "lat", "lon", "delay", "kind")


def applied(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``table`` (feed, vehicle, poll, ts, lat, lon, delay) after the changes: of a vehicle the last one counts, by poll, what came in before what went."""
    order = F.struct("poll", (F.col("kind") != "seen").alias("ends"), "ts")
    last = changes.groupBy("feed", "vehicle").agg(F.max_by(F.struct("poll", "ts", "lat", "lon", "delay", "kind"), order).alias("x")).select("feed", "vehicle", "x.*")
    return table.join(last, ["feed", "vehicle"], "left_anti").unionByName(last.where("kind = 'seen'").drop("kind"))


def live_into(changes: DataFrame, path: str, checkpoint: str, at: float | None = None, keep: int = 4, trigger: dict | None = None):
    """Keeps the live table as a versioned table: each batch makes a version, and readers keep theirs. A batch that runs again after a failure gives the same rows."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        names = ["feed", "vehicle", "poll", "ts", "lat", "lon", "delay"]
        known = versions.versions(spark, path)
        table = versions.read(spark, path, known[-1].number)[0] if known else batch.select(*names).limit(0)
        batch.persist()
        versions.commit(applied(table, batch).select(*names), path, expect=known[-1].number if known else 0, at=at)
        batch.unpersist()
        versions.clean(spark, path, keep)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def usable_updates(updates: DataFrame, now: Column, fresh: float = 300.0, kept: float = 7_200.0) -> DataFrame:
    """Updates (key, fetched in seconds, ...) that may still be shown, each key's newest, with ``live``: fetched at most ``fresh`` seconds ago. Those over ``kept`` seconds old go; those from the future are not live."""
    age = now - F.col("fetched")
    rest = [c for c in updates.columns if c not in ("key", "fetched")]
    newest = updates.where("fetched is not null").where(age <= kept).groupBy("key").agg(F.max(F.struct("fetched", *rest)).alias("x")).select("key", "x.*")
    return newest.withColumn("live", (age <= fresh) & (age >= 0))


class Fix(NamedTuple):
    """One position: when it was seen and told (seconds), degrees, metres of accuracy, degrees of heading, metres a second; heading and speed may be None."""

    seen: float
    told: float
    lat: float
    lon: float
    accuracy: float
    heading: float | None = None
    speed: float | None = None


class Ride(NamedTuple):
    """What is known of a ride so far: whether it has begun for sure, the furthest place, the last fix that counted with its place, the last three delays."""

    sure: bool = False
    place: float = -1.0
    last: tuple[float, float, float, float] | None = None
    delays: tuple[int, ...] = ()


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _heading(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


#: Fixed values of the estimate: accuracy and age of a fix that counts, reach beside a hop, least hop, speed from which a heading counts and how far it may turn off, slack backwards in hops, span around the expected time, and what makes a ride sure.
ACCURATE, RECENT, BESIDE, HOP, MOVING, ASKEW, BACK, EARLY, LATE = 45.0, 20.0, 65.0, 10.0, 2.2, 65.0, 0.15, 180.0, 3600.0
LEAST_GAP, MOST_GAP, LEAST_MOVE, LEAST_SPEED, MOST_SPEED = 8.0, 60.0, 25.0, 2.0, 50.0


def place_on_trip(ride: Ride, fix: Fix, stops: list[tuple], board: int, base: float) -> tuple[float, float] | None:
    """(place, expected time) of the hop nearest to the fix, among those that the ride can be on: place counts stops, with the share of the hop.

    ``stops``: (lat, lon, arr, dep), seconds after ``base``; a hop with an unknown place or time is none.
    """
    found = []
    for i, (a, b) in enumerate(zip(stops[board:-1], stops[board + 1 :], strict=True), board):
        if i + 1 < ride.place - BACK or None in (a[0], a[1], a[3], b[0], b[1], b[2]) or _metres(*a[:2], *b[:2]) < HOP:
            continue
        wide = math.cos(math.radians(fix.lat)) * 111_320
        ax, ay, dx, dy = (a[1] - fix.lon) * wide, (a[0] - fix.lat) * 111_320, (b[1] - a[1]) * wide, (b[0] - a[0]) * 111_320
        share = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        off = math.hypot(ax + share * dx, ay + share * dy)
        turned = abs((fix.heading - _heading(*a[:2], *b[:2]) + 540) % 360 - 180) if fix.heading is not None else 0.0
        expected = base + a[3] + (b[2] - a[3]) * share
        wrong_way = not ride.sure and (fix.speed or 0) >= MOVING and turned > ASKEW
        if off <= max(BESIDE, 2 * fix.accuracy) and not wrong_way and expected - EARLY <= fix.told <= expected + LATE:
            found.append((off, i + share, expected))
    return min(found, key=lambda x: x[0])[1:] if found else None


def observed(ride: Ride, fix: Fix, stops: list[tuple], board: int, base: float) -> tuple[Ride, tuple[float, int] | None]:
    """The ride after a fix, and (place, delay in seconds) if it tells something: the place never goes back, the delay is the middle of the last three (the later of two).

    A ride is sure once two fixes 8 to 60 seconds apart show it moving on along the trip; before that nothing is told.
    """
    if fix.accuracy is None or not 0 <= fix.accuracy <= ACCURATE or not 0 <= fix.told - fix.seen <= RECENT or not (math.isfinite(fix.lat) and math.isfinite(fix.lon)):
        return ride, None
    at = place_on_trip(ride, fix, stops, board, base)
    if at is None or at[0] < ride.place - BACK:
        return ride, None
    here = (fix.seen, fix.lat, fix.lon, at[0])
    gap = fix.seen - ride.last[0] if ride.last else 0.0
    move = _metres(*ride.last[1:3], fix.lat, fix.lon) if ride.last else 0.0
    if not ride.sure:
        if ride.last is None:
            return ride._replace(last=here), None
        if gap < LEAST_GAP:
            return ride, None
        if gap > MOST_GAP or move < LEAST_MOVE or move / gap < LEAST_SPEED or at[0] <= ride.last[3]:
            return ride._replace(last=here), None
    elif gap > 0 and move / gap > MOST_SPEED:
        return ride, None
    delays = (*ride.delays, math.floor(fix.seen - at[1] + 0.5))[-3:] if gap != 0 else ride.delays
    ride = Ride(True, max(ride.place, at[0]), here, delays)
    return ride, (ride.place, sorted(delays)[len(delays) // 2])


STOPS = "array<struct<lat:double,lon:double,arr:double,dep:double>>"
FIXES = "ride string, seen timestamp, told timestamp, lat double, lon double, accuracy double, heading double, speed double"
ESTIMATE = "ride string, told timestamp, place double, delay long"


def _fix(r) -> Fix:
    known = lambda x: None if x is None or pd.isna(x) else float(x)
    nan = float("nan")
    return Fix(r.seen_s, r.told_s, known(r.lat) if known(r.lat) is not None else nan, known(r.lon) if known(r.lon) is not None else nan, known(r.accuracy), known(r.heading), known(r.speed))


def _trip(r) -> tuple[list[tuple], int, float]:
    return [tuple(s[c] if s[c] is not None else None for c in ("lat", "lon", "arr", "dep")) for s in r.stops], int(r.board), r.base_s


def _with_trips(fixes: DataFrame, trips: DataFrame) -> DataFrame:
    names = [f.split(" ")[0] for f in FIXES.split(", ")]
    seconds = lambda c: (F.unix_micros(c) / 1e6).alias(f"{c}_s")
    known = fixes.select(*names, seconds("seen"), seconds("told")).where("ride is not null and seen is not null and told is not null")
    return known.join(trips.select("ride", F.col("stops").cast(STOPS).alias("stops"), F.col("board").cast("int").alias("board"), seconds("base")), "ride")


def ride_estimates(fixes: DataFrame, trips: DataFrame) -> DataFrame:
    """(ride, told, place, delay) for every fix that tells something, in one ordered pass: fixes (``FIXES``) of rides on ``trips`` (ride, stops, board, base).

    Fixes of a ride are read in the order told, then seen, in batches; what is held of a ride is a few numbers. Rides without a trip, and null times, take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ride = None, Ride()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.ride != now:
                    now, ride = r.ride, Ride()
                ride, got = observed(ride, _fix(r), *_trip(r))
                if got:
                    out.append((r.ride, r.told, *got))
            yield pd.DataFrame(out, columns=["ride", "told", "place", "delay"])

    order = ["ride", "told_s", "seen_s", "lat", "lon"]
    return _with_trips(fixes, trips).repartition("ride").sortWithinPartitions(*order).mapInPandas(run, ESTIMATE)


class _Rides(StatefulProcessor):
    """A ride as a value state (what is sure, how far, the last fix) and a list state of its delays; a timer ends it."""

    def __init__(self, after: float):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "sure boolean, place double, seen double, lat double, lon double, at double")
        self.delays = handle.getListState("delays", "delay long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.place.get() if self.place.exists() else None
        ride = Ride(s[0], s[1], tuple(s[2:]) if s[2] is not None else None, tuple(d[0] for d in self.delays.get())) if s else Ride()
        out, pdf = [], pd.concat(list(rows)).sort_values(["told_s", "seen_s", "lat", "lon"])
        for r in pdf.itertuples(index=False):
            stops, board, base = _trip(r)
            ride, got = observed(ride, _fix(r), stops, board, base)
            if got:
                out.append((key[0], r.told, *got))
        over = base + max((s[2] for s in stops if s[2] is not None), default=0.0) + self.after
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(over * 1000))
        self.place.update((ride.sure, ride.place, *(ride.last or (None,) * 4)))
        if ride.delays:
            self.delays.put([(int(d),) for d in ride.delays])
        yield pd.DataFrame(out, columns=["ride", "told", "place", "delay"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.delays.clear()
        yield pd.DataFrame([], columns=["ride", "told", "place", "delay"])

    def close(self) -> None:
        pass


def ride_stream(fixes: DataFrame, trips: DataFrame, after: float = 3_600.0, late: str = "30 seconds") -> DataFrame:
    """``ride_estimates`` for a stream of fixes; the state of a ride goes ``after`` seconds past its last arrival, in event time."""
    return _with_trips(fixes.withWatermark("told", late), trips).groupBy("ride").transformWithStateInPandas(_Rides(after), ESTIMATE, "append", "EventTime")


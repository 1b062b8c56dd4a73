"""Positions of devices made steady: one number of variance, jumps that must come twice, rest around an anchor, a fresh start on a better fix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.streaming.live import _heading, _metres

#: Fixed values. Accuracy in metres: least, where unknown, coarse, fine, good enough after a pause, lost, known before a loss, for a heading.
LEAST, UNKNOWN, COARSE, FINE, AFTER_PAUSE, LOST, KNOWN, STEADY = 3.0, 14.0, 35.0, 20.0, 45.0, 55.0, 25.0, 22.0
#: Seconds: a pause, the span of a loss, of a jump, of a stale first fix, and the bounds of a step.
PAUSE, LOSS, JUMP, STALE, SHORTEST, LONGEST = 30.0, 15.0, 10.0, 3.0, 0.2, 60.0
#: Jumps: least metres, times the accuracy; metres a second on foot, riding from, at least, times the speed; metres between two of one jump, times the accuracy.
FAR, FAR_SHARE, ON_FOOT, RIDING, RIDE, RIDE_SHARE, AGAIN, AGAIN_SHARE = 18.0, 1.3, 6.5, 4.5, 22.0, 2.2, 24.0, 1.2
#: Drift in metres a second: where unknown, least, most; rest: speed below, radius least, most and times the accuracy, most weight of a fix; least variance; speed and step from which headings count.
DRIFT, LEAST_DRIFT, MOST_DRIFT = 1.6, 0.5, 8.0
RESTING, NEAR, WIDE, NEAR_SHARE, DAMPED, LEAST_VARIANCE, MOVING, STEP = 0.65, 4.5, 11.0, 0.55, 0.1, 4.0, 0.8, 2.0


class Seen(NamedTuple):
    """A fix as it came; accuracy, speed and heading may be None."""

    ts: float
    lat: float
    lon: float
    accuracy: float | None = None
    speed: float | None = None
    heading: float | None = None


class Track(NamedTuple):
    """Where a device is taken to be, and what the next fix is held against."""

    ts: float
    lat: float
    lon: float
    accuracy: float
    heading: float | None
    variance: float
    anchor: tuple[float, float]
    count: int
    jump: tuple[float, float] | None = None


def _known(x: float | None, least: float = 0.0) -> float | None:
    return x if x is not None and math.isfinite(x) and x >= least else None


def followed(track: Track | None, fix: Seen) -> Track | None:
    """The track after a fix."""
    if not (math.isfinite(fix.lat) and math.isfinite(fix.lon)):
        return track
    told = _known(fix.accuracy)
    acc = max(LEAST, told) if told else UNKNOWN
    speed = _known(fix.speed)
    heading = None if fix.heading is None or not math.isfinite(fix.heading) or fix.heading < 0 or (speed is not None and speed < MOVING) else fix.heading % 360
    anew = Track(fix.ts, fix.lat, fix.lon, _tenth(acc), heading, acc * acc, (fix.lat, fix.lon), track.count + 1 if track else 1)
    if track is None:
        return anew
    gap = fix.ts - track.ts
    if (track.accuracy >= COARSE and acc <= FINE) or acc < track.accuracy / 2 or (gap > PAUSE and acc <= AFTER_PAUSE):
        return anew
    dt = min(LONGEST, max(SHORTEST, gap))
    if acc > LOST and track.accuracy <= KNOWN and dt < LOSS:
        return track
    moved = _metres(track.lat, track.lon, fix.lat, fix.lon)
    fastest = max(RIDE, RIDE_SHARE * speed) if speed is not None and speed > RIDING else ON_FOOT
    stale_first = track.count <= 1 and gap > STALE
    if not stale_first and dt < JUMP and moved > max(FAR, FAR_SHARE * acc) and moved / dt > fastest:
        twice = track.jump is not None and _metres(*track.jump, fix.lat, fix.lon) <= max(AGAIN, AGAIN_SHARE * acc)
        return anew if twice else track._replace(jump=(fix.lat, fix.lon))
    drift = DRIFT if speed is None else min(MOST_DRIFT, max(LEAST_DRIFT, speed))
    expected = track.variance + (drift * dt) ** 2
    weight = expected / (expected + acc * acc)
    resting = (speed is None or speed < RESTING) and _metres(*track.anchor, fix.lat, fix.lon) < max(NEAR, min(WIDE, NEAR_SHARE * acc))
    weight = min(weight, DAMPED) if resting else weight
    lat, lon = track.lat + weight * (fix.lat - track.lat), track.lon + weight * (fix.lon - track.lon)
    variance = max(LEAST_VARIANCE, (1 - weight) * expected)
    derived = _heading(track.lat, track.lon, lat, lon) if not resting and acc <= STEADY and _metres(track.lat, track.lon, lat, lon) >= STEP else None
    course = next((h for h in (heading, derived, track.heading) if h is not None), None)
    return Track(fix.ts, lat, lon, _tenth(math.sqrt(variance)), course, variance, track.anchor if resting else (lat, lon), track.count + 1)


def _tenth(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


def steadied(fixes: DataFrame) -> DataFrame:
    """Adds f_lat, f_lon, f_accuracy and f_heading to fixes (device, ts in seconds, lat, lon, accuracy, speed, heading; the last three may be null): where the device is taken to be after each.

    A far jump counts only once a second fix confirms it; around an anchor where the device rests fixes hardly count; a much better fix, or one after a pause, begins anew; a sudden loss of accuracy is
    passed over. Fixes without a place change nothing; before the first with one the results are null. Null devices or times take no part. A device's fixes are read in order, in batches, with a state of a few numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, track = None, None
        for pdf in batches:
            out = []
            for d, *x in zip(*(pdf[c].tolist() for c in ("device", "ts", "lat", "lon", "accuracy", "speed", "heading")), strict=True):
                if d != now:
                    now, track = d, None
                ts, lat, lon, *rest = (float("nan") if v is None else float(v) for v in x)
                track = followed(track, Seen(ts, lat, lon, *(None if math.isnan(v) else v for v in rest)))
                out.append((track.lat, track.lon, track.accuracy, track.heading) if track else (None,) * 4)
            yield pdf.assign(**{c: pd.Series([o[i] for o in out], dtype="Float64", index=pdf.index) for i, c in enumerate(("f_lat", "f_lon", "f_accuracy", "f_heading"))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixes.schema)
    known = fixes.where(F.col("device").isNotNull() & F.col("ts").isNotNull())
    return known.repartition("device").sortWithinPartitions("device", "ts", "lat", "lon").mapInPandas(run, f"{kinds}, f_lat double, f_lon double, f_accuracy double, f_heading double")

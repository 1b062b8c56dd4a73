"""Distances, bearings, tiles and cells as column expressions; degrees in, metres out."""

from __future__ import annotations

from math import cos, radians

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere (the atan2 form)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane: good for some kilometres, cheaper than the sphere."""
    y = (lat2 - lat1) * 111_320
    x = (lon2 - lon1) * 111_320 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, clockwise, 0 up to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def in_box(lat: Column, lon: Column, at: tuple[float, float], metres: float) -> Column:
    """A box around a point that holds all within ``metres``."""
    high = metres / 111_320
    wide = high / max(0.01, cos(radians(at[0])))
    return lat.between(at[0] - high, at[0] + high) & lon.between(at[1] - wide, at[1] + wide)


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile (x, y)."""
    n = 1 << zoom
    y = (1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / np.pi) / 2 * n
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor(y).cast("int")


def door_side(platform: Column, approach: Column, low: float = 35.0, high: float = 145.0) -> Column:
    """Right or left of the direction of travel, only where the angle between is within ``low`` and ``high`` degrees."""
    turn = F.pmod(platform - approach + 540, F.lit(360.0)) - 180
    return F.when(F.abs(turn).between(low, high), F.when(turn > 0, "right").otherwise("left"))


def _lines(points: pa.Array) -> list[np.ndarray]:
    """Rows of (lat, lon) of an array<struct<lat,lon>> column; null rows are empty."""
    return [np.array([(p["lat"], p["lon"]) for p in (v or [])], np.float64).reshape(-1, 2) for v in points.to_pylist()]


def simplify(points: Column, metres: float) -> Column:
    """Douglas-Peucker: the points of a polyline that keep it within ``metres``; ends always stay."""

    def one(p: np.ndarray) -> np.ndarray:
        if len(p) < 3:
            return np.ones(len(p), bool)
        xy = np.stack([p[:, 1] * np.cos(np.radians(p[0, 0])), p[:, 0]], axis=1) * 111_320
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        work = [(0, len(p) - 1)]
        while work:
            i, j = work.pop()
            if j - i < 2:
                continue
            d = xy[j] - xy[i]
            rel = xy[i + 1 : j] - xy[i]
            t = np.clip(rel @ d / max(1e-12, d @ d), 0, 1)
            off = np.hypot(*(rel - t[:, None] * d).T)
            k = int(off.argmax())
            if off[k] > metres:
                keep[i + 1 + k] = True
                work += [(i, i + 1 + k), (i + 1 + k, j)]
        return keep

    def run(a: pa.Array) -> pa.Array:
        out = [[{"lat": float(y), "lon": float(x)} for (y, x), k in zip(p, one(p), strict=True) if k] for p in _lines(a)]
        return pa.array(out, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))

    return F.arrow_udf(run, "array<struct<lat:double,lon:double>>")(points)


def project(points: Column, lat: Column, lon: Column) -> Column:
    """Where a point meets a polyline: struct of metres off it, segment, share of the segment, and metres along the line; null without a segment."""

    def run(a: pa.Array, la: pa.Array, lo: pa.Array) -> pa.Array:
        out = []
        for p, y, x in zip(_lines(a), la.to_pylist(), lo.to_pylist(), strict=True):
            if len(p) < 2 or y is None or x is None:
                out.append(None)
                continue
            scale = np.array([111_320 * np.cos(np.radians(y)), 111_320])
            xy = (p[:, ::-1] - np.array([x, y])) * scale
            d = np.diff(xy, axis=0)
            n = np.maximum((d * d).sum(axis=1), 1e-12)
            t = np.clip(-(xy[:-1] * d).sum(axis=1) / n, 0, 1)
            off = np.hypot(*(xy[:-1] + t[:, None] * d).T)
            k = int(off.argmin())
            long = np.sqrt((d * d).sum(axis=1))
            out.append({"off": float(off[k]), "segment": k, "share": float(t[k]), "along": float(long[:k].sum() + t[k] * long[k])})
        return pa.array(out, pa.struct([("off", pa.float64()), ("segment", pa.int32()), ("share", pa.float64()), ("along", pa.float64())]))

    return F.arrow_udf(run, "off double, segment int, share double, along double")(points, lat, lon)


def inside(points: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in the polygon of the points (even-odd rule); null points or corners give false."""
    ring = F.concat(points, F.slice(points, 1, 1))
    edges = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))
    crossed = F.filter(edges, lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]))
    return F.coalesce(F.size(crossed) % 2 == 1, F.lit(False))


def mean_bearing(degrees: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates (mean bearing, how well they agree from 0 to 1) of bearings, each counted by its weight."""
    w = F.lit(1.0) if weight is None else weight
    x, y, n = F.sum(w * F.sin(F.radians(degrees))), F.sum(w * F.cos(F.radians(degrees))), F.sum(w)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0)), F.hypot(x, y) / n


def midpoint(points: Column) -> Column:
    """The place half-way along a polyline, by length; null without points."""

    def run(a: pa.Array) -> pa.Array:
        out = []
        for p in _lines(a):
            if not len(p):
                out.append(None)
                continue
            long = np.hypot(np.diff(p[:, 0]), np.diff(p[:, 1]) * np.cos(np.radians(p[0, 0])))
            at = np.concatenate([[0.0], long.cumsum()])
            out.append({"lat": float(np.interp(at[-1] / 2, at, p[:, 0])), "lon": float(np.interp(at[-1] / 2, at, p[:, 1]))})
        return pa.array(out, pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    return F.arrow_udf(run, "lat double, lon double")(points)

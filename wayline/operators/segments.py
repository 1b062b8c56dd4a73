"""Lines as segments: the segment nearest to a point, and where lines cross. Segments lie in every grid cell that they touch; cells meet by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of a degree of latitude, as local planes take it.
DEGREE = 111_320.0


def _turn(a: Column, b: Column) -> Column:
    """Degrees of longitude from a to b, the short way."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def _around(y: Column, high: float) -> Column:
    """How many cells of about ``high`` degrees of latitude's length lie around the globe in a band."""
    far = F.least(F.greatest(F.abs(y * high), F.abs((y + 1) * high)), F.lit(89.9))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(far)) / high), F.lit(1))


def laid(segments: DataFrame, high: float, reach: float) -> DataFrame:
    """Segments (lat1, lon1, lat2, lon2, ...) once for each cell (__y, __x) of bands ``high`` degrees high that comes within ``reach`` metres of them.

    A segment is cut by bands and takes, in each, the cells between its ends there; so rows grow with its length, not with its box. The short way round counts; cells wrap at 180 degrees.
    """
    pad = reach / DEGREE + 1e-7
    east = _turn(F.col("lon1"), F.col("lon2"))
    y = F.col("__y")
    up = F.col("lat2") - F.col("lat1")
    rows = segments.withColumn("__y", F.explode(F.sequence(F.floor((F.least("lat1", "lat2") - pad) / high), F.floor((F.greatest("lat1", "lat2") + pad) / high))))
    at = lambda lat: F.when(up == 0, F.lit(None)).otherwise(F.least(F.greatest((lat - F.col("lat1")) / up, F.lit(0.0)), F.lit(1.0)))
    one, two = F.coalesce(at(y * high - pad), F.lit(0.0)), F.coalesce(at((y + 1) * high + pad), F.lit(1.0))
    n = _around(y, high)
    wide = F.degrees(F.lit(pad * 3.141592653589793 / 180)) / F.cos(F.radians(F.least(F.greatest(F.abs(y * high), F.abs((y + 1) * high)) + pad, F.lit(89.9))))
    low = F.col("lon1") + east * F.least(one * F.signum(east), two * F.signum(east)) * F.signum(east) - wide
    top = F.col("lon1") + east * F.greatest(one * F.signum(east), two * F.signum(east)) * F.signum(east) + wide
    cell = lambda lon: F.floor((lon + 180) / 360.0 * F.col("__n"))
    rows = rows.withColumns({"__n": n, "__low": low, "__top": top}).withColumns({"__a": cell(F.col("__low")), "__b": cell(F.col("__top"))})
    xs = F.when(F.col("__b") - F.col("__a") + 1 >= F.col("__n"), F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).otherwise(F.transform(F.sequence("__a", "__b"), lambda x: F.pmod(x, F.col("__n"))))
    return rows.withColumn("__x", F.explode(xs)).drop("__n", "__low", "__top", "__a", "__b")


def cell_of(lat: Column, lon: Column, high: float) -> tuple[Column, Column]:
    """Cell (y, x) of a point in the grid of ``laid``."""
    y = F.floor(lat / high)
    n = _around(y, high)
    return y, F.pmod(F.floor((lon + 180) / 360.0 * n), n)


def nearest_segment(points: DataFrame, segments: DataFrame, metres: float = 34.0, across: float = 20.0) -> DataFrame:
    """(p, seg, dist, score): of each point (p, lat, lon, east, north) the best segment (seg, lat1, lon1, lat2, lon2, penalty) within ``metres``.

    The score is the distance to the segment, plus its penalty, plus up to ``across`` for a segment that lies across the point's direction (east, north: a unit vector or null, which asks for none; segments of up to
    3 m have no direction). Distances are those on a plane around the point, and scores are compared to the millimetre; ties go to the smaller seg. Points without a segment in reach have no row, rows with null places take
    no part. A point reads one cell, whatever the lengths of segments.
    """
    high = max(4 * metres, 150.0) / DEGREE
    y, x = cell_of(F.col("lat"), F.col("lon"), high)
    asked = points.where("lat is not null and lon is not null").select("p", "lat", "lon", "east", "north", y.alias("__y"), x.alias("__x"))
    met = asked.join(laid(segments.select("seg", "lat1", "lon1", "lat2", "lon2", "penalty").dropna(subset=["lat1", "lon1", "lat2", "lon2"]), high, metres), ["__y", "__x"])
    wide = F.cos(F.radians("lat")) * DEGREE
    met = met.withColumns({"__ax": _turn(F.col("lon"), F.col("lon1")) * wide, "__ay": (F.col("lat1") - F.col("lat")) * DEGREE, "__dx": _turn(F.col("lon1"), F.col("lon2")) * wide, "__dy": (F.col("lat2") - F.col("lat1")) * DEGREE})
    met = met.withColumn("__l2", F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"))
    share = F.when(F.col("__l2") < 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("__ax") * F.col("__dx") + F.col("__ay") * F.col("__dy")) / F.col("__l2"))))
    met = met.withColumn("__t", share)
    off = F.hypot(F.col("__ax") + F.col("__t") * F.col("__dx"), F.col("__ay") + F.col("__t") * F.col("__dy"))
    cosine = F.abs((F.col("__dx") * F.col("east") + F.col("__dy") * F.col("north")) / F.sqrt("__l2"))
    askew = F.when((F.col("__l2") > 9) & F.col("east").isNotNull() & F.col("north").isNotNull(), (1 - cosine) * across).otherwise(0.0)
    milli = lambda c: F.floor(c * 1000 + 0.5) / 1000.0
    scored = met.withColumn("__off", off).where(F.col("__off") <= metres).select("p", "seg", milli(F.col("__off")).alias("dist"), milli(F.col("__off") + F.coalesce("penalty", F.lit(0.0)) + askew).alias("score"))
    return scored.groupBy("p").agg(F.min(F.struct("score", "seg", "dist")).alias("best")).select("p", "best.seg", "best.dist", "best.score")


def crossings(left: DataFrame, right: DataFrame, cell: float = 500.0) -> DataFrame:
    """(a, b, lat, lon): where segments of ``left`` (a, lat1, lon1, lat2, lon2) cross those of ``right`` (b, ...), each pair once.

    A crossing is a point inside both; segments that only touch or lie on one another don't cross (a side of less than a billionth of what it is the difference of is none). Segments are below 90 degrees long. Pairs meet in every cell of ``cell`` metres that both touch, and the cell that holds the crossing tells it.
    """
    high = cell / DEGREE
    ends = ["lat1", "lon1", "lat2", "lon2"]
    a = laid(left.select("a", *ends).dropna(subset=ends), high, 0.0)
    b = laid(right.select("b", *ends).dropna(subset=ends), high, 0.0).select("b", *[F.col(c).alias(f"o_{c}") for c in ends], "__y", "__x")
    met = a.join(b, ["__y", "__x"])
    # longitudes from the first segment's start on, so that 180 degrees is no edge
    met = met.withColumns({"__bx": _turn(F.col("lon1"), F.col("lon2")), "__cx": _turn(F.col("lon1"), F.col("o_lon1")), "__dx": _turn(F.col("lon1"), F.col("o_lon2"))})

    def side(px, py, qx, qy, rx, ry) -> Column:
        one, two = (ry - py) * (qx - px), (qy - py) * (rx - px)
        return F.when(F.abs(one - two) <= 1e-9 * (F.abs(one) + F.abs(two)), 0.0).otherwise(one - two)

    zero, ay, by, cy, dy = F.lit(0.0), F.col("lat1"), F.col("lat2"), F.col("o_lat1"), F.col("o_lat2")
    bx, cx, dx = F.col("__bx"), F.col("__cx"), F.col("__dx")
    met = met.withColumns({"__1": side(zero, ay, bx, by, cx, cy), "__2": side(zero, ay, bx, by, dx, dy), "__3": side(cx, cy, dx, dy, zero, ay), "__4": side(cx, cy, dx, dy, bx, by)})
    apart = lambda u, v: ((F.col(u) > 0) & (F.col(v) < 0)) | ((F.col(u) < 0) & (F.col(v) > 0))
    met = met.where(apart("__1", "__2") & apart("__3", "__4")).withColumn("__t", F.try_divide(F.col("__3"), F.col("__3") - F.col("__4")))
    met = met.withColumns({"lat": ay + F.col("__t") * (by - ay), "lon": F.pmod(F.col("lon1") + F.col("__t") * bx + 180, F.lit(360.0)) - 180})
    y, x = cell_of(F.col("lat"), F.col("lon"), high)
    return met.where((F.col("__y") == y) & (F.col("__x") == x)).select("a", "b", "lat", "lon")

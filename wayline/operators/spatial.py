"""Joins by distance: rows meet in grid cells by equality, and the exact distance decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.geometry import haversine
from wayline.operators.tables import cut, dealt, tasks

#: Metres of the globe's radius, as the distance takes it.
EARTH = 6_371_000


def _bands(metres: float) -> tuple[float, float]:
    """Degrees of latitude that a band of cells is high, and what its number of cells is to the cosine of its latitude.

    Points within ``metres`` differ in longitude by 2 asin(p) at most, p = sin(metres / 2R) / cos(latitude). Up to p = 0.5 that is below 2.0944 p; nearer to a pole a band is one cell.
    """
    return metres / 111_000, 2 * math.pi / 2.0944 / math.sin(metres / 2 / EARTH)


def _number(band: Column, high: float, share: float) -> Column:
    """How many equal cells around the globe a band has that are still wide enough for points of it and of the bands beside it."""
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * high, F.lit(90.0))
    n = F.floor(F.cos(F.radians(far)) * share)
    return F.when(n >= 2 * 3, n).otherwise(1)


def cells(rows: DataFrame, lat: str, lon: str, metres: float, around: bool) -> DataFrame:
    """Rows with their cell (__y, __x) in a grid of bands ``metres`` high; ``around``: once for each cell that may hold points within ``metres`` of theirs.

    The number of a band's cells is worked out once a row and band. Cells wrap at 180 degrees.
    """
    high, share = _bands(metres)
    y = F.floor(F.col(lat) / high)
    out = rows.withColumn("__y", F.explode(F.array(y - 1, y, y + 1)) if around else y)
    out = out.withColumn("__n", _number(F.col("__y"), high, share)).withColumn("__x", F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360.0 * F.col("__n")))
    if around:
        out = out.withColumn("__x", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(j) for j in (-1, 0, 1)]), lambda j: F.pmod(F.col("__x") + j, F.col("__n"))))))
    else:
        out = out.withColumn("__x", F.pmod(F.col("__x"), F.col("__n")))
    return out.drop("__n")


def near_places(left: DataFrame, right: DataFrame, metres: float, spread: str = "left") -> DataFrame:
    """(a_lat, a_lon, b_lat, b_lon, metres): pairs of different places of ``left`` (a_lat, a_lon, ...) and ``right`` (b_lat, b_lon, ...) at most ``metres`` apart, however many rows lie at each.

    At any latitude, and across 180 degrees. The side named by ``spread``, best the one with fewer places, goes to nine cells at most, the other to its own, so one equality join finds every pair once.
    """
    a = cells(left.select("a_lat", "a_lon").distinct(), "a_lat", "a_lon", metres, spread == "left")
    b = cells(right.select("b_lat", "b_lon").distinct(), "b_lat", "b_lon", metres, spread != "left")
    n = tasks(left.sparkSession)
    far = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    met = a.repartition(n, "__y", "__x").join(b, ["__y", "__x"])
    return met.withColumn("metres", far).where(F.col("metres") <= metres).drop("__y", "__x")


def within_distance(left: DataFrame, right: DataFrame, metres: float, spread: str = "left") -> DataFrame:
    """Pairs (all columns of both, metres) of ``left`` (a, a_lat, a_lon, ...) and ``right`` (b, b_lat, b_lon, ...) at most ``metres`` apart.

    Places meet first (``near_places``), once however many rows lie at them; then each side's rows are put to their places, so the pairs are made by equality joins in as many tasks as the session has
    room for, and no distance is worked out twice. Callers that need no pairs combine the rows of a place before.
    """
    met = left.join(near_places(left, right, metres, spread), ["a_lat", "a_lon"]).repartition(tasks(left.sparkSession), "b_lat", "b_lon").join(right, ["b_lat", "b_lon"])
    return met.select(*left.columns, *right.columns, "metres")


def _walk(speed: float, detour: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor(F.col("metres") * detour / speed + 0.5)).cast("long")


#: Pairs that one task gives out; it holds none of them.
PAIRS_TOLD = 4_000_000


def _sets(stops: DataFrame, metres: float, out: DataFrame | None = None) -> DataFrame:
    """(__as, __bs, metres): sets of stops (stop, lat, lon) at two places at most ``metres`` apart, dealt to as many tasks as their pairs ask for. With ``out`` (a, the two places, __out) also ``__better``: for stops of the first set what they have there in ``__out``."""
    spot = ["a_lat", "a_lon", "b_lat", "b_lon"]
    at = lambda p: stops.select("stop", F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    a, b = at("a"), at("b")
    near = cut(near_places(a, b, metres))
    n = lambda x, p: x.groupBy(f"{p}_lat", f"{p}_lon").agg(F.count("*").alias(f"__{p}"))
    many = near.join(n(a, "a"), spot[:2]).join(n(b, "b"), spot[2:]).agg(F.sum(F.col("__a") * F.col("__b"))).first()[0] or 0
    sets = near.join(dealt(a, spot[:2], "stop", "__as", out is not None), spot[:2])
    if out is not None:
        own = dealt(a, spot[:2], "stop", "__as", True).select(*spot[:2], "__part", F.explode("__as").alias("a"))
        own = out.join(own, ["a", *spot[:2]]).groupBy(*spot, "__part").agg(F.map_from_entries(F.collect_set(F.struct("a", "__out"))).alias("__better"))
        sets = sets.join(own, [*spot, "__part"], "left")
    sets = sets.join(dealt(b, spot[2:], "stop", "__bs"), spot[2:])
    return sets.repartition(tasks(stops.sparkSession, many, PAIRS_TOLD))


def footpaths(stops: DataFrame, metres: float = 800.0, speed: float = 1.45, detour: float = 1.15, least: int = 45) -> DataFrame:
    """(a, b, distance, seconds): walks between different stops (stop, lat, lon), both ways. With a column ``many``, stops for which it is true stand for several of a place and have a walk to themselves."""
    if "many" in stops.columns:
        side = lambda p, *more: stops.select(F.col("stop").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), *more)
        pairs = within_distance(side("a", "many"), side("b"), metres).where("a <> b or many")
    else:
        pairs = _sets(stops, metres).withColumn("a", F.explode("__as")).withColumn("b", F.explode("__bs")).where("a <> b")
    return pairs.select("a", "b", F.floor(F.col("metres") + 0.5).cast("long").alias("distance"), _walk(speed, detour, least).alias("seconds"))


def interchanges(first: DataFrame, second: DataFrame, hubs: DataFrame, metres: float = 600.0, hub_metres: float = 1500.0, hub_seconds: int = 600, speed: float = 1.45, detour: float = 1.15, least: int = 45) -> DataFrame:
    """(a, b, seconds) with a < b: walks between stops of two networks; from a hub also farther ones, of at least ``hub_seconds``; the longest of a pair counts. Only hubs look beyond ``metres``."""
    far = within_distance(first.join(hubs.select(F.col("stop").alias("a")).distinct(), "a", "left_semi"), second, hub_metres).where(F.col("metres") > metres)
    pairs = within_distance(first, second, metres).select("a", "b", "metres").unionByName(far.select("a", "b", "metres"))
    plain = F.floor(F.col("metres") * detour / speed + 0.5)
    seconds = F.greatest(F.when(F.col("metres") <= metres, F.lit(least)).otherwise(F.lit(hub_seconds)), plain)
    rows = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), seconds.cast("long").alias("seconds"))
    return rows.groupBy("a", "b").agg(F.max("seconds").alias("seconds"))


def replaced(stops: DataFrame, better: DataFrame, metres: float = 800.0, speed: float = 1.45, detour: float = 1.15, least: int = 45) -> DataFrame:
    """(a, b, seconds): the walks of ``footpaths`` in which ``better`` (a, b, seconds) stands, both ways, instead of those of the same pair.

    Sets of stops at two places meet, each stop with those that it has better walks to there, so no walk is in a shuffle: the tasks that give them out make them.
    """
    both = better.select("a", "b", "seconds").union(better.select("b", "a", "seconds"))
    at = lambda p: stops.select(F.col("stop").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    spot = ["a_lat", "a_lon", "b_lat", "b_lon"]
    out = both.join(at("a"), "a").join(at("b"), "b").groupBy("a", *spot).agg(F.collect_set("b").alias("__out"))
    pairs = _sets(stops, metres, out).withColumn("a", F.explode("__as")).withColumn("__out", F.try_element_at("__better", "a"))
    plain = pairs.withColumn("b", F.explode(F.when(F.col("__out").isNull(), F.col("__bs")).otherwise(F.array_except("__bs", "__out")))).where("a <> b")
    return plain.select("a", "b", _walk(speed, detour, least).alias("seconds")).union(both)


def nearest(points: DataFrame, stops: DataFrame, k: int = 1, first_metres: float = 400.0, most_metres: float = 6400.0) -> DataFrame:
    """Of each point (p, p_lat, p_lon) its ``k`` nearest stops (stop, lat, lon) within ``most_metres``: p, stop, metres, rank.

    Places ask, not points, and of a place's stops the ``k`` smallest are asked. Rings of four times the width: only places that have not found k stops within a ring ask in the next. A ring's finds are a written table, as its answers and
    the places left over both come from it. Ties go to the smaller stop.
    """
    spot = ["a_lat", "a_lon"]
    a = cut(points.select(F.col("p_lat").alias("a_lat"), F.col("p_lon").alias("a_lon")).distinct())
    own = Window.partitionBy("b_lat", "b_lon").orderBy("stop")
    b = stops.select("stop", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= k).drop("__k")
    b = cut(b)
    place = Window.partitionBy(*spot).orderBy("metres", "stop")
    out, metres = None, first_metres
    while True:
        met = cut(within_distance(a, b, metres, "right").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(*spot, "stop", "metres", "rank"))
        if metres >= most_metres:
            out = met if out is None else out.unionByName(met)
            break
        full = met.groupBy(*spot).agg(F.max("rank").alias("n")).where(F.col("n") == k).select(*spot)
        part = met.join(full, spot, "left_semi")
        out = part if out is None else out.unionByName(part)
        a, metres = cut(a.join(full, spot, "left_anti")), min(most_metres, metres * 4)
    asked = points.select("p", F.col("p_lat").alias("a_lat"), F.col("p_lon").alias("a_lon"))
    return asked.join(out, spot).select("p", "stop", "metres", "rank")


def weight_around(points: DataFrame, stops: DataFrame, metres: float = 1200.0) -> DataFrame:
    """(p, weight): the sum of the weights of the stops (stop, lat, lon, weight) within ``metres``; 0 for none. Weights are summed by place before places meet."""
    a = points.select("p", F.col("p_lat").alias("a_lat"), F.col("p_lon").alias("a_lon"))
    b = stops.groupBy(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).agg(F.sum("weight").alias("weight"))
    met = near_places(a, b, metres, "right").join(b, ["b_lat", "b_lon"]).groupBy("a_lat", "a_lon").agg(F.sum("weight").alias("weight"))
    return a.join(met, ["a_lat", "a_lon"], "left").select("p", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


def split_cells(points: DataFrame, metres: float, most: int, levels: int = 8) -> DataFrame:
    """(y, x, level, n): cells halved until none holds more than ``most`` points, or ``levels`` deep.

    The points are counted once, in cells of the finest level; the counts of coarser levels are sums of those.
    """
    high = metres / 111_000 / 2**levels
    finest = cut(points.select(F.floor(F.col("lat") / high).alias("y"), F.floor(F.col("lon") / high).alias("x")).groupBy("y", "x").agg(F.count("*").alias("n")))
    out = crowded = None
    for i in range(levels + 1):
        step = 2 ** (levels - i)
        level = finest.groupBy(F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(i))
        here = level if crowded is None else level.join(crowded, (F.floor(level["y"] / 2) == crowded["py"]) & (F.floor(level["x"] / 2) == crowded["px"]), "left_semi")
        done = here.where(F.col("n") <= most) if i < levels else here
        out = done if out is None else out.unionByName(done)
        crowded = here.where(F.col("n") > most).select(F.col("y").alias("py"), F.col("x").alias("px"))
    return out

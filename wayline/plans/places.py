"""Distances between stops, customers and positions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.clock import half_up, micro
from wayline.functions.geometry import bearing, door_side, haversine, in_box, mean_bearing, tile
from wayline.operators import search as find
from wayline.operators import spatial as sp
from wayline.plans import transit as t
from wayline.registry import query

AB = t.METRES.format(a="a.lat", b="a.lon", c="b.lat", d="b.lon")
POINTS = ", points AS (SELECT c_custkey AS p, 51 + ((c_custkey*53)%1000)/5000.0::DOUBLE AS lat, 16.9::DOUBLE + ((c_custkey*29)%1000)/3333.0::DOUBLE AS lon FROM customer)"


def points(spark, sf_dir):
    c = F.col("c_custkey")
    return t.read(spark, sf_dir, "customer").select(c.alias("p"), (F.lit(51.0) + (c * 53 % 1000) / 5000.0).alias("p_lat"), (F.lit(16.9) + (c * 29 % 1000) / 3333.0).alias("p_lon"))


@query(t.sql(f"""SELECT a.stop AS a, b.stop AS b, floor({AB} + 0.5)::BIGINT AS distance, greatest(45, floor({AB}*1.15/1.45 + 0.5))::BIGINT AS seconds FROM stops a, stops b WHERE a.stop <> b.stop AND {AB} <= 800"""))
def footpaths(spark, sf_dir):
    return sp.footpaths(t.stops(spark, sf_dir))


@query(t.sql(f"""SELECT least(a.stop, b.stop) AS a, greatest(a.stop, b.stop) AS b, max(CASE WHEN {AB} <= 1200 THEN greatest(45, floor({AB}*1.15/1.45 + 0.5)) ELSE greatest(600, floor({AB}*1.15/1.45 + 0.5)) END)::BIGINT AS seconds
  FROM stops a, stops b WHERE a.stop % 2 = 0 AND b.stop % 3 = 0 AND a.stop <> b.stop AND ({AB} <= 1200 OR ({AB} <= 4000 AND a.stop % 10 = 0)) GROUP BY 1, 2"""))
def interchanges(spark, sf_dir):
    """Walks between two networks (stops of even numbers, stops of multiples of three); from hubs (tens) farther."""
    s = t.stops(spark, sf_dir)
    side = lambda p, m: s.where(F.col("stop") % m == 0).select(F.col("stop").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    return sp.interchanges(side("a", 2), side("b", 3), s.where("stop % 10 = 0"), metres=1200.0, hub_metres=4000.0)


@query(t.sql(f""", paths AS (SELECT a.stop AS a, b.stop AS b, greatest(45, floor({AB}*1.15/1.45 + 0.5))::BIGINT AS seconds FROM stops a, stops b WHERE a.stop <> b.stop AND {AB} <= 2500),
  better AS (SELECT stop AS a, stop + 1 AS b, 77::BIGINT AS seconds FROM stops WHERE stop % 9 = 0), both_ways AS (SELECT * FROM better UNION ALL SELECT b, a, seconds FROM better)
  SELECT * FROM both_ways UNION ALL SELECT * FROM paths p WHERE NOT EXISTS (SELECT 1 FROM both_ways x WHERE x.a = p.a AND x.b = p.b)"""))
def replaced_walks(spark, sf_dir):
    s = t.stops(spark, sf_dir)
    better = s.where("stop % 9 = 0").select(F.col("stop").alias("a"), (F.col("stop") + 1).alias("b"), F.lit(77).cast("long").alias("seconds"))
    return sp.replaced(s, better, metres=2500.0)


@query(t.sql(f"""{POINTS} SELECT p, stop, floor(m + 0.5)::BIGINT AS metres, rank FROM (SELECT a.p, b.stop, {AB} AS m, row_number() OVER (PARTITION BY a.p ORDER BY {AB}, b.stop) AS rank FROM points a, stops b WHERE {AB} <= 6400) WHERE rank <= 3"""))
def nearest_stops(spark, sf_dir):
    """Of each point its three nearest stops within 6.4 km, by widening rings."""
    return sp.nearest(points(spark, sf_dir), t.stops(spark, sf_dir), k=3).select("p", "stop", half_up(F.col("metres")).alias("metres"), F.col("rank").cast("long").alias("rank"))


@query(t.sql(f"""{POINTS} SELECT a.p, coalesce(sum(b.stop % 10) FILTER (WHERE {AB} <= 1200), 0)::BIGINT AS weight FROM points a, stops b GROUP BY 1"""))
def weight_around(spark, sf_dir):
    s = t.stops(spark, sf_dir).withColumn("weight", F.col("stop") % 10)
    return sp.weight_around(points(spark, sf_dir), s)


@query(t.sql(f"""SELECT a.stop, floor({t.METRES.format(a="51.1", b="17.03", c="a.lat", d="a.lon")} + 0.5)::BIGINT AS metres FROM stops a WHERE {t.METRES.format(a="51.1", b="17.03", c="a.lat", d="a.lon")} <= 3000 ORDER BY metres, stop LIMIT 12"""))
def stops_at_place(spark, sf_dir):
    """The twelve nearest stops of one place (a top list by design): the box goes to the scan, then the distance."""
    s = t.stops(spark, sf_dir).where(in_box(F.col("lat"), F.col("lon"), (51.1, 17.03), 3000))
    far = haversine(F.lit(51.1), F.lit(17.03), F.col("lat"), F.col("lon"))
    return s.where(far <= 3000).select("stop", half_up(far).alias("metres")).orderBy("metres", "stop").limit(12)


HOP = t.METRES.format(a="lat", b="lon", c="nlat", d="nlon")
HOPS = ", hops AS (SELECT trip, seq, x.stop, lat, lon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM stop_times x JOIN stops USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq))"


def _hops(spark, sf_dir):
    w = Window.partitionBy("trip").orderBy("seq")
    at = t.stop_times(spark, sf_dir).join(t.stops(spark, sf_dir).select("stop", "lat", "lon"), "stop")
    return at.select("trip", "seq", "stop", "lat", "lon", F.lead("lat").over(w).alias("nlat"), F.lead("lon").over(w).alias("nlon"))


@query(t.sql(f"""{HOPS} SELECT trip, seq, floor(m + 0.5)::BIGINT AS metres, (sum(floor(m + 0.5)::BIGINT) OVER (PARTITION BY trip ORDER BY seq))::BIGINT AS so_far FROM (SELECT trip, seq, {HOP} AS m FROM hops WHERE nlat IS NOT NULL)"""))
def distance_along(spark, sf_dir):
    w = Window.partitionBy("trip").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hops = _hops(spark, sf_dir).where("nlat is not null").withColumn("metres", half_up(haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))))
    return hops.select("trip", "seq", "metres", F.sum("metres").over(w).alias("so_far"))


BEAR = "((degrees(atan2(sin(radians(nlon-lon))*cos(radians(nlat)), cos(radians(lat))*sin(radians(nlat))-sin(radians(lat))*cos(radians(nlat))*cos(radians(nlon-lon)))) + 720) % 360)"


@query(t.sql(f"""{HOPS}, b AS (SELECT stop, {BEAR} AS b FROM hops WHERE nlat IS NOT NULL AND (nlat, nlon) <> (lat, lon))
  SELECT stop, floor(((degrees(atan2(sum(sin(radians(b))), sum(cos(radians(b))))) + 360) % 360)*10 + 0.5)::BIGINT AS bearing10, count(*) AS n FROM b GROUP BY stop HAVING sqrt(pow(sum(sin(radians(b))),2) + pow(sum(cos(radians(b))),2)) / count(*) >= 0.68"""))
def stop_bearings(spark, sf_dir):
    """The direction in which trips leave each stop, where they agree well enough."""
    hops = _hops(spark, sf_dir).where("nlat is not null and (nlat <> lat or nlon <> lon)")
    mean, agree = mean_bearing(F.col("b"))
    out = hops.select("stop", bearing(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")).alias("b")).groupBy("stop").agg(mean.alias("m"), agree.alias("agree"), F.count("*").alias("n"))
    return out.where("agree >= 0.68").select("stop", half_up(F.col("m") * 10).alias("bearing10"), "n")


@query(t.sql("""SELECT stop, CASE WHEN abs(turn) BETWEEN 35 AND 145 THEN CASE WHEN turn > 0 THEN 'right' ELSE 'left' END END AS side FROM (SELECT stop, ((stop*37 % 360 - stop*101 % 360 + 540) % 360 + 360) % 360 - 180 AS turn FROM stops)"""))
def door_sides(spark, sf_dir):
    return t.stops(spark, sf_dir).select("stop", door_side((F.col("stop") * 37 % 360).cast("double"), (F.col("stop") * 101 % 360).cast("double")).alias("side"))


@query(t.sql("""SELECT stop, floor((lon + 180)/360*16384)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*16384)::INT AS y FROM stops"""))
def map_tiles(spark, sf_dir):
    x, y = tile(F.col("lat"), F.col("lon"), 14)
    return t.stops(spark, sf_dir).select("stop", x.alias("x"), y.alias("y"))


@query(t.sql(f"""{POINTS}, l AS (SELECT p, lat, lon, 0.02/2^0 AS c FROM points) SELECT level, count(*) AS cells, sum(n)::BIGINT AS points FROM (
  SELECT 0 AS level, y, x, n FROM (SELECT floor(lat/(2220/111000.0::DOUBLE)) AS y, floor(lon/(2220/111000.0::DOUBLE)) AS x, count(*) AS n FROM points GROUP BY 1, 2) WHERE n <= 45
  UNION ALL SELECT 1, y, x, n FROM (SELECT floor(lat/(1110/111000.0::DOUBLE)) AS y, floor(lon/(1110/111000.0::DOUBLE)) AS x, count(*) AS n FROM points GROUP BY 1, 2) WHERE (floor(y/2), floor(x/2)) IN (SELECT (y, x) FROM (SELECT floor(lat/(2220/111000.0::DOUBLE)) AS y, floor(lon/(2220/111000.0::DOUBLE)) AS x, count(*) AS n FROM points GROUP BY 1, 2) WHERE n > 45)) GROUP BY 1"""))
def split_cells(spark, sf_dir):
    out = sp.split_cells(points(spark, sf_dir).select(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")), 2220.0, 45, levels=1)
    return out.groupBy("level").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


@query(t.sql(""", w AS (SELECT stop, name || ' ' || lpad((stop % 100)::VARCHAR, 2, '0') AS name, stop*31 % 17 AS weight FROM stops UNION ALL SELECT stop + 1000000, name || ' (' || stop % 7 || ')', stop*13 % 19 FROM stops)
  SELECT base, arg_min(stop, (-weight, stop)) AS id, sum(weight)::BIGINT AS weight, count(*) AS poles FROM (SELECT trim(regexp_replace(name, '\\s+(\\(\\d+\\)|\\d{2})$', '')) AS base, stop, weight FROM w) GROUP BY 1""".replace("\\\\", "\\")))
def grouped_poles(spark, sf_dir):
    s = t.stops(spark, sf_dir)
    a = s.select(F.col("stop").alias("id"), F.concat("name", F.lit(" "), F.lpad((F.col("stop") % 100).cast("string"), 2, "0")).alias("name"), (F.col("stop") * 31 % 17).alias("weight"))
    b = s.select((F.col("stop") + 1000000).alias("id"), F.concat("name", F.lit(" ("), (F.col("stop") % 7).cast("string"), F.lit(")")).alias("name"), (F.col("stop") * 13 % 19).alias("weight"))
    return find.grouped_poles(a.union(b))


@query(t.sql(f"SELECT stop, floor({t.METRES.format(a='51.1', b='17.03', c='lat', d='lon')}/10)::BIGINT AS decametres, floor(lat*1e6 + 0.5)/1e6 AS lat FROM stops WHERE lat BETWEEN 51.05 AND 51.15 AND lon BETWEEN 16.95 AND 17.1"))
def stops_in_box(spark, sf_dir):
    s = t.stops(spark, sf_dir).where("lat between 51.05 and 51.15 and lon between 16.95 and 17.1")
    far = haversine(F.lit(51.1), F.lit(17.03), F.col("lat"), F.col("lon"))
    return s.select("stop", F.floor(far / 10).alias("decametres"), micro(F.col("lat")).alias("lat"))

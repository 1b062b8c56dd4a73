"""Hops between calls as roads: vehicles snapped to them, and where lines cross."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import platforms, segments
from wayline.plans import transit as t
from wayline.registry import query

HOPS = """, hops AS (SELECT DISTINCT route * 100 + seq AS seg, route, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, (route % 3 * 2)::DOUBLE AS penalty
  FROM (SELECT DISTINCT route, seq, stop, nxt FROM (SELECT route, seq, stop, lead(stop) OVER (PARTITION BY trip ORDER BY seq) AS nxt FROM stop_times) WHERE nxt IS NOT NULL) x JOIN stops a ON a.stop = x.stop JOIN stops b ON b.stop = x.nxt)"""
#: Reach of a vehicle's position, in metres.
REACH = 300.0


def hops(spark, sf_dir):
    """(seg, route, lat1, lon1, lat2, lon2, penalty): each different hop of a route between calls that follow one another."""
    st = t.stop_times(spark, sf_dir).select("trip", "route", "seq", "stop")
    on = st.select("trip", (F.col("seq") - 1).alias("seq"), F.col("stop").alias("nxt"))
    pairs = st.join(on, ["trip", "seq"]).select("route", "seq", "stop", "nxt").distinct()
    s = t.stops(spark, sf_dir)
    a = s.select("stop", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("stop").alias("nxt"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    out = pairs.join(a, "stop").join(b, "nxt")
    return out.select((F.col("route") * 100 + F.col("seq")).alias("seg"), "route", "lat1", "lon1", "lat2", "lon2", (F.col("route") % 3 * 2).cast("double").alias("penalty"))


@query(t.sql(f"""{HOPS}, v AS (SELECT vehicle AS p, lat + (vehicle % 7 - 3) * 0.0003::DOUBLE AS lat, lon + (vehicle % 5 - 2) * 0.0004::DOUBLE AS lon, CASE WHEN vehicle % 4 = 0 THEN NULL ELSE sin(radians(vehicle * 37 % 360)) END AS east, CASE WHEN vehicle % 4 = 0 THEN NULL ELSE cos(radians(vehicle * 37 % 360)) END AS north FROM vehicles),
  m AS (SELECT p, seg, penalty, east, north, (lon1 - v.lon) * 111320.0::DOUBLE * cos(radians(v.lat)) AS ax, (lat1 - v.lat) * 111320.0::DOUBLE AS ay, (lon2 - lon1) * 111320.0::DOUBLE * cos(radians(v.lat)) AS dx, (lat2 - lat1) * 111320.0::DOUBLE AS dy FROM v, hops),
  k AS (SELECT *, dx*dx + dy*dy AS l2, CASE WHEN dx*dx + dy*dy < 1e-6 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, -(ax*dx + ay*dy) / (dx*dx + dy*dy))) END AS t FROM m),
  o AS (SELECT *, sqrt(pow(ax + t*dx, 2) + pow(ay + t*dy, 2)) AS off FROM k),
  s AS (SELECT p, seg, floor(off*1000 + 0.5)/1000 AS dist, floor((off + penalty + CASE WHEN l2 > 9 AND east IS NOT NULL THEN (1 - abs((dx*east + dy*north)/sqrt(l2)))*20 ELSE 0 END)*1000 + 0.5)/1000 AS score FROM o WHERE off <= {REACH})
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY score, seg) = 1"""))
def snapped_vehicles(spark, sf_dir):
    """The hop that each vehicle is on: near, and along its direction where that is known."""
    v = F.col("vehicle")
    lat, lon = F.col("lat") + (v % 7 - 3) * F.lit(0.0003), F.col("lon") + (v % 5 - 2) * F.lit(0.0004)
    known = v % 4 != 0
    points = t.vehicles(spark, sf_dir).select(v.alias("p"), lat.alias("lat"), lon.alias("lon"), F.when(known, F.sin(F.radians(v * 37 % 360))).alias("east"), F.when(known, F.cos(F.radians(v * 37 % 360))).alias("north"))
    return segments.nearest_segment(points, hops(spark, sf_dir), REACH)


_ONE, _TWO = "({ry} - {py}) * ({qx} - {px})", "({qy} - {py}) * ({rx} - {px})"
CROSS = f"CASE WHEN abs({_ONE} - {_TWO}) <= 1e-9 * (abs({_ONE}) + abs({_TWO})) THEN 0.0::DOUBLE ELSE {_ONE} - {_TWO} END"
_D = {1: CROSS.format(px="a.lon1", py="a.lat1", qx="a.lon2", qy="a.lat2", rx="b.lon1", ry="b.lat1"), 2: CROSS.format(px="a.lon1", py="a.lat1", qx="a.lon2", qy="a.lat2", rx="b.lon2", ry="b.lat2"), 3: CROSS.format(px="b.lon1", py="b.lat1", qx="b.lon2", qy="b.lat2", rx="a.lon1", ry="a.lat1"), 4: CROSS.format(px="b.lon1", py="b.lat1", qx="b.lon2", qy="b.lat2", rx="a.lon2", ry="a.lat2")}


@query(t.sql(f"""{HOPS}, d AS (SELECT a.seg AS a, b.seg AS b, a.lat1, a.lon1, a.lat2, a.lon2, {_D[1]} AS d1, {_D[2]} AS d2, {_D[3]} AS d3, {_D[4]} AS d4 FROM hops a, hops b WHERE a.route < b.route)
  SELECT a, b, floor((lat1 + d3/(d3 - d4)*(lat2 - lat1))*1e6 + 0.53)/1e6 AS lat, floor((lon1 + d3/(d3 - d4)*(lon2 - lon1))*1e6 + 0.53)/1e6 AS lon FROM d WHERE sign(d1)*sign(d2) < 0 AND sign(d3)*sign(d4) < 0"""))
def line_crossings(spark, sf_dir):
    """Where hops of two routes cross."""
    h = hops(spark, sf_dir)
    found = segments.crossings(h.withColumnRenamed("seg", "a"), h.withColumnRenamed("seg", "b"))
    # stops lie on a lattice, so crossings fall on halves of a micro-degree: those round up for certain
    told = lambda c: (F.floor(F.col(c) * 1e6 + 0.53) / 1e6).alias(c)
    return found.where(F.floor(F.col("a") / 100) < F.floor(F.col("b") / 100)).select("a", "b", told("lat"), told("lon"))


#: A track through each stop, and platforms beside it: left, right or on both sides, on its layer or another.
YARD = """, yard AS (SELECT stop, lat, lon, radians(stop*37 % 360) AS w, 111320.0::DOUBLE*cos(radians(lat)) AS kx, 110574.0::DOUBLE AS ky, (100 + stop*13 % 90)::DOUBLE AS half FROM stops),
  piece AS (SELECT stop AS track, stop, s, (stop % 4)::VARCHAR AS key, stop % 2 AS layer, half, lat + ((s + 0.5)/n - 0.5)*2*half*cos(w)/ky AS lat, lon + ((s + 0.5)/n - 0.5)*2*half*sin(w)/kx AS lon, w, 2*half/n AS long FROM (SELECT *, ceil(2*half/18 - 1e-6)::INT AS n FROM yard), unnest(range(n)) AS u(s)),
  sides AS (SELECT stop, unnest(CASE stop % 3 WHEN 0 THEN [4, -4] WHEN 1 THEN [4] ELSE [-5] END) AS d FROM yard),
  plat AS (SELECT stop * 10 + CASE WHEN d > 0 THEN 1 ELSE 2 END AS platform, (stop % 5)::VARCHAR || CASE WHEN d > 0 THEN 'a' ELSE 'b' END AS ref, CASE WHEN stop % 7 = 0 THEN 5 WHEN stop % 2 = 0 THEN NULL ELSE 1 END AS layer,
    lat + (-60*cos(w) - d*sin(w))/ky AS lat1, lon + (-60*sin(w) + d*cos(w))/kx AS lon1, lat + (60*cos(w) - d*sin(w))/ky AS lat2, lon + (60*sin(w) + d*cos(w))/kx AS lon2 FROM sides JOIN yard USING (stop)),
  m AS (SELECT track, s, p.ref, sin(w) AS ux, cos(w) AS uy, (lon1 - q.lon)*111320*cos(radians(q.lat)) AS ax, (lat1 - q.lat)*110574 AS ay, (lon2 - lon1)*111320*cos(radians(q.lat)) AS dx, (lat2 - lat1)*110574 AS dy FROM piece q, plat p WHERE (p.layer IS NULL OR p.layer = q.layer) AND abs(lat1 - q.lat) < 0.01 AND abs(lon1 - q.lon) < 0.01),
  c AS (SELECT *, ax + t*dx AS cx, ay + t*dy AS cy FROM (SELECT *, greatest(0.0, least(1.0, -(ax*dx + ay*dy)/(dx*dx + dy*dy))) AS t FROM m)),
  o AS (SELECT * FROM (SELECT track, s, ref, floor(sqrt(cx*cx + cy*cy)*1000 + 0.5)/1000 AS off, floor((ux*cy - uy*cx)*1000 + 0.5)/1000 AS turn FROM c) WHERE off <= 6.5),
  lr AS (SELECT track, s, min(CASE WHEN turn > 0 THEN {'off': off, 'ref': ref} END) AS l, min(CASE WHEN turn < 0 THEN {'off': off, 'ref': ref} END) AS r FROM o GROUP BY 1, 2),
  v AS (SELECT q.*, CASE WHEN l.off <= 5.5 AND r.off <= 5.5 AND abs(l.off - r.off) < 1.8 THEN 'both' WHEN l.off IS NOT NULL AND (r.off IS NULL OR l.off + 1.8 <= r.off) THEN 'left' WHEN r.off IS NOT NULL AND (l.off IS NULL OR r.off + 1.8 <= l.off) THEN 'right' END AS side, l, r FROM piece q JOIN lr USING (track, s)),
  w AS (SELECT key, lat, lon, long, side, CASE side WHEN 'left' THEN l.ref WHEN 'right' THEN r.ref END AS ref, CASE side WHEN 'left' THEN atan2(-cos(w), sin(w)) WHEN 'right' THEN atan2(cos(w), -sin(w)) END AS b FROM v WHERE side IS NOT NULL),
  e AS (SELECT s.stop, unnest(['*', 't:' || key, 'p:' || ref]) AS entry, side, b, long FROM stops s JOIN w ON """ + t.METRES.format(a="s.lat", b="s.lon", c="w.lat", d="w.lon") + """ <= 190),
  g AS (SELECT stop, entry, sum(CASE WHEN side <> 'both' THEN long ELSE 0 END) AS one, sum(CASE WHEN side = 'both' THEN long ELSE 0 END) AS two, coalesce(sum(sin(b)*long), 0) AS sx, coalesce(sum(cos(b)*long), 0) AS sy FROM e WHERE entry IS NOT NULL GROUP BY 1, 2),
  h AS (SELECT stop, entry, CASE WHEN two >= 15 AND two > one*0.35 THEN -1 WHEN one >= 15 AND sqrt(sx*sx + sy*sy)/one >= 0.92 THEN (floor(degrees(atan2(sx, sy)) + 0.500001)::INT + 360) % 360 END AS bearing FROM g)
  SELECT stop, entry, bearing FROM h WHERE bearing IS NOT NULL AND (starts_with(entry, 't:') OR bearing <> -1)"""


@query(t.sql(YARD))
def platform_sides(spark, sf_dir):
    """On which side platforms are, for a track through each stop. The SQL holds every piece against every platform around."""
    s = t.stops(spark, sf_dir)
    k, w = F.col("stop"), F.radians(F.col("stop") * 37 % 360)
    ky, kx = F.lit(110_574.0), F.lit(111_320.0) * F.cos(F.radians("lat"))
    half = (100 + k * 13 % 90).cast("double")
    at = lambda along, off: F.struct((F.col("lat") + (along * F.cos(w) - off * F.sin(w)) / ky).alias("lat"), (F.col("lon") + (along * F.sin(w) + off * F.cos(w)) / kx).alias("lon"))
    tracks = s.select(k.alias("track"), (k % 4).cast("string").alias("key"), (k % 2).alias("layer"), F.array(at(-half, F.lit(0)), at(half, F.lit(0))).alias("points"))
    beside = F.when(k % 3 == 0, F.array(F.lit(4), F.lit(-4))).when(k % 3 == 1, F.array(F.lit(4))).otherwise(F.array(F.lit(-5)))
    d = F.col("d")
    plats = s.withColumn("d", F.explode(beside)).select((k * 10 + F.when(d > 0, 1).otherwise(2)).alias("platform"), F.concat((k % 5).cast("string"), F.when(d > 0, "a").otherwise("b")).alias("ref"), F.when(k % 7 == 0, 5).when(k % 2 == 0, F.lit(None)).otherwise(1).cast("long").alias("layer"), F.array(at(F.lit(-60), d), at(F.lit(60), d)).alias("points"))
    return platforms.platform_sides(s, tracks, plats)

"""Positions against the timetable, and delays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.clock import micro
from wayline.functions.geometry import bearing
from wayline.functions.scores import predicted_delay
from wayline.operators import live
from wayline.operators import records as rec
from wayline.plans import transit as t
from wayline.registry import query

VS = t.METRES.format(a="v.lat", b="v.lon", c="s.lat", d="s.lon")
MATCH = f""", fits AS (SELECT v.vehicle, c.trip, min({{'score': abs(v.sec - c.dep) + 2*floor({VS} + 0.5)::BIGINT, 'delay': v.sec - c.dep, 'metres': floor({VS} + 0.5)::BIGINT}}) AS x
  FROM vehicles v JOIN stop_times c ON c.route = v.route AND v.sec - c.dep BETWEEN -300 AND 5400 JOIN stops s ON s.stop = c.stop WHERE {VS} <= 350 GROUP BY 1, 2)"""


@query(t.sql(f"{MATCH} SELECT vehicle, trip, x.score AS score, x.delay AS delay, x.metres AS metres FROM fits"))
def vehicle_matches(spark, sf_dir):
    return live.schedule_matches(t.vehicles(spark, sf_dir), t.stop_times(spark, sf_dir), t.stops(spark, sf_dir))


@query(t.sql(f"""{MATCH}, own AS (SELECT vehicle, min({{'score': x.score, 'trip': trip, 'delay': x.delay}}) AS o FROM fits GROUP BY 1), won AS (SELECT o.trip AS trip, min({{'score': o.score, 'vehicle': vehicle, 'delay': o.delay}}) AS w FROM own GROUP BY 1)
  SELECT v.vehicle, trip, w.delay AS delay FROM vehicles v LEFT JOIN won ON w.vehicle = v.vehicle"""))
def matched_vehicles(spark, sf_dir):
    """One vehicle a trip; those that lose keep their row, with no trip and no delay."""
    v = t.vehicles(spark, sf_dir)
    return live.one_to_one(live.schedule_matches(v, t.stop_times(spark, sf_dir), t.stops(spark, sf_dir)), v)


@query(t.sql(""", a AS (SELECT vehicle, route, sec FROM vehicles), b AS (SELECT DISTINCT route, dep, trip FROM stop_times WHERE seq = 1)
  SELECT vehicle, route, sec, gap, dep, trip FROM (SELECT a.*, b.dep, b.trip, abs(((a.sec - b.dep + 43200) % 86400 + 86400) % 86400 - 43200) AS gap FROM a JOIN b USING (route)) WHERE gap <= 600 QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY gap, dep, trip) = 1"""))
def nearest_runs(spark, sf_dir):
    """Of each position the run of its route that starts nearest in time of day, within ten minutes."""
    a = t.vehicles(spark, sf_dir).select("vehicle", "route", "sec")
    b = t.stop_times(spark, sf_dir).where("seq = 1").select("route", "dep", "trip")
    return live.nearest_in_time(a, b, "route", "sec", "dep", 600).select("vehicle", "route", "sec", "gap", "dep", "trip")


@query("""WITH s AS (SELECT event_id AS trip, user_id AS route, (hour(ts)*3600 + minute(ts)*60 + second(ts))::BIGINT AS at, (event_id*37 % 1500) - 200 AS delay FROM events)
  SELECT w.trip, floor(median(s.delay)*0.8::DOUBLE + 0.5)::BIGINT AS estimate, count(*) AS n FROM s w JOIN s ON s.route = w.route AND abs(s.at - w.at) <= 2700 WHERE w.trip % 5 = 0 AND s.trip % 5 <> 0 GROUP BY 1 HAVING count(*) >= 2 AND abs(floor(median(s.delay)*0.8::DOUBLE + 0.5)) >= 120""")
def peer_delays(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("trip"), F.col("user_id").alias("route"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("at"), (F.col("event_id") * 37 % 1500 - 200).alias("delay"))
    return live.peer_delays(e.where("trip % 5 = 0").drop("delay"), e.where("trip % 5 <> 0"))


@query("""SELECT event_id, floor(CASE WHEN d IS NOT NULL THEN greatest(-120.0::DOUBLE, d*pow(0.5::DOUBLE, greatest(a, 0)/CASE WHEN d < 0 THEN 300.0::DOUBLE ELSE 900.0::DOUBLE END)) END*1e6 + 0.5)/1e6 AS delay FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id*37 % 1500 - 200 END AS d, event_id % 4000 AS a FROM events)""")
def predicted_delays(spark, sf_dir):
    i = F.col("event_id")
    d = F.when(i % 11 != 0, i * 37 % 1500 - 200)
    return t.read(spark, sf_dir, "events").select("event_id", micro(predicted_delay(d, i % 4000, F.lit(900.0))).alias("delay"))


@query("""SELECT event_id, least(sec, 50000) AS sec FROM (SELECT event_id, (hour(ts)*3600 + minute(ts)*60 + second(ts))::BIGINT AS sec FROM events) WHERE sec BETWEEN 49880 AND 50015""")
def fresh_samples(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select("event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("sec"))
    return live.fresh(e, "sec", 50000).select("event_id", F.col("sec").cast("long").alias("sec"))


@query(t.sql("""SELECT route, vehicle, sec FROM vehicles QUALIFY row_number() OVER (PARTITION BY route ORDER BY sec DESC, vehicle DESC) = 1"""))
def latest_positions(spark, sf_dir):
    v = t.vehicles(spark, sf_dir).select("route", "vehicle", "sec")
    return rec.one_of_each(v, ["route"], [F.col("sec"), F.col("vehicle")], first=False)


BEAR = "((degrees(atan2(sin(radians(lon-plon))*cos(radians(lat)), cos(radians(plat))*sin(radians(lat))-sin(radians(plat))*cos(radians(lat))*cos(radians(lon-plon)))) + 720) % 360)"


@query(t.sql(f"""SELECT vehicle, floor({BEAR}*10 + 0.5)::BIGINT AS bearing10 FROM (SELECT vehicle, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM vehicles WINDOW w AS (PARTITION BY route ORDER BY vehicle)) WHERE plat <> lat OR plon <> lon"""))
def headings(spark, sf_dir):
    w = Window.partitionBy("route").orderBy("vehicle")
    v = t.vehicles(spark, sf_dir).select("vehicle", "lat", "lon", F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon")).where("plat <> lat or plon <> lon")
    return v.select("vehicle", F.floor(bearing(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")) * 10 + 0.5).alias("bearing10"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec, value, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
  r AS (SELECT user_id, event_id, sec, value::DOUBLE AS smooth, k FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.sec, r.smooth + (1 - exp(-(e.sec - r.sec)/3600.0::DOUBLE))*(e.value - r.smooth), e.k FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT user_id, event_id, floor(smooth*1e6 + 0.5)/1e6 AS smooth FROM r""")
def smoothed_values(spark, sf_dir):
    """Exponential smoothing in time."""
    e = t.read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "value")
    out = live.smoothed(e, "user_id", "at", "value", 3600.0, also=["event_id"])
    return out.select("user_id", "event_id", micro(F.col("smooth")).alias("smooth"))

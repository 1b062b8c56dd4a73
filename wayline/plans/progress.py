"""Trips under way, stations, journeys as segments, news."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.clock import micro
from wayline.operators import itineraries as it
from wayline.operators import news, stations, tracking
from wayline.operators import patterns as pat
from wayline.plans import transit as t
from wayline.registry import query

NOON = 43_200


@query(t.sql(f"""SELECT trip, floor((lat + share*(coalesce(tlat, lat) - lat))*1e6 + 0.5)/1e6 AS lat, floor((lon + share*(coalesce(tlon, lon) - lon))*1e6 + 0.5)/1e6 AS lon, floor(share*1e6 + 0.5)/1e6 AS share FROM (
  SELECT *, CASE WHEN dep >= {NOON} THEN 0.0::DOUBLE ELSE ({NOON} - dep)/greatest(nxt - dep, 1)::DOUBLE END AS share FROM (SELECT trip, arr, dep, lat, lon, lead(arr) OVER w AS nxt, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon FROM stop_times x JOIN stops USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq))
  WHERE (dep <= {NOON} AND nxt > {NOON}) OR (arr <= {NOON} AND dep > {NOON}))"""))
def scheduled_positions(spark, sf_dir):
    """Where each trip under way at noon should be."""
    p = tracking.scheduled_positions(t.stop_times(spark, sf_dir), t.stops(spark, sf_dir), NOON)
    return p.select("trip", micro(F.col("lat")).alias("lat"), micro(F.col("lon")).alias("lon"), micro(F.col("share")).alias("share"))


@query(t.sql(f"""SELECT trip, CASE WHEN deps[1] - {NOON} > 600 THEN 'planned' WHEN deps[1] > {NOON} THEN 'soon' WHEN arrs[-1] >= {NOON} THEN 'under way' ELSE 'over' END AS phase, len(list_filter(arrs, lambda a: a >= {NOON}))::INT AS left_calls FROM trip_rows"""))
def trip_phases(spark, sf_dir):
    return tracking.phases(pat.trip_rows(t.stop_times(spark, sf_dir)), NOON).select("trip", "phase", F.col("left").alias("left_calls"))


@query(t.sql("""SELECT x.trip, max(CASE WHEN metres <= along + 35 THEN seq END) AS last_seq, min(CASE WHEN NOT metres <= along + 35 THEN seq END) AS next_seq FROM (SELECT trip, seq, (seq - 1)*400 AS metres FROM stop_times) x JOIN (SELECT trip, trip % 2500 AS along FROM trips) p USING (trip) GROUP BY 1"""))
def stops_around(spark, sf_dir):
    d = t.stop_times(spark, sf_dir).select("trip", "seq", ((F.col("seq") - 1) * 400).alias("metres"))
    return tracking.stops_around(d, t.trips(spark, sf_dir).select("trip", (F.col("trip") % 2500).alias("along")))


@query("""WITH s AS (SELECT user_id AS leg, event_id AS vehicle, event_id*37 % 50 AS score FROM events), b AS (SELECT leg, min(score) AS score, arg_min(vehicle, score*1000000000 + vehicle) AS vehicle FROM s GROUP BY 1), p AS (SELECT leg, vehicle, score FROM s WHERE vehicle % 97 = 5 QUALIFY row_number() OVER (PARTITION BY leg ORDER BY vehicle) = 1)
  SELECT b.leg, CASE WHEN p.score <= b.score + 2 THEN p.vehicle ELSE b.vehicle END AS vehicle FROM b LEFT JOIN p USING (leg)""")
def steady_matches(spark, sf_dir):
    s = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("leg"), F.col("event_id").alias("vehicle"), (F.col("event_id") * 37 % 50).alias("score"))
    return tracking.steady_match(s, s.where("vehicle % 97 = 5").groupBy("leg").agg(F.min("vehicle").alias("vehicle")))


@query(t.sql("""SELECT x.trip, x.seq, coalesce(p.parent, x.stop) AS stop, CASE WHEN p.parent IS NOT NULL THEN x.stop END AS platform FROM stop_times x LEFT JOIN (SELECT stop, stop - stop % 4 AS parent FROM stops WHERE stop % 4 <> 0) p USING (stop)"""))
def calls_at_stations(spark, sf_dir):
    s = t.stops(spark, sf_dir).select("stop", F.when(F.col("stop") % 4 != 0, F.col("stop") - F.col("stop") % 4).cast("string").alias("parent"))
    calls = stations.with_parents(t.stop_times(spark, sf_dir).withColumn("stop", F.col("stop").cast("string")), s.withColumn("stop", F.col("stop").cast("string")))
    return calls.select("trip", "seq", F.col("stop").cast("long").alias("stop"), F.col("platform").cast("long").alias("platform"))


@query(t.sql("""SELECT trip, n, array_to_string(CASE WHEN i > 0 AND j > i + 1 THEN list_filter(stops[i+1:j-1], lambda s: s <> v) ELSE [] END, '>') AS left_out FROM (SELECT trip, len(stops)::INT AS n, stops, 1 AS i, len(stops) AS j, stops[2] AS v FROM trip_rows)"""))
def omitted_stops(spark, sf_dir):
    """Stops that a detour from the first to the last stop via the second leaves out."""
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).select("trip", F.transform("stops", lambda s: s.cast("string")).alias("s"))
    out = news.omitted(F.col("s"), F.get("s", F.lit(0)), F.try_element_at("s", F.lit(-1)), F.array_compact(F.array(F.get("s", F.lit(1)))))
    return rows.select("trip", F.size("s").alias("n"), F.array_join(out, ">").alias("left_out"))


@query("""WITH n AS (SELECT p_partkey AS news, CASE WHEN p_size % 3 = 0 THEN [p_type] ELSE [] END AS tags, p_name AS text FROM part), l AS (SELECT upper(x) AS line FROM (VALUES ('red'), ('bolt'), ('ECONOMY'), ('LARGE')) v(x)),
  w AS (SELECT news, upper(unnest(tags)) AS line FROM n UNION SELECT news, unnest(regexp_split_to_array(upper(text), '[^A-Z0-9]+')) FROM n WHERE len(tags) = 0) SELECT DISTINCT news, line FROM w JOIN l USING (line)""")
def news_about_lines(spark, sf_dir):
    rows = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("news"), F.when(F.col("p_size") % 3 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("tags"), F.col("p_name").alias("text"))
    return news.about_lines(rows, spark.createDataFrame([("red",), ("bolt",), ("ECONOMY",), ("LARGE",)], "line string"))


@query()
def chosen_journeys(spark, sf_dir):
    """The ten proposals of each query: greedy spacing, so tested against a plain loop."""
    k = F.col("o_orderkey")
    dep = k * 97 % 7200
    ride = F.struct(F.lit("bus").alias("kind"), (k % 7).cast("string").alias("line"), k.alias("trip"), (k % 50).alias("board"), (k % 49).alias("alight"), dep.alias("dep"), (dep + 1200 + k * 31 % 3000).alias("arr"), F.lit(4000.0).alias("metres"), F.lit(5).alias("stops")).cast(it.SEGMENT)
    rows = t.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("q"), dep.alias("dep"), (dep + 1200 + k * 31 % 3000).alias("arr"), (k % 4).alias("transfers"), F.array(ride).alias("segments"))
    return it.chosen(rows).select("q", "dep", "arr", "transfers", "combo", "place")

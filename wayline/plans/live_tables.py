"""Tables that live: polls applied, updates that may be shown, rides followed, versions of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayline.functions.clock import micro
from wayline.operators import patterns as pat
from wayline.operators import records
from wayline.operators.tables import shared_folder
from wayline.plans import transit as t
from wayline.registry import query
from wayline.sinks import versions
from wayline.streaming import live


@query("""WITH c AS (SELECT event_type AS feed, (user_id % 40)::VARCHAR AS vehicle, event_id AS poll, ts, value AS delay, CASE WHEN event_id % 5 = 0 THEN 'gone' ELSE 'seen' END AS kind FROM events)
  SELECT feed, vehicle, poll, delay FROM c QUALIFY row_number() OVER (PARTITION BY feed, vehicle ORDER BY poll DESC) = 1 AND kind = 'seen'""")
def live_table(spark, sf_dir):
    """All changes of the live table applied to an empty one."""
    e = t.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "gone").otherwise("seen")
    none = F.lit(None).cast("double")
    changes = e.select(F.col("event_type").alias("feed"), (F.col("user_id") % 40).cast("string").alias("vehicle"), F.col("event_id").alias("poll"), "ts", none.alias("lat"), none.alias("lon"), F.col("value").alias("delay"), kind.alias("kind"))
    return live.applied(changes.drop("kind").limit(0), changes).select("feed", "vehicle", "poll", "delay")


DAY = 86_400


@query(f"""WITH u AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT % {DAY} AS fetched, event_id FROM events), l AS (SELECT key, fetched, event_id FROM u WHERE 43200 - fetched <= 7200 QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched DESC, event_id DESC) = 1)
  SELECT key, fetched, event_id, 43200 - fetched BETWEEN 0 AND 300 AS live FROM l""")
def usable_updates(spark, sf_dir):
    """Updates that may be shown at noon, by the time of day they were fetched."""
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_seconds(F.col("ts").cast("timestamp")) % DAY).alias("fetched"), "event_id")
    return live.usable_updates(rows, F.lit(43_200))


@query("""WITH r AS (SELECT o_orderkey AS ride, o_orderkey*97 % 86400 AS boarding, o_custkey*61 % 90000 AS arrival, o_orderkey*31 % 86400 AS added, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey*13 % 5000 END AS delay FROM orders)
  SELECT ride, w AS watched, w AND coalesce(added <= boarding - 3600 AND delay < 3600, false) AS candidate FROM (SELECT *, 43200 >= boarding - 7200 AND 43200 <= greatest(arrival, boarding) + 7200 AS w FROM r)""")
def monitored_rides(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rides = t.read(spark, sf_dir, "orders").select(k.alias("ride"), (k * 97 % 86_400).alias("boarding"), (c * 61 % 90_000).alias("arrival"), (k * 31 % 86_400).alias("added"), (k * 97 % 86_400).alias("scheduled"), F.when(k % 7 != 0, c * 13 % 5_000).alias("delay"))
    return records.monitored(rides, F.lit(43_200)).select("ride", "watched", "candidate")


@query("""WITH a AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), c AS (SELECT s_suppkey * 2 AS id, 'new ' || s_name AS name FROM supplier),
  b AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c)
  SELECT 1::BIGINT AS version, id, name FROM a UNION ALL SELECT 2::BIGINT AS version, id, name FROM b""")
def table_versions(spark, sf_dir):
    """A table, and the table after an upsert, read at the end: the first version's reader still has its rows."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-versions-{uuid.uuid4().hex}"
    rows = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    versions.commit(rows, path, expect=0)
    first, _ = versions.read(spark, path)
    versions.upsert(rows.select((F.col("id") * 2).alias("id"), F.concat(F.lit("new "), "name").alias("name"), F.lit(1).alias("at")), path, ["id"], "at")
    second, at = versions.read(spark, path)
    return first.select(F.lit(1).cast("long").alias("version"), "id", "name").unionByName(second.select(F.lit(at.number).cast("long").alias("version"), "id", "name"))


@query()
def ride_estimates(spark, sf_dir):
    """Riders on trips: each event is a fix of the trip of its user's number, on the line, a little beside it or not accurate. What a fix tells depends on all before it; tests hold it against hand-made rides and the stream."""
    s = t.stops(spark, sf_dir).select("stop", "lat", "lon")
    calls = t.stop_times(spark, sf_dir).join(s, "stop").withColumn("dep", F.col("dep").cast("double")).withColumn("arr", F.col("arr").cast("double"))
    first = F.min("arr").over(pat.Window.partitionBy("trip"))
    calls = calls.withColumn("zero", first).select("trip", "seq", "lat", "lon", (F.col("arr") - F.col("zero")).alias("arr"), (F.col("dep") - F.col("zero")).alias("dep"))
    trips = calls.groupBy(F.col("trip").cast("string").alias("ride")).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon", "arr", "dep"))).alias("stops")).where(F.size("stops") > 1)
    base = F.timestamp_seconds(F.lit(1_704_067_200))
    trips = trips.select("ride", F.transform("stops", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), x["arr"].alias("arr"), x["dep"].alias("dep"))).alias("stops"), F.lit(0).alias("board"), base.alias("base"))
    e = t.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ride"), "event_id").join(trips.select("ride", "stops"), "ride")
    n = F.size("stops") - 1
    share = F.col("event_id") * 37 % 1009 / 1009.0 * n
    e = e.withColumn("i", F.floor(share).cast("int")).withColumn("f", share - F.floor(share)).withColumn("a", F.get("stops", F.col("i"))).withColumn("b", F.get("stops", F.col("i") + 1))
    between = lambda x, y: F.col(f"a.{x}") + F.col("f") * (F.col(f"b.{y}") - F.col(f"a.{x}"))
    seen = F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(between("dep", "arr") + F.col("event_id") % 5))
    beside = F.when(F.col("event_id") % 11 == 0, 0.01).otherwise(0.0001)
    known = e.select("ride", seen.alias("seen"), seen.alias("told"), (between("lat", "lat") + beside).alias("lat"), between("lon", "lon").alias("lon"), F.when(F.col("event_id") % 13 == 0, 80.0).otherwise(12.0).alias("accuracy"), F.lit(None).cast("double").alias("heading"), F.lit(None).cast("double").alias("speed"))
    return live.ride_estimates(known, trips).select("ride", "told", micro(F.col("place")).alias("place"), "delay")

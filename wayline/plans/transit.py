"""The given tables read as a timetable: one definition for Spark, one for DuckDB.

stops: suppliers on a made-up grid. trips: orders that have lines; route is the customer modulo 20, service the weekday (0: Sunday).
stop_times: the distinct line numbers of an order in their order, two minutes apart. calendar: a service per nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.alias("stop"), F.col("s_name").alias("name"), (F.lit(51.0) + (s * 37 % 1000) / 5000.0).alias("lat"), (F.lit(16.9) + (s * 91 % 1000) / 3333.0).alias("lon"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("trip"), (F.col("o_custkey") % 20).alias("route"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("service"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("headsign"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, ns): an order's distinct line numbers, sorted; they combine before the shuffle."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ns"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).join(_lines(spark, sf_dir).select("trip"), "trip", "left_semi")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle of each table on the trip; the number of stops is one broadcast row."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n_stops"))
    rows = _orders(spark, sf_dir).join(_lines(spark, sf_dir), "trip").crossJoin(F.broadcast(n))
    rows = rows.select("trip", "route", "service", "n_stops", F.posexplode("ns").alias("p", "ln")).withColumn("seq", (F.col("p") + 1).cast("long"))
    dep = F.col("trip") * 97 % 86_400 + F.col("seq") * 120
    return rows.select("trip", "route", "service", "seq", ((F.col("route") * 13 + F.col("seq") * 7) % F.col("n_stops")).alias("stop"), (dep - 20).alias("arr"), dep.alias("dep"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    mask = (n * 37 + 11) % 128
    days = [F.shiftright(mask, i).bitwiseAND(1).alias(d) for i, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))]
    start = F.concat(F.lit("202401"), F.lpad((n % 9 + 1).cast("string"), 2, "0"))
    end = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("202402"), F.lpad((n % 20 + 1).cast("string"), 2, "0")))
    return read(spark, sf_dir, "nation").select(n.cast("long").alias("service"), *days, start.alias("start_date"), end.alias("end_date"))


def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day that is both added and removed counts as added."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return e.groupBy((F.col("user_id") % 25).alias("service"), F.date_format("ts", "yyyyMMdd").alias("date")).agg(F.min(1 + F.col("event_id") % 2).alias("exc"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: each event is a vehicle of a route near a stop of it, at the event's time of day."""
    e = read(spark, sf_dir, "events")
    s = F.col("user_id") * 13 % 1000
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return e.select(F.col("event_id").alias("vehicle"), (F.col("user_id") % 20).alias("route"), sec.alias("sec"), (F.lit(51.0) + (s * 37 % 1000) / 5000.0).alias("lat"), (F.lit(16.9) + (s * 91 % 1000) / 3333.0).alias("lon"))


SQL = """
stops AS (SELECT s_suppkey AS stop, s_name AS name, 51 + ((s_suppkey*37)%1000)/5000.0::DOUBLE AS lat, 16.9::DOUBLE + ((s_suppkey*91)%1000)/3333.0::DOUBLE AS lon FROM supplier),
trips AS (SELECT o_orderkey AS trip, o_custkey % 20 AS route, dayofweek(o_orderdate)::BIGINT AS service, o_orderdate::DATE AS day, o_orderpriority AS headsign
  FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
stop_times AS (SELECT t.trip, t.route, t.service, s.seq, (t.route*13 + s.seq*7) % n.n AS stop, (t.trip*97)%86400 + s.seq*120 - 20 AS arr, (t.trip*97)%86400 + s.seq*120 AS dep
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) s
  JOIN trips t ON t.trip = s.l_orderkey, (SELECT count(*) AS n FROM supplier) n),
trip_rows AS (SELECT trip, route, service, list(stop ORDER BY seq) AS stops, list(arr ORDER BY seq) AS arrs, list(dep ORDER BY seq) AS deps FROM stop_times GROUP BY trip, route, service),
calendar AS (SELECT n_nationkey::BIGINT AS service, (n_nationkey*37+11)%128 AS mask, '202401' || lpad((n_nationkey%9+1)::VARCHAR, 2, '0') AS start_date,
  CASE WHEN n_nationkey%5=0 THEN '' ELSE '202402' || lpad((n_nationkey%20+1)::VARCHAR, 2, '0') END AS end_date FROM nation),
calendar_dates AS (SELECT user_id%25 AS service, strftime(ts, '%Y%m%d') AS date, min(1 + event_id%2) AS exc FROM events WHERE event_type IN ('error','signup') GROUP BY 1, 2),
vehicles AS (SELECT event_id AS vehicle, user_id%20 AS route, (hour(ts)*3600 + minute(ts)*60 + second(ts))::BIGINT AS sec,
  51 + (((user_id*13%1000)*37)%1000)/5000.0::DOUBLE AS lat, 16.9::DOUBLE + (((user_id*13%1000)*91)%1000)/3333.0::DOUBLE AS lon FROM events)
"""
#: Macros do not fit one statement, so the distance is spelt out: metres between (a, b) and (c, d).
METRES = "(2*6371000.0*atan2(sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)), sqrt(1-(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))))"


def sql(body: str) -> str:
    """DuckDB SQL over the timetable's views."""
    return f"WITH {SQL} {body}" if not body.lstrip().startswith(",") else f"WITH {SQL}{body}"

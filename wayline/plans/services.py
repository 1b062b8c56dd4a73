"""Calendars, trips, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.clock import clock_text, easter, is_holiday, parse_clock
from wayline.operators import calendar as cal
from wayline.operators import patterns as pat
from wayline.plans import transit as t
from wayline.registry import query

DATE, FLAG = "20240116", "(mask >> dayofweek(DATE '2024-01-16')) & 1 = 1"
DAYS_SQL = """, days AS (
  SELECT service, d::DATE AS day FROM (SELECT service, mask, unnest(generate_series(strptime(start_date,'%Y%m%d'), strptime(CASE WHEN end_date='' THEN '20240228' ELSE end_date END,'%Y%m%d'), INTERVAL 1 DAY)) AS d FROM calendar) WHERE (mask >> dayofweek(d)) & 1 = 1
  UNION SELECT service, strptime(date,'%Y%m%d')::DATE FROM calendar_dates WHERE exc = 1
), service_days AS (SELECT * FROM days EXCEPT SELECT service, strptime(date,'%Y%m%d')::DATE FROM calendar_dates WHERE exc = 2)
"""


@query(t.sql(f"""SELECT service FROM (SELECT service FROM calendar WHERE {FLAG} AND (start_date='' OR start_date<='{DATE}') AND (end_date='' OR end_date>='{DATE}')
  UNION SELECT service FROM calendar_dates WHERE date='{DATE}' AND exc=1) WHERE service NOT IN (SELECT service FROM calendar_dates WHERE date='{DATE}' AND exc=2)"""))
def active_services(spark, sf_dir):
    return cal.active_services(t.calendar(spark, sf_dir), t.calendar_dates(spark, sf_dir), DATE)


@query(t.sql("SELECT trip, service FROM trips WHERE service IN (SELECT 2) AND NOT EXISTS (SELECT 1 FROM calendar WHERE false)"))
def fallback_services(spark, sf_dir):
    """With empty calendars every service of the trips runs; here those of Tuesdays."""
    trips = t.trips(spark, sf_dir).where("service = 2")
    none = t.calendar(spark, sf_dir).where("false")
    services = cal.active_services(none, t.calendar_dates(spark, sf_dir).where("false"), DATE, everything=trips)
    return trips.join(services, "service", "left_semi").select("trip", "service")


@query(t.sql(f"{DAYS_SQL} SELECT * FROM service_days"))
def service_days(spark, sf_dir):
    return cal.expanded(t.calendar(spark, sf_dir), t.calendar_dates(spark, sf_dir), (DATE, "20240228"))


@query(t.sql(f"""{DAYS_SQL}, sets AS (SELECT service, sha1(string_agg(strftime(day,'%Y%m%d'), ',' ORDER BY day)) AS key FROM (SELECT DISTINCT * FROM service_days) GROUP BY 1)
  SELECT key, string_agg(service::VARCHAR, ',' ORDER BY service) AS services, count(*) AS n FROM sets GROUP BY 1"""))
def services_by_days(spark, sf_dir):
    days = cal.expanded(t.calendar(spark, sf_dir), t.calendar_dates(spark, sf_dir), (DATE, "20240228"))
    return cal.services_by_days(days).select("key", F.array_join(F.col("services").cast("array<string>"), ",").alias("services"), F.size("services").cast("long").alias("n"))


@query(t.sql(f"""{DAYS_SQL} SELECT service, coalesce(bit_or(1 << dayofweek(day)) FILTER (WHERE day NOT IN (DATE '2024-01-01', DATE '2024-01-06')), 0)::BIGINT AS mask,
  count(*) FILTER (WHERE day IN (DATE '2024-01-01', DATE '2024-01-06')) AS holidays FROM service_days GROUP BY 1"""))
def weekday_masks(spark, sf_dir):
    return cal.weekday_masks(cal.expanded(t.calendar(spark, sf_dir), t.calendar_dates(spark, sf_dir), (DATE, "20240228")))


@query("""SELECT y, strftime(e, '%Y-%m-%d') AS easter, n FROM (VALUES (2024, DATE '2024-03-31', 13), (2025, DATE '2025-04-20', 13), (2026, DATE '2026-04-05', 13)) v(y, e, n)""")
def holidays(spark, sf_dir):
    years = spark.range(2024, 2027).select(F.col("id").cast("int").alias("y"))
    days = years.select("y", F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)))).alias("d"))
    counted = days.where(is_holiday(F.col("d"))).groupBy("y").agg(F.count("*").cast("int").alias("n"))
    return counted.select("y", F.date_format(easter(F.col("y")), "yyyy-MM-dd").alias("easter"), "n")


@query(t.sql("SELECT route, array_to_string(stops, '>') AS pattern, len(stops)::BIGINT AS n_stops, count(*) AS n_trips, min(deps[1]) AS first_dep, max(deps[1]) AS last_dep FROM trip_rows GROUP BY 1, 2, 3"))
def trip_patterns(spark, sf_dir):
    return pat.patterns(pat.trip_rows(t.stop_times(spark, sf_dir)))


@query(t.sql("""SELECT trip, min(dep) AS min_dep, max(arr) AS max_arr, CASE WHEN bool_or(s.stop IS NULL) THEN NULL ELSE string_agg(x.stop::VARCHAR, ',' ORDER BY seq) END AS stops, string_agg((dep-arr)::VARCHAR, ',' ORDER BY seq) AS stays
  FROM stop_times x LEFT JOIN (SELECT * FROM stops WHERE stop % 50 <> 3) s ON x.stop = s.stop GROUP BY trip"""))
def packed_trips(spark, sf_dir):
    """Each trip as arrays; one that calls at an unknown stop has none."""
    known = t.stops(spark, sf_dir).where("stop % 50 <> 3").select("stop", F.lit(True).alias("known"))
    rows = t.stop_times(spark, sf_dir).join(known, "stop", "left")
    calls = F.array_sort(F.collect_list(F.struct("seq", "stop", (F.col("dep") - F.col("arr")).alias("stay"))))
    packed = rows.groupBy("trip").agg(F.min("dep").alias("min_dep"), F.max("arr").alias("max_arr"), F.bool_and(F.coalesce("known", F.lit(False))).alias("whole"), calls.alias("c"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return packed.select("trip", "min_dep", "max_arr", F.when(F.col("whole"), text("c.stop")).alias("stops"), text("c.stay").alias("stays"))


@query(t.sql("""SELECT route, trip, n FROM (SELECT route, array_to_string(stops,'>') AS pattern, count(*) AS n, min(trip) AS trip FROM trip_rows GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY route ORDER BY n DESC, pattern) = 1"""))
def representative_trips(spark, sf_dir):
    return pat.representative_trips(pat.trip_rows(t.stop_times(spark, sf_dir)))


@query(t.sql("SELECT trip, min(dep) AS first_dep, max(arr) AS last_arr FROM stop_times GROUP BY trip HAVING min(dep) <= 30000 AND max(arr) >= 28800"))
def trips_under_way(spark, sf_dir):
    return t.stop_times(spark, sf_dir).groupBy("trip").agg(F.min("dep").alias("first_dep"), F.max("arr").alias("last_arr")).where("first_dep <= 30000 and last_arr >= 28800")


@query(t.sql("""SELECT base, row_number() OVER (PARTITION BY base ORDER BY days[1], signature) AS variant, signature, strftime(days[1],'%Y-%m-%d') AS first_day, len(days)::BIGINT AS n_days FROM (
  SELECT base, signature, list(DISTINCT day ORDER BY day) AS days FROM (SELECT r.route * 1000 + r.service AS base, day, substr(sha1(concat_ws('|', array_to_string(stops,','), array_to_string(list_transform(deps, lambda d: d - deps[1]),','))),1,16) AS signature FROM trip_rows r JOIN trips USING (trip)) GROUP BY 1, 2)"""))
def merged_variants(spark, sf_dir):
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).join(t.trips(spark, sf_dir).select("trip", "day"), "trip")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    steps = F.transform("deps", lambda d: d - F.get("deps", F.lit(0)))
    rows = rows.select((F.col("route") * 1000 + F.col("service")).alias("base"), "day", pat.signature(text(F.col("stops")), text(steps)).alias("signature"))
    out = pat.merged_variants(rows)
    return out.select("base", F.col("variant").cast("long").alias("variant"), "signature", F.date_format(F.get("days", F.lit(0)), "yyyy-MM-dd").alias("first_day"), F.size("days").cast("long").alias("n_days"))


@query(t.sql("SELECT stop, (dep // 3600) AS hour, string_agg(DISTINCT ((dep % 3600) // 60)::VARCHAR, ' ' ORDER BY ((dep % 3600) // 60)::VARCHAR) AS minutes FROM stop_times GROUP BY 1, 2"))
def departures_by_hour(spark, sf_dir):
    out = pat.departures_by_hour(t.stop_times(spark, sf_dir))
    return out.select("stop", "hour", F.array_join(F.array_sort(F.col("minutes").cast("array<string>")), " ").alias("minutes"))


@query("""SELECT p_partkey AS trip, start_at, start_at + 300 AS last FROM (SELECT p_partkey, unnest(generate_series(20000 + p_partkey % 100, 20000 + p_partkey % 100 + p_size * 60, 420)) AS start_at FROM part)""")
def frequency_trips(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    start = 20000 + F.col("p_partkey") % 100
    rows = p.select(F.col("p_partkey").alias("trip"), start.alias("start"), (start + F.col("p_size") * 60).alias("end"), F.lit(420).cast("long").alias("headway"), F.array(F.lit(10), F.lit(310)).cast("array<bigint>").alias("deps"))
    out = pat.by_frequency(rows)
    return out.select("trip", F.col("at").alias("start_at"), F.try_element_at("deps", F.lit(-1)).alias("last"))


@query("""WITH c AS (SELECT user_id, event_id, (hour(ts)*3600 + minute(ts)*60 + second(ts))::BIGINT AS sec FROM events),
  b AS (SELECT *, CASE WHEN sec < lag(sec) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS back FROM c)
  SELECT user_id, event_id, sec + (sum(back) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT * 86400 AS day_sec FROM b""")
def past_midnight(spark, sf_dir):
    e = t.read(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("sec"))
    return pat.past_midnight(rows, "user_id", "event_id", "sec").select("user_id", "event_id", "day_sec")


@query()
def fifo_chains(spark, sf_dir):
    """Greedy and so in order: tested against a plain loop."""
    return pat.fifo_groups(pat.trip_rows(t.stop_times(spark, sf_dir)))


@query(t.sql("SELECT stop, name, coalesce(n, 0) AS weight FROM stops LEFT JOIN (SELECT stop, count(*) AS n FROM stop_times GROUP BY 1) USING (stop)"))
def stop_weights(spark, sf_dir):
    n = t.stop_times(spark, sf_dir).groupBy("stop").agg(F.count("*").alias("n"))
    return t.stops(spark, sf_dir).join(n, "stop", "left").select("stop", "name", F.coalesce("n", F.lit(0)).alias("weight"))


@query(t.sql("SELECT substr(name, 1, 17) AS base, sum(n)::BIGINT AS calls, count(*) AS stops FROM stops JOIN (SELECT stop, count(*) AS n FROM stop_times GROUP BY 1) USING (stop) GROUP BY 1"))
def name_rollup(spark, sf_dir):
    n = t.stop_times(spark, sf_dir).groupBy("stop").agg(F.count("*").alias("n"))
    return t.stops(spark, sf_dir).join(n, "stop").groupBy(F.substring("name", 1, 17).alias("base")).agg(F.sum("n").alias("calls"), F.count("*").alias("stops"))


@query(t.sql("""SELECT trip, seq, lpad(((arr % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((arr % 3600) // 60)::VARCHAR, 2, '0') AS clock, CASE WHEN arr < 48*3600 AND arr >= 0 THEN arr - arr % 60 END AS parsed FROM stop_times"""))
def clock_texts(spark, sf_dir):
    st = t.stop_times(spark, sf_dir)
    pad = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    long_clock = F.concat(pad(F.col("arr") / 3600), F.lit(":"), pad(F.col("arr") % 3600 / 60))
    return st.select("trip", "seq", clock_text(F.col("arr")).alias("clock"), parse_clock(long_clock).cast("long").alias("parsed"))


@query(t.sql("""SELECT route, direction, headsign, pattern, n_trips, rank FROM (
  SELECT route, (t.trip % 2) AS direction, headsign, array_to_string(stops,'>') AS pattern, count(*) AS n_trips, row_number() OVER (PARTITION BY route, (t.trip % 2), headsign ORDER BY count(*) DESC, array_to_string(stops,'>')) AS rank
  FROM trip_rows r JOIN (SELECT trip, headsign FROM trips) t USING (trip) GROUP BY 1, 2, 3, 4) WHERE rank <= 3"""))
def line_timetables(spark, sf_dir):
    """Of each line, direction and headsign the three commonest stop sequences."""
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).join(t.trips(spark, sf_dir).select("trip", "headsign"), "trip")
    n = rows.groupBy("route", (F.col("trip") % 2).alias("direction"), "headsign", pat.pattern_key(F.col("stops")).alias("pattern")).agg(F.count("*").alias("n_trips"))
    w = Window.partitionBy("route", "direction", "headsign").orderBy(F.desc("n_trips"), "pattern")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")

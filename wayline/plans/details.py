"""Queries of the smaller functions: encodings, shards, texts, dates, slices, stored alerts, walks, compositions, sessions, turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import codec, words
from wayline.functions.clock import is_holiday, micro
from wayline.operators import alerts, fixes, news, stations, tracking
from wayline.operators import itineraries as it
from wayline.operators import patterns as pat
from wayline.plans import transit as t
from wayline.registry import query
from wayline.streaming import positions

#: Text of zig-zag numbers, ``bits`` a sign; each sign but a number's last has the next bit set.
SIGNS = "list_transform(list_filter(range(0, 12), lambda i: i = 0 OR v >> ({bits}*i) > 0), lambda i: (v >> ({bits}*i)) % {base} + CASE WHEN v >> ({bits}*(i+1)) > 0 THEN {base} ELSE 0 END)"
ZIGZAG = "CASE WHEN d < 0 THEN -2*d - 1 ELSE 2*d END"


@query(t.sql(f""", p AS (SELECT trip, seq, floor(lat*1e5 + 0.5)::BIGINT AS y, floor(lon*1e5 + 0.5)::BIGINT AS x FROM stop_times JOIN stops USING (stop)),
  d AS (SELECT trip, seq, unnest([1, 2]) AS k, unnest([y - lag(y, 1, 0) OVER w, x - lag(x, 1, 0) OVER w]) AS d FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq)),
  v AS (SELECT trip, seq, k, {ZIGZAG} AS v FROM d)
  SELECT trip, string_agg(array_to_string(list_transform({SIGNS.format(bits=5, base=32)}, lambda c: chr((c + 63)::INT)), ''), '' ORDER BY seq, k) AS line, count(*) // 2 AS n FROM v GROUP BY trip"""))
def encoded_lines(spark, sf_dir):
    """Each trip's way as a short text, and how many points come back out of it."""
    at = t.stop_times(spark, sf_dir).join(t.stops(spark, sf_dir).select("stop", "lat", "lon"), "stop")
    rows = at.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).select("trip", codec.encode_line(F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))).alias("line"))
    return rows.select("trip", "line", F.size(codec.decode_line(F.col("line"))).cast("long").alias("n"))


LEGS = "(SELECT trip, seq, stop AS board, lead(stop) OVER w AS alight, dep, lead(arr) OVER w AS arr FROM stop_times WINDOW w AS (PARTITION BY trip ORDER BY seq))"


@query(t.sql(f""", l AS (SELECT * FROM {LEGS} WHERE alight IS NOT NULL),
  d AS (SELECT trip, seq, unnest([1, 2, 3, 4, 5]) AS k, unnest([trip - lag(trip, 1, 0) OVER w, board - lag(board, 1, 0) OVER w, alight - lag(alight, 1, 0) OVER w, dep - lag(dep, 1, 0) OVER w, arr - lag(arr, 1, 0) OVER w]) AS d FROM l WINDOW w AS (PARTITION BY trip ORDER BY seq)),
  v AS (SELECT trip, seq, k, {ZIGZAG} AS v FROM d),
  b AS (SELECT trip, string_agg(array_to_string(list_transform({SIGNS.format(bits=7, base=128)}, lambda c: printf('%02x', c)), ''), '' ORDER BY seq, k) AS hex FROM v GROUP BY trip)
  SELECT trip, rtrim(replace(replace(to_base64(unhex(hex)), '+', '-'), '/', '_'), '=') AS code, true AS back FROM b"""))
def encoded_journeys(spark, sf_dir):
    """Each trip's hops as a url-safe text; ``back`` says that decoding gives the hops again."""
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).where(F.size("stops") > 1)
    legs = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(F.col("trip"), F.get("stops", i - 1).alias("board"), F.get("stops", i).alias("alight"), F.get("deps", i - 1).alias("dep"), F.get("arrs", i).alias("arr")))
    rows = rows.select("trip", legs.alias("legs")).withColumn("code", codec.encode_journey(F.col("legs")))
    return rows.select("trip", "code", (codec.decode_journey(F.col("code")).cast("string") == F.col("legs").cast("string")).alias("back"))


@query("SELECT o_orderkey AS id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('trip:' || o_orderkey || ':' || o_orderpriority, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash, (hash % 256)::INT AS shard FROM orders")
def trip_shards(spark, sf_dir):
    """The file that each trip is published in, by the low byte of its key's hash."""
    key = F.concat(F.lit("trip:"), F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderpriority")
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), codec.fnv1a(key).alias("hash"), codec.shard_of(key).alias("shard"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h FROM a),
  l AS (SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - c%4) % 7 AS l FROM h), e AS (SELECT y, make_date(y, (h + l - 7*((a + 11*h + 22*l)//451) + 114)//31, (h + l - 7*((a + 11*h + 22*l)//451) + 114) % 31 + 1) AS easter FROM l)
  SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders JOIN e ON e.y = year(o_orderdate) WHERE strftime(o_orderdate, '%m-%d') IN ('01-01', '01-06', '05-01', '05-03', '08-15', '11-01', '11-11', '12-25', '12-26') OR o_orderdate::DATE - easter IN (0, 1, 49, 60) GROUP BY 1""")
def trips_on_holidays(spark, sf_dir):
    """Days of the timetable that are holidays, and how many trips run on them."""
    day = F.to_date("o_orderdate")
    return t.read(spark, sf_dir, "orders").where(is_holiday(day)).groupBy(day.cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey AS id, array_to_string(list_transform(string_split(regexp_replace(lower(p_name || '-' || p_brand || '/' || p_type || ' (x)'), '([\s\-/(])', '\1' || chr(1), 'g'), chr(1)), lambda w: upper(w[1]) || w[2:]), '') AS title FROM part""")
def titles(spark, sf_dir):
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.title_case(F.concat("p_name", F.lit("-"), "p_brand", F.lit("/"), "p_type", F.lit(" (x)"))).alias("title"))


@query(t.sql("""SELECT trip, CASE WHEN j > i THEN array_to_string(stops[i:j], '>') END AS part, array_to_string(list_filter(thirds, lambda x, k: k = 1 OR thirds[k-1] <> x), '>') AS runs
  FROM (SELECT trip, stops, list_transform(stops, lambda s: s // 30) AS thirds, list_position(stops, stops[2]) AS i, list_position(stops, stops[2]) + list_position(stops[list_position(stops, stops[2]) + 1:], stops[-1]) AS j FROM trip_rows WHERE len(stops) > 2)"""))
def slices_between(spark, sf_dir):
    """A trip from its second stop to its last, and its places, coarse, without those equal to the one before."""
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).where(F.size("stops") > 2)
    part = it.slice_between(F.col("stops"), F.get("stops", F.lit(1)), F.try_element_at("stops", F.lit(-1)))
    text = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), ">")
    return rows.select("trip", text(part).alias("part"), text(it.without_repeats(F.transform("stops", lambda s: F.floor(s / 30)))).alias("runs"))


@query("""SELECT 'e' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS title, CASE WHEN event_id % 2 = 0 THEN (user_id % 20)::VARCHAR WHEN event_id % 4 = 1 THEN 'A,' || (user_id % 20) ELSE '' END AS lines, event_id % 5 = 0 AS resolved FROM events WHERE event_id % 7 <> 0""")
def stored_alerts(spark, sf_dir):
    """Alerts as they were stored, by two versions of the format; texts that are none (of every seventh event) go."""
    k, line = F.col("event_id"), (F.col("user_id") % 20).cast("string")
    first = F.struct(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.when(k % 3 != 0, F.col("event_type")).alias("title"), line.alias("line"), F.when(k % 5 == 0, True).alias("resolved"))
    second = F.struct(F.lit(2).alias("version"), F.concat(F.lit("e"), k.cast("string")).alias("id"), F.when(k % 3 != 0, F.col("event_type")).alias("title"), F.when(k % 4 == 1, F.array(F.lit("A"), line)).alias("lines"), F.when(k % 5 == 0, True).alias("resolved"))
    text = F.when(k % 14 == 0, "{not json").when(k % 7 == 0, '{"title": "no id"}').when(k % 2 == 0, F.to_json(first)).otherwise(F.to_json(second))
    return alerts.parsed(t.read(spark, sf_dir, "events").select(text.alias("value"))).select("id", "title", F.array_join("lines", ",").alias("lines"), "resolved")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def written_dates(spark, sf_dir):
    """Dates found in texts that write them in three ways."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    month = F.element_at(F.array(*map(F.lit, news.MONTHS)), F.month(d))
    text = F.when(k % 4 == 0, F.concat(F.lit("od 7 do "), F.date_format(d, "yyyy-MM-dd"))).when(k % 4 == 1, F.concat(F.lit("Zmiany "), F.date_format(d, "d.MM.yyyy"), F.lit(" r."))).when(k % 4 == 2, F.concat(F.lit("Dnia "), F.dayofmonth(d).cast("string"), F.lit(" "), month, F.lit(" "), F.year(d).cast("string"))).otherwise("32.13.2024")
    return t.read(spark, sf_dir, "orders").select(k.alias("id"), news.written_date(text).cast("string").alias("day"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'Red' END AS first, CASE WHEN p_partkey % 3 < 2 THEN 'Brand' END AS second, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS line FROM part")
def fare_borders(spark, sf_dir):
    """Stops that mark a border of fares: names of every third part are none."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("GRANICA Red - Brand ("), "p_brand", F.lit(")"))).when(k % 3 == 1, "granica Red-Brand").otherwise(F.concat(F.lit("Granica "), "p_brand"))
    return t.read(spark, sf_dir, "part").select(k.alias("id"), stations.fare_border(name).alias("x")).select("id", "x.first", "x.second", "x.line")


JOURNEYS = "j AS (SELECT o_custkey AS q, o_orderkey*97 % 7200 AS dep, o_orderkey*97 % 7200 + 1200 + o_orderkey*31 % 3000 AS arr, (o_orderkey % 4)::INT AS transfers FROM orders), w AS (SELECT c_custkey AS q, c_custkey*13 % 7200 AS dep, c_custkey*61 % 5000 AS seconds FROM customer WHERE c_custkey % 3 <> 0)"


@query(f"WITH {JOURNEYS} SELECT j.q, j.dep, arr, transfers FROM j LEFT JOIN w USING (q) WHERE w.q IS NULL OR arr < w.dep + seconds UNION ALL SELECT q, dep, dep + seconds, 0 FROM w")
def walks_or_rides(spark, sf_dir):
    """Rides that no walk beats, and the walks."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    rides = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), (k * 97 % 7200).alias("dep"), (k * 97 % 7200 + 1200 + k * 31 % 3000).alias("arr"), (k % 4).cast("int").alias("transfers"), F.array().cast(it.SEGMENTS).alias("segments"))
    walks = t.read(spark, sf_dir, "customer").where(c % 3 != 0).select(c.alias("q"), (c * 13 % 7200).alias("dep"), (c * 61 % 5000).alias("seconds"))
    return it.with_walk_only(rides, walks).drop("segments")


@query("""WITH s AS (SELECT user_id::VARCHAR AS vehicle, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS begins FROM events),
  n AS (SELECT *, sum(begins) OVER (PARTITION BY vehicle ORDER BY ts, begins DESC ROWS UNBOUNDED PRECEDING) AS k FROM s)
  SELECT vehicle, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 2 HOUR))::BIGINT AS until, count(*) AS n FROM n GROUP BY vehicle, k""")
def vehicle_sessions(spark, sf_dir):
    """Spans in which a vehicle is heard of at least every two hours."""
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("vehicle"), F.col("ts").cast("timestamp").alias("ts"))
    out = positions.sessions(rows, "2 hours")
    return out.select("vehicle", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("until"), "n")


BEARING = "((degrees(atan2(sin(radians({d}-{b}))*cos(radians({c})), cos(radians({a}))*sin(radians({c})) - sin(radians({a}))*cos(radians({c}))*cos(radians({d}-{b})))) % 360) + 360) % 360"


@query(t.sql(f""", p AS (SELECT trip AS path, seq AS i, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM stop_times JOIN stops USING (stop) WINDOW w AS (PARTITION BY trip ORDER BY seq)),
  b AS (SELECT path, i, {BEARING.format(a="plat", b="plon", c="lat", d="lon")} AS b1, {BEARING.format(a="lat", b="lon", c="nlat", d="nlon")} AS b2 FROM p WHERE plat IS NOT NULL AND nlat IS NOT NULL)
  SELECT path, i, floor(((((b2 - b1 + 540) % 360) + 360) % 360 - 180)*1e6 + 0.5)/1e6 AS turn FROM b WHERE abs((((b2 - b1 + 540) % 360) + 360) % 360 - 180) >= 35"""))
def turns_of_trips(spark, sf_dir):
    """Stops at which a trip's way turns by 35 degrees or more; stops lie farther apart than turns that count as one."""
    at = t.stop_times(spark, sf_dir).join(t.stops(spark, sf_dir).select("stop", "lat", "lon"), "stop")
    return tracking.turns(at.select(F.col("trip").alias("path"), F.col("seq").alias("i"), "lat", "lon")).select("path", "i", micro(F.col("turn")).alias("turn"))


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderkey*37 % 300 AS day, [{'start': o_orderkey % 200, 'end_': o_orderkey % 200 + 50, 'current': o_orderkey % 5 = 0, 'n': 1}, {'start': o_orderkey*7 % 250, 'end_': o_orderkey*7 % 250 + 60, 'current': o_orderkey % 3 = 0, 'n': 2}] AS x FROM orders)
  SELECT id, coalesce(list_filter(x, lambda e: e.start <= day AND e.end_ >= day)[1].n, list_filter(x, lambda e: e.current)[1].n, 1)::INT AS n, CASE coalesce(list_filter(x, lambda e: e.start <= day AND e.end_ >= day)[1].n, list_filter(x, lambda e: e.current)[1].n, 1) WHEN 1 THEN 'bike,wifi' ELSE 'wifi' END AS amenities,
    CASE coalesce(list_filter(x, lambda e: e.start <= day AND e.end_ >= day)[1].n, list_filter(x, lambda e: e.current)[1].n, 1) WHEN 1 THEN 140 ELSE 60 END::INT AS seats FROM v""")
def train_compositions(spark, sf_dir):
    """The composition that a train has on a day, and what its cars with seats carry."""
    k = F.col("o_orderkey")
    car = lambda kind, seats, *am: F.struct(F.lit(kind).alias("kind"), F.lit(seats).alias("seats"), F.array(*map(F.lit, am)).cast("array<string>").alias("amenities"))
    one = F.struct((k % 200).alias("start"), (k % 200 + 50).alias("end"), (k % 5 == 0).alias("current"), F.array(car("second", 80, "wifi"), car("first", 60, "bike", "wifi"), car("engine", 0, "none")).alias("cars"))
    two = F.struct((k * 7 % 250).alias("start"), (k * 7 % 250 + 60).alias("end"), (k % 3 == 0).alias("current"), F.array(car("second", 60, "wifi")).alias("cars"))
    rows = t.read(spark, sf_dir, "orders").select(k.alias("id"), stations.composition_on(F.array(one, two), k * 37 % 300).alias("x"))
    rows = rows.select("id", F.when(F.size("x.cars") == 3, 1).otherwise(2).alias("n"), stations.composition_summary(F.col("x")).alias("y"))
    return rows.select("id", "n", F.array_join("y.amenities", ",").alias("amenities"), "y.seats")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Plac Red,' || p_brand ELSE 'Plac Red' END AS names, CASE WHEN p_size % 3 = 0 THEN 'Nowhere Street' ELSE '' END AS unknown FROM part""")
def alert_checks(spark, sf_dir):
    """Names of alerts by their canonical form, and names in their prose that neither the source has nor are allowed."""
    size = F.col("p_size")
    names = F.when(size % 2 == 0, F.array(F.lit("PLAC RED"), F.col("p_brand"), F.lit("plac red"))).otherwise(F.array(F.lit("plac Red")))
    table = F.create_map(F.lit("plac red"), F.lit("Plac Red"))
    text = F.concat(F.lit("detour by Plac Red and Long Road"), F.when(size % 3 == 0, ", then Nowhere Street").otherwise(""))
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(news.canonical(names, table), ",").alias("names"), F.array_join(news.unknown_names(text, F.lit("works at Plac Red"), F.array(F.lit("Long Road"))), ",").alias("unknown"))


@query()
def steady_fixes(spark, sf_dir):
    """Positions of users through the filter; what a fix does depends on all before it, so tests hold it against hand-made ways."""
    e = t.read(spark, sf_dir, "events")
    k = F.col("event_id")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    # seconds of a walk: a day counts as a minute, so that fixes follow one another
    rows = e.select(F.col("user_id").alias("device"), (sec / 1440).alias("ts"), (F.lit(51.0) + sec % 86_400 / 1e8 + k % 17 / 1e5).alias("lat"), (F.lit(17.0) + k % 13 / 1e5).alias("lon"), (5 + k % 40).cast("double").alias("accuracy"), F.when(k % 3 == 0, 1.4).alias("speed"), F.lit(None).cast("double").alias("heading"))
    out = fixes.steadied(rows)
    return out.select("device", "ts", micro(F.col("f_lat")).alias("lat"), micro(F.col("f_lon")).alias("lon"), "f_accuracy")

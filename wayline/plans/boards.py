"""Departure boards, joins of the timetable, day unions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.clock import wrapped_difference
from wayline.functions.codec import fingerprint
from wayline.operators import records as rec
from wayline.plans import transit as t
from wayline.registry import query


@query(t.sql("""SELECT stop, trip, route, headsign, dep, rank FROM (SELECT s.stop, s.trip, s.route, t.headsign, s.dep, row_number() OVER (PARTITION BY s.stop ORDER BY s.dep, s.trip) AS rank
  FROM (SELECT stop, trip, route, min(dep) AS dep FROM stop_times WHERE service = 2 AND dep BETWEEN 28740 AND 39600 GROUP BY 1, 2, 3) s JOIN trips t USING (trip)) WHERE rank <= 20"""))
def departure_board(spark, sf_dir):
    """Of each stop the next 20 departures on a Tuesday from 08:00 (a minute back, three hours on), one row a trip."""
    st = t.stop_times(spark, sf_dir).where("service = 2 and dep between 28740 and 39600")
    one = st.groupBy("stop", "trip", "route").agg(F.min("dep").alias("dep"))
    top = rec.top_of_each(one, ["stop"], [F.col("dep"), F.col("trip")], 20)
    return top.join(t.trips(spark, sf_dir).select("trip", "headsign"), "trip").select("stop", "trip", "route", "headsign", "dep", F.col("rank").cast("long").alias("rank"))


@query(t.sql("SELECT q.id, q.stop, q.at, min(s.dep) AS next_dep FROM (SELECT event_id AS id, user_id % (SELECT count(*) FROM supplier) AS stop, (event_id * 7) % 86400 AS at FROM events) q JOIN stop_times s ON s.stop = q.stop AND s.dep >= q.at - 30 GROUP BY 1, 2, 3"))
def next_departures(spark, sf_dir):
    """For each asked (stop, time) the next departure: both sides in one window by stop and time, not a join of all pairs.

    Each side has a stop and second once, so a window has at most two rows for each second of the timetable's day, however many ask there.
    """
    n = t.read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    asked = t.read(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(F.col("event_id").alias("id"), (F.col("user_id") % F.col("n")).alias("stop"), (F.col("event_id") * 7 % 86400).alias("at"))
    deps = t.stop_times(spark, sf_dir).select("stop", F.col("dep").alias("t"), "dep").distinct()
    times = asked.select("stop", (F.col("at") - 30).alias("t"), F.lit(None).cast("long").alias("dep")).distinct()
    w = Window.partitionBy("stop").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    met = times.unionByName(deps).withColumn("next_dep", F.min("dep").over(w)).where("dep is null and next_dep is not null")
    return asked.join(met.select("stop", (F.col("t") + 30).alias("at"), "next_dep"), ["stop", "at"]).select("id", "stop", "at", "next_dep")


@query(t.sql("SELECT a.route, a.stop AS board, b.stop AS alight, count(*) AS n, min(b.arr - a.dep) AS ride FROM stop_times a JOIN stop_times b ON a.trip = b.trip AND a.seq < b.seq GROUP BY 1, 2, 3"))
def connected_pairs(spark, sf_dir):
    """Ordered pairs of calls of a trip. Both sides of the self join share one shuffle by trip: the pairs are made within each trip's array."""
    st = t.stop_times(spark, sf_dir)
    rows = st.groupBy("route", "trip").agg(F.array_sort(F.collect_list(F.struct("seq", "stop", "arr", "dep"))).alias("c"))
    a = rows.select("route", "c", F.posexplode("c").alias("i", "a"))
    pairs = a.select("route", F.col("a.stop").alias("board"), F.col("a.dep").alias("dep"), F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    return pairs.groupBy("route", "board", F.col("b.stop").alias("alight")).agg(F.count("*").alias("n"), F.min(F.col("b.arr") - F.col("dep")).alias("ride"))


@query(t.sql("SELECT x.trip, x.seq, s.name, x.dep FROM stop_times x LEFT JOIN (SELECT * FROM stops WHERE stop % 10 <> 0) s ON x.stop = s.stop"))
def calls_with_names(spark, sf_dir):
    s = t.stops(spark, sf_dir).where("stop % 10 <> 0").select("stop", "name")
    return t.stop_times(spark, sf_dir).join(s, "stop", "left").select("trip", "seq", "name", "dep")


@query(t.sql("SELECT trip, service FROM trips WHERE NOT EXISTS (SELECT 1 FROM calendar c WHERE c.service = trips.service AND c.mask % 2 = 1)"))
def orphan_trips(spark, sf_dir):
    """Trips whose service has no calendar row (of those that run on Sundays)."""
    c = t.calendar(spark, sf_dir).where("sun = 1").select("service")
    return t.trips(spark, sf_dir).select("trip", "service").join(c, "service", "left_anti").select("trip", "service")


@query(t.sql("SELECT route, count(*) AS trips, count(*) FILTER (WHERE service IN (0, 6)) AS weekend, count(*) FILTER (WHERE day >= DATE '1998-01-01') AS recent FROM trips GROUP BY 1"))
def route_counts(spark, sf_dir):
    return t.trips(spark, sf_dir).groupBy("route").agg(F.count("*").alias("trips"), F.count_if(F.col("service").isin(0, 6)).alias("weekend"), F.count_if(F.col("day") >= F.lit("1998-01-01").cast("date")).alias("recent"))


@query(t.sql("""SELECT 'd' || trip AS key, stop, dep FROM stop_times WHERE service = 2 UNION ALL SELECT 'y' || trip, stop, dep - 86400 FROM stop_times WHERE service = 1 AND dep >= 86400
  UNION ALL SELECT 't' || trip, stop, dep + 86400 FROM stop_times WHERE service = 3 AND dep < 7200"""))
def around_midnight(spark, sf_dir):
    """A day with the late trips of the day before and the early ones of the next, on one scale of seconds."""
    st = t.stop_times(spark, sf_dir)
    part = lambda mark, rows, by: rows.select(F.concat(F.lit(mark), F.col("trip")).alias("key"), "stop", (F.col("dep") + by).alias("dep"))
    return part("d", st.where("service = 2"), 0).union(part("y", st.where("service = 1 and dep >= 86400"), -86400)).union(part("t", st.where("service = 3 and dep < 7200"), 86400))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_shipdate, l_extendedprice, l_quantity) = 1""")
def first_rows(spark, sf_dir):
    """lineitem with one row for each (order, line): the first by supplier, part, date and price."""
    li = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    order = [F.col(c) for c in ("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")]
    return rec.one_of_each(li, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def latest_by_key(spark, sf_dir):
    """A key-value store's state: the last put of each key."""
    return rec.one_of_each(t.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], [F.col("event_id")], first=False)


@query("""SELECT c_custkey AS id, coalesce(v, c_acctbal) AS value FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1) e ON e.user_id = c_custkey
  UNION ALL SELECT user_id, arg_max(value, event_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def upserted_rows(spark, sf_dir):
    current = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    changes = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", F.col("event_id").alias("at"))
    return rec.upserted(current, changes, ["id"], "at")


@query("""SELECT id, saved, value FROM (SELECT o_orderkey AS id, o_orderkey * 3 % 1000 AS saved, 1 AS value FROM orders WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 2 = 0)
  UNION ALL SELECT o_orderkey, o_orderkey * 7 % 1000, 2 FROM orders WHERE o_orderkey % 2 = 0) ORDER BY saved DESC, id LIMIT 200""")
def merged_backup(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders")
    side = lambda m, f, v: o.where(F.col("o_orderkey") % m == 0).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * f % 1000).alias("saved"), F.lit(v).alias("value"))
    return rec.merged_backup(side(3, 3, 1), side(2, 7, 2), "id", "saved", 200)


@query("""SELECT user_id AS trip, event_type = 'error' AS finished, ts AS start_at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error'), ts DESC, event_id DESC) = 1""")
def newest_runs(spark, sf_dir):
    """Of the runs of one trip in a feed: one that still runs before one that has finished, then the later start."""
    e = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("trip"), (F.col("event_type") == "error").alias("finished"), F.col("ts").alias("start_at"), "event_id")
    return rec.newest_state(e, "trip", "finished", "start_at")


@query("""SELECT key, name, origin FROM (SELECT lower(p_name) AS key, p_name AS name, 0 AS origin, p_partkey AS id FROM part UNION ALL SELECT lower(p_name), upper(p_name), 1, p_partkey FROM part WHERE p_size > 5) QUALIFY row_number() OVER (PARTITION BY key ORDER BY origin, name, id) = 1""")
def suggestions_first_wins(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    local = p.select(F.lower("p_name").alias("key"), F.col("p_name").alias("name"), F.lit(0).alias("origin"))
    remote = p.where("p_size > 5").select(F.lower("p_name").alias("key"), F.upper("p_name").alias("name"), F.lit(1).alias("origin"))
    return rec.union_first_wins([local, remote], F.col("key"))


@query("""SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1, 2""")
def distinct_latest(spark, sf_dir):
    return rec.distinct_latest(t.read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query(t.sql("""SELECT 'removed' AS kind, service FROM (SELECT service FROM calendar EXCEPT SELECT service FROM calendar_dates) UNION ALL SELECT 'both', service FROM (SELECT service FROM calendar INTERSECT SELECT service FROM calendar_dates WHERE exc = 2)"""))
def service_sets(spark, sf_dir):
    c, d = t.calendar(spark, sf_dir).select("service"), t.calendar_dates(spark, sf_dir)
    gone = c.join(d.select("service"), "service", "left_anti").select(F.lit("removed").alias("kind"), "service")
    return gone.union(c.intersect(d.where("exc = 2").select("service")).select(F.lit("both"), "service"))


@query(t.sql("""SELECT t.trip, t.route, CASE WHEN d.delay IS NULL THEN 'unknown' WHEN d.delay = 0 THEN 'on time' WHEN d.delay > 0 THEN 'late' ELSE 'early' END AS state, d.delay FROM trips t LEFT JOIN
  (SELECT user_id AS trip, ((((max(event_id)*37 % 86400) - (min(event_id)*11 % 86400)) % 86400 + 86400) % 86400 + 129600) % 86400 - 43200 AS delay FROM events GROUP BY 1) d USING (trip)"""))
def delay_states(spark, sf_dir):
    """Unknown is not on time."""
    e = t.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trip")).agg(wrapped_difference(F.max("event_id") * 37 % 86400, F.min("event_id") * 11 % 86400).alias("delay"))
    state = F.when(F.col("delay").isNull(), "unknown").when(F.col("delay") == 0, "on time").when(F.col("delay") > 0, "late").otherwise("early")
    return t.trips(spark, sf_dir).join(e, "trip", "left").select("trip", "route", state.alias("state"), "delay")


@query("""SELECT o_orderkey AS id, substr(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 16) AS print FROM orders""")
def content_prints(spark, sf_dir):
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fingerprint(F.col("o_orderkey"), F.col("o_orderstatus")).alias("print"))


@query("""WITH o AS (SELECT o_orderkey AS id, sha256('{"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders), old AS (SELECT o_orderkey AS id, sha256('{"o_orderstatus":"O"}') AS hash FROM orders WHERE o_orderkey % 2 = 0)
  SELECT id, hash FROM o WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = o.id AND old.hash = o.hash)""")
def changed_rows(spark, sf_dir):
    """What must be worked out again: rows whose content isn't what was stored under their key."""
    o = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    done = o.where("id % 2 = 0").select("id", F.sha2(F.to_json(F.struct(F.lit("O").alias("o_orderstatus"))), 256).alias("hash"))
    return rec.needs_work(o, done, "id", ["o_orderstatus"]).select("id", "hash")


@query(t.sql("""SELECT 'trips without calls' AS gate, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT trip FROM trips) UNION ALL SELECT 'calls at unknown stops', count(*) FROM stop_times WHERE stop NOT IN (SELECT stop FROM stops)
  UNION ALL SELECT 'times out of order', count(*) FROM stop_times a JOIN stop_times b ON a.trip = b.trip AND b.seq = a.seq + 1 AND b.arr < a.dep UNION ALL SELECT 'stops', count(*) FROM stops UNION ALL SELECT 'calls', count(*) FROM stop_times"""))
def quality_gates(spark, sf_dir):
    st, s = t.stop_times(spark, sf_dir), t.stops(spark, sf_dir)
    gate = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("gate"), "n")
    w = Window.partitionBy("trip").orderBy("seq")
    bare = t.read(spark, sf_dir, "orders").join(t.trips(spark, sf_dir).select(F.col("trip").alias("o_orderkey")), "o_orderkey", "left_anti")
    back = st.withColumn("last", F.lag("dep").over(w)).where("arr < last")
    return gate("trips without calls", bare).union(gate("calls at unknown stops", st.join(s, "stop", "left_anti"))).union(gate("times out of order", back)).union(gate("stops", s)).union(gate("calls", st))

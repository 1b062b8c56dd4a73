"""Journeys over the timetable: earliest arrivals, arrive-by, skylines, itineraries, corridors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators import alerts, alike, itineraries, journeys, spatial
from wayline.operators import patterns as pat
from wayline.operators.tables import cut, tasks
from wayline.plans import transit as t
from wayline.registry import query

ASKED_SQL = ", asked AS (SELECT s_suppkey AS q, s_suppkey AS stop, 21600 + s_suppkey * 11 % 24 * 1800 AS dep FROM supplier)"


def asked(spark, sf_dir):
    """A journey asked for at each stop, at a time of the morning or the day."""
    s = F.col("s_suppkey")
    return t.read(spark, sf_dir, "supplier").select(s.alias("q"), s.alias("stop"), (21600 + s * 11 % 24 * 1800).alias("dep"))


def day(spark, sf_dir):
    return t.stop_times(spark, sf_dir).where("service = 2")


ROUNDS = 4
AB = t.METRES.format(a="a.lat", b="a.lon", c="b.lat", d="b.lon")
WALKS = f""", walks AS (SELECT a.stop AS a, b.stop AS b, greatest(45, floor({AB}*1.15/1.45 + 0.5))::BIGINT AS seconds FROM stops a, stops b WHERE a.stop <> b.stop AND {AB} <= 800),
  day AS (SELECT * FROM stop_times WHERE service = 2),
  b0 AS (SELECT q, stop, min(arr) AS arr FROM (SELECT q, stop, dep AS arr FROM asked UNION ALL SELECT q, b, dep + seconds FROM asked JOIN walks ON a = stop) GROUP BY 1, 2), best0 AS (SELECT * FROM b0)"""
ROUND = """, r{k} AS (SELECT q.q, y.stop, min(y.arr) AS arr FROM b{j} q JOIN day x ON x.stop = q.stop AND x.dep >= q.arr + {slack} JOIN day y ON y.trip = x.trip AND y.seq > x.seq GROUP BY 1, 2),
  w{k} AS (SELECT q, stop, min(arr) AS arr FROM (SELECT * FROM r{k} UNION ALL SELECT q, b, arr + seconds FROM r{k} JOIN walks ON a = stop) GROUP BY 1, 2),
  b{k} AS (SELECT w.* FROM w{k} w LEFT JOIN best{j} o ON o.q = w.q AND o.stop = w.stop WHERE o.arr IS NULL OR w.arr < o.arr),
  best{k} AS (SELECT q, stop, min(arr) AS arr FROM (SELECT * FROM best{j} UNION ALL SELECT * FROM b{k}) GROUP BY 1, 2)"""
ALL_ROUNDS = WALKS + "".join(ROUND.format(k=k, j=k - 1, slack=120 if k > 1 else 0) for k in range(1, ROUNDS + 1))


@query(t.sql(f"{ASKED_SQL}{ALL_ROUNDS} " + " UNION ALL ".join(f"SELECT q, stop, {k} AS round, arr FROM b{k}" for k in range(1, ROUNDS + 1))))
def earliest_arrivals(spark, sf_dir):
    """Four rides, a walk before and after each. A boarding takes the next trip of each line at the stop, as the SQL's least over all trips of a first-in-first-out line."""
    return _arrivals(spark, sf_dir, _by_trip(day(spark, sf_dir)))


def _arrivals(spark, sf_dir, calls):
    """Earliest arrivals of the journeys asked for at all stops: found for those of each kind, told for all."""
    calls = cut(calls)
    nodes, walks = alike.places(t.stops(spark, sf_dir), calls)
    kinds, own = alike.asks(asked(spark, sf_dir), nodes, "dep")
    found = journeys.earliest_arrivals(calls, walks, kinds, rounds=ROUNDS, told=False)
    return alike.told(found.select("q", "stop", "round", "arr"), nodes, own, "dep")


LEGS_SQL = f"""{ASKED_SQL}{WALKS}{ROUND.format(k=1, j=0, slack=0)},
  got AS (SELECT b1.q, b1.stop, b1.arr AS reached, f.stop AS board_at, f.arr AS ready, x.trip, x.dep, y.stop AS off_at, y.arr AS off, w.b AS walked_to, w.seconds
    FROM b1 JOIN b0 f ON f.q = b1.q JOIN day x ON x.stop = f.stop AND x.dep >= f.arr JOIN day y ON y.trip = x.trip AND y.seq > x.seq LEFT JOIN (SELECT * FROM walks UNION ALL SELECT stop, stop, 0 FROM stops) w ON w.a = y.stop
    WHERE w.b = b1.stop AND y.arr + w.seconds = b1.arr)
  SELECT q, stop, max(reached) AS arr, count(*) > 0 AS ridden FROM got GROUP BY 1, 2"""


@query(t.sql(LEGS_SQL))
def journey_legs(spark, sf_dir):
    """Journeys of one ride, with their legs followed one by one: every leg begins where and not before the last one ends, walks take as long as the footpath says, the ride is that of a trip of the day, and the last leg ends at the stop at the time told. Journeys of one kind (``alike``) are followed once."""
    st = cut(day(spark, sf_dir))
    nodes, walks = alike.places(t.stops(spark, sf_dir), st)
    ask, own = alike.asks(asked(spark, sf_dir), nodes, "dep")
    found = cut(journeys.earliest_arrivals(_by_trip(st), walks, ask, rounds=1).select("q", "stop", F.col("arr").alias("told"), "legs"))
    n = tasks(spark, 2 * found.count())
    legs = found.repartition(n, "q").join(ask.select("q", F.col("stop").alias("start"), F.col("dep").alias("at")), "q").select("q", "stop", "told", "start", "at", F.size("legs").alias("n"), "legs", F.posexplode("legs").alias("i", "leg"))
    before = F.get("legs", F.col("i") - 1)
    joined = (F.col("leg.board") == F.coalesce(before["alight"], F.col("start"))) & (F.col("leg.dep") >= F.coalesce(before["arr"], F.col("at")))
    last = (F.col("i") < F.col("n") - 1) | ((F.col("leg.alight") == F.col("stop")) & (F.col("leg.arr") == F.col("told")))
    legs = legs.where(joined & last).select("q", "stop", "told", "n", "leg.*")
    on, off = (st.select("trip", F.col("stop").alias(s), c).repartition(n, "trip", s, c).distinct() for s, c in (("board", "dep"), ("alight", "arr")))
    rides = legs.where("trip is not null").repartition(n, "trip", "board", "dep").join(on, ["trip", "board", "dep"]).repartition(n, "trip", "alight", "arr").join(off, ["trip", "alight", "arr"])
    feet = legs.where("trip is null").withColumn("seconds", F.col("arr") - F.col("dep")).repartition(n, "board", "alight", "seconds").join(walks.select(F.col("a").alias("board"), F.col("b").alias("alight"), "seconds"), ["board", "alight", "seconds"])
    good = rides.select("q", "stop", "told", "n", "trip").unionByName(feet.select("q", "stop", "told", "n", "trip")).repartition(n, "q", "stop")
    held = good.groupBy("q", "stop", "told", "n").agg(F.count("*").alias("held"), F.count("trip").alias("rides")).where("held = n").select("q", "stop", F.col("told").alias("arr"), (F.col("rides") == 1).alias("ridden"))
    return alike.told(held, nodes, own, "dep")


def _by_trip(st):
    """Calls by chains of trips that never overtake one another."""
    return pat.chained(st)


FAST = """, fast AS (SELECT trip, route, service, seq, stop, dep - d - 20 AS arr, dep - d AS dep FROM (SELECT *, CASE WHEN trip % 3 = 0 THEN seq * 80 WHEN trip % 7 = 0 THEN seq * -300 ELSE 0 END AS d FROM stop_times))"""


def fast(spark, sf_dir):
    """The timetable with trips that overtake others of their line, and some that crawl."""
    k = F.when(F.col("trip") % 3 == 0, F.col("seq") * 80).when(F.col("trip") % 7 == 0, F.col("seq") * -300).otherwise(0)
    return t.stop_times(spark, sf_dir).select("trip", "route", "service", "seq", "stop", (F.col("dep") - k - 20).alias("arr"), (F.col("dep") - k).alias("dep"))


@query(t.sql(f"{FAST}{ASKED_SQL}{ALL_ROUNDS.replace('FROM stop_times WHERE', 'FROM fast WHERE')} " + " UNION ALL ".join(f"SELECT q, stop, {k} AS round, arr FROM b{k}" for k in range(1, ROUNDS + 1))))
def overtaking_arrivals(spark, sf_dir):
    """Earliest arrivals where trips overtake: the SQL takes the least over all trips."""
    return _arrivals(spark, sf_dir, pat.chained(fast(spark, sf_dir).where("service = 2")))


SPAN = 3600
RANGE = f"""{FAST}, walks AS (SELECT a.stop AS a, b.stop AS b, greatest(45, floor({AB}*1.15/1.45 + 0.5))::BIGINT AS seconds FROM stops a, stops b WHERE a.stop <> b.stop AND {AB} <= 800),
  day AS (SELECT * FROM fast WHERE service = 2), asked AS (SELECT s_suppkey AS q, s_suppkey AS stop, 21600 + s_suppkey * 11 % 24 * 1800 AS first FROM supplier),
  a0 AS (SELECT q, stop, first, 0 AS walk FROM asked UNION ALL SELECT q, b, first, seconds FROM asked JOIN walks ON a = stop),
  c1 AS (SELECT q, x.trip, x.seq, x.dep - walk AS leaves FROM a0 JOIN day x ON x.stop = a0.stop AND x.dep - walk BETWEEN first AND first + {SPAN})"""
RANGE_ROUND = """, r{k} AS (SELECT c.q, y.stop, leaves, min(y.arr) AS arr FROM c{k} c JOIN day y ON y.trip = c.trip AND y.seq > c.seq GROUP BY 1, 2, 3),
  t{k} AS (SELECT q, stop, leaves, min(arr) AS arr FROM (SELECT * FROM r{k} UNION ALL SELECT q, b, leaves, arr + seconds FROM r{k} JOIN walks ON a = stop) GROUP BY 1, 2, 3),
  c{n} AS (SELECT DISTINCT q, x.trip, x.seq, leaves FROM t{k} JOIN day x ON x.stop = t{k}.stop AND x.dep >= t{k}.arr + 120)"""
RANGE_ROUNDS = 3
RANGE += "".join(RANGE_ROUND.format(k=k, n=k + 1) for k in range(1, RANGE_ROUNDS + 1))
RANGE += ", every AS (" + " UNION ALL ".join(f"SELECT q, stop, {k} AS round, leaves, arr FROM t{k}" for k in range(1, RANGE_ROUNDS + 1)) + ")"


@query(t.sql(RANGE + """ SELECT q, stop, round, leaves AS dep, arr FROM every e WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.q = e.q AND o.stop = e.stop AND o.round <= e.round AND o.leaves >= e.leaves AND o.arr <= e.arr AND (o.round < e.round OR o.leaves > e.leaves OR o.arr < e.arr))"""))
def range_journeys(spark, sf_dir):
    """All journeys worth taking within an hour from each stop, on the timetable with overtaking. The SQL takes every trip at every change and compares all pairs at the end."""
    s = F.col("s_suppkey")
    first = 21600 + s * 11 % 24 * 1800
    queries = t.read(spark, sf_dir, "supplier").select(s.alias("q"), s.alias("stop"), first.alias("first"), (first + SPAN).alias("last"))
    calls = cut(pat.chained(fast(spark, sf_dir).where("service = 2")))
    nodes, walks = alike.places(t.stops(spark, sf_dir), calls)
    kinds, own = alike.asks(queries, nodes, "first", "last")
    return alike.told(journeys.range_arrivals(calls, walks, kinds, rounds=RANGE_ROUNDS), nodes, own)


LATE = """, l{k} AS (SELECT q.q, x.stop, max(x.dep) AS dep FROM c{j} q JOIN day y ON y.stop = q.stop AND y.arr <= q.dep - {slack} JOIN day x ON x.trip = y.trip AND x.seq < y.seq GROUP BY 1, 2),
  v{k} AS (SELECT q, stop, max(dep) AS dep FROM (SELECT * FROM l{k} UNION ALL SELECT q, a, dep - seconds FROM l{k} JOIN walks ON b = stop) GROUP BY 1, 2),
  c{k} AS (SELECT v.* FROM v{k} v LEFT JOIN last{j} o ON o.q = v.q AND o.stop = v.stop WHERE o.dep IS NULL OR v.dep > o.dep),
  last{k} AS (SELECT q, stop, max(dep) AS dep FROM (SELECT * FROM last{j} UNION ALL SELECT * FROM c{k}) GROUP BY 1, 2)"""
LATEST = WALKS.split(",\n  b0 AS")[0] + """, c0 AS (SELECT q, stop, max(dep) AS dep FROM (SELECT q, stop, dep + 3600 AS dep FROM asked UNION ALL SELECT q, a, dep + 3600 - seconds FROM asked JOIN walks ON b = stop) GROUP BY 1, 2), last0 AS (SELECT * FROM c0)"""
LATEST += "".join(LATE.format(k=k, j=k - 1, slack=120 if k > 1 else 0) for k in range(1, ROUNDS + 1))


@query(t.sql(f"{ASKED_SQL}{LATEST} " + " UNION ALL ".join(f"SELECT q, stop, {k} AS round, dep FROM c{k}" for k in range(1, ROUNDS + 1))))
def latest_departures(spark, sf_dir):
    """Arrive by a time: the latest departure from every stop."""
    calls = cut(_by_trip(day(spark, sf_dir)))
    nodes, walks = alike.places(t.stops(spark, sf_dir), calls)
    kinds, own = alike.asks(asked(spark, sf_dir).select("q", "stop", (F.col("dep") + 3600).alias("arr")), nodes, "arr")
    found = journeys.latest_departures(calls, walks, kinds, rounds=ROUNDS)
    turned = alike.told(found.select("q", "stop", "round", (-F.col("dep")).alias("arr")), nodes, own.withColumn("arr", -F.col("arr")), "arr")
    return turned.select("q", "stop", "round", (-F.col("arr")).alias("dep"))


JOURNEYS_SQL = """j AS (SELECT o_custkey % 50 AS q, o_orderkey AS id, o_orderkey*97 % 7200 // 60 AS dep, o_orderkey*97 % 7200 // 60 + 20 + o_orderkey*31 % 90 AS arr, o_orderkey % 4 AS transfers FROM orders)"""


def _journeys(spark, sf_dir):
    k = F.col("o_orderkey")
    dep = F.floor(k * 97 % 7200 / 60)
    return t.read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("q"), k.alias("id"), dep.alias("dep"), (dep + 20 + k * 31 % 90).alias("arr"), (k % 4).alias("transfers"))


@query(f"WITH {JOURNEYS_SQL} SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM j o WHERE o.q = j.q AND o.dep >= j.dep AND o.arr <= j.arr AND o.transfers <= j.transfers AND (o.dep > j.dep OR o.arr < j.arr OR o.transfers < j.transfers))")
def skyline(spark, sf_dir):
    return journeys.skyline(_journeys(spark, sf_dir))


@query(f"""WITH {JOURNEYS_SQL}, a AS (SELECT q, id % 5 AS hub, dep*60 AS dep, arr*60 AS arr, transfers FROM j WHERE id % 2 = 0), once AS (SELECT id % 5 AS hub, dep*60 AS dep2, arr*60 AS arr2, transfers AS transfers2 FROM j WHERE id % 2 = 1), b AS (SELECT * FROM once UNION ALL SELECT hub, dep2 + 86400, arr2 + 86400, transfers2 FROM once)
  SELECT DISTINCT q, hub, dep, m.arr2 AS arr, transfers + 1 + m.transfers2 AS transfers FROM (SELECT a.q, a.hub, a.dep, a.arr, a.transfers, min({{'arr2': arr2, 'dep2': dep2, 'transfers2': transfers2}}) AS m FROM a JOIN b ON a.hub = b.hub AND b.dep2 >= a.arr + 300 GROUP BY ALL)""")
def joined_itineraries(spark, sf_dir):
    j = _journeys(spark, sf_dir)
    a = j.where("id % 2 = 0").select("q", (F.col("id") % 5).alias("hub"), (F.col("dep") * 60).alias("dep"), (F.col("arr") * 60).alias("arr"), "transfers")
    b = j.where("id % 2 = 1").select((F.col("id") % 5).alias("hub"), (F.col("dep") * 60).alias("dep2"), (F.col("arr") * 60).alias("arr2"), F.col("transfers").alias("transfers2"))
    return journeys.joined_itineraries(a, b).distinct()


@query(t.sql("""SELECT a.trip, a.route, a.dep, b.arr, b.arr - a.dep AS ride FROM stop_times a JOIN stop_times b ON a.trip = b.trip AND a.seq < b.seq WHERE a.service = 2 AND a.stop IN (5, 12, 40) AND b.stop IN (19, 26, 54) AND a.dep >= 28800
  QUALIFY row_number() OVER (PARTITION BY a.trip ORDER BY b.arr, a.dep DESC) = 1"""))
def leg_alternatives(spark, sf_dir):
    """Trips that can stand in for a leg: they call at a boarding stop, then at an alighting stop; of each the best way."""
    st = day(spark, sf_dir)
    on = st.where(F.col("stop").isin(5, 12, 40) & (F.col("dep") >= 28800)).select("trip", "route", F.col("seq").alias("i"), "dep")
    off = st.where(F.col("stop").isin(19, 26, 54)).select("trip", F.col("seq").alias("j"), "arr")
    met = on.join(off, "trip").where("i < j")
    best = met.groupBy("trip", "route").agg(F.min(F.struct("arr", (-F.col("dep")).alias("late"))).alias("x"))
    return best.select("trip", "route", (-F.col("x.late")).alias("dep"), "x.arr", (F.col("x.arr") + F.col("x.late")).alias("ride"))


@query(t.sql(""", p AS (SELECT DISTINCT route || ':' || array_to_string(stops, '>') AS pattern, stops FROM trip_rows), c AS (SELECT s.stop AS a, (s.stop + 14) % (SELECT count(*) FROM stops) AS b FROM stops s),
  m AS (SELECT a, b, pattern, stops, i, j FROM (SELECT a, b, pattern, stops, list_position(stops, a) AS i, list_position(stops, b) AS j FROM p, c WHERE list_contains(stops, a) AND list_contains(stops, b)) WHERE i < j)
  SELECT a, b, pattern, array_to_string(stops[i:j], '>') AS stops FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY j - i, pattern) = 1"""))
def corridors(spark, sf_dir):
    rows = pat.trip_rows(t.stop_times(spark, sf_dir)).select(F.concat(F.col("route").cast("string"), F.lit(":"), pat.pattern_key(F.col("stops"))).alias("pattern"), "stops").distinct()
    s = t.stops(spark, sf_dir)
    pairs = s.crossJoin(F.broadcast(s.agg(F.count("*").alias("n")))).select(F.col("stop").alias("a"), ((F.col("stop") + 14) % F.col("n")).alias("b"))
    return alerts.corridor(rows, pairs).select("a", "b", "pattern", pat.pattern_key(F.col("stops")).alias("stops"))


@query(t.sql("SELECT trip, array_to_string(stops[2:4], ',') AS part, array_to_string(list_transform(deps[2:4], lambda d: d + coalesce(delay, 0)), ',') AS deps, delay FROM trip_rows LEFT JOIN (SELECT user_id AS trip, (max(event_id) % 900)::BIGINT AS delay FROM events GROUP BY 1) USING (trip) WHERE len(stops) >= 3"))
def leg_slices(spark, sf_dir):
    """The second to fourth call of each trip, moved by its live delay; null where that is unknown."""
    delays = t.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trip")).agg((F.max("event_id") % 900).alias("delay"))
    st = journeys.with_delays(t.stop_times(spark, sf_dir), delays)
    rows = st.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "stop", "live_dep"))).alias("c"), F.max("delay").alias("delay")).where(F.size("c") >= 3)
    part = F.slice("c", 2, 3)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("trip", text(part["stop"]).alias("part"), text(part["live_dep"]).alias("deps"), "delay")


WEIGHED = """w AS (SELECT q, id, (id*31 % 90)*60 AS arr, transfers, id*17 % 1200 AS walk, (id*31 % 90)*60 + transfers*300 + (id*17 % 1200) // 2 + id*13 % 200 AS cost, (id % 211)::VARCHAR AS chain, (id % 9)::VARCHAR AS combo FROM j)"""
BEATS = "o.q = x.q AND o.arr <= x.arr AND o.transfers <= x.transfers AND o.walk <= x.walk + 30 AND o.cost <= x.cost AND (o.arr < x.arr OR o.transfers < x.transfers OR o.cost < x.cost OR o.walk < x.walk - 30)"


def weighed(spark, sf_dir):
    """Journeys with a walk and a cost."""
    k, j = F.col("id"), _journeys(spark, sf_dir)
    arr, walk = k * 31 % 90 * 60, k * 17 % 1200
    return j.select("q", "id", arr.alias("arr"), "transfers", walk.alias("walk"), (arr + F.col("transfers") * 300 + F.floor(walk / 2) + k * 13 % 200).alias("cost"), (k % 211).cast("string").alias("chain"), (k % 9).cast("string").alias("combo"))


@query(f"WITH {JOURNEYS_SQL}, {WEIGHED} SELECT q, id, arr, transfers, walk, cost FROM w x WHERE NOT EXISTS (SELECT 1 FROM w o WHERE {BEATS})")
def weighed_skyline(spark, sf_dir):
    """Four criteria, walks within half a minute alike."""
    return itineraries.weighed_skyline(weighed(spark, sf_dir)).select("q", "id", "arr", "transfers", "walk", "cost")


@query(f"""WITH {JOURNEYS_SQL}, {WEIGHED}, one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY q, chain ORDER BY cost, transfers, arr, id) = 1), s AS (SELECT * FROM one x WHERE NOT EXISTS (SELECT 1 FROM one o WHERE {BEATS})),
  r AS (SELECT *, row_number() OVER (PARTITION BY q, combo ORDER BY cost, transfers, arr, chain) AS line, row_number() OVER (PARTITION BY q ORDER BY arr, cost, transfers, chain) AS early FROM s),
  p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cost, transfers, arr, chain) AS place FROM r WHERE line <= 3),
  t AS (SELECT q, id, arr, cost, place FROM p WHERE place <= 12), m AS (SELECT r.* FROM r WHERE early = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.q = r.q AND t.id = r.id))
  SELECT q, id, arr, cost, place::INT AS place FROM t WHERE place < 12 OR q NOT IN (SELECT q FROM m) UNION ALL SELECT q, id, arr, cost, least(12, 1 + (SELECT count(*) FROM t WHERE t.q = m.q))::INT FROM m""")
def boarded_choices(spark, sf_dir):
    """What riders inside a vehicle are offered."""
    return itineraries.boarded_choice(weighed(spark, sf_dir)).select("q", "id", "arr", "cost", "place")


CHAINS = f""", walks AS (SELECT a.stop AS a, b.stop AS b, greatest(45, floor({AB}*1.15/1.45 + 0.5))::BIGINT AS seconds FROM stops a, stops b WHERE a.stop <> b.stop AND {AB} <= 800),
  day AS (SELECT * FROM stop_times WHERE service = 2), lasts AS (SELECT trip, max(seq) AS seq FROM day GROUP BY 1),
  onto AS (SELECT x.trip, min({{'dep': y.dep, 'trip': y.trip}}).trip AS nxt FROM day x JOIN day y ON y.stop = x.stop AND y.dep >= x.arr + 120 JOIN lasts l ON l.trip = y.trip AND l.seq > y.seq WHERE x.seq > 1 GROUP BY 1),
  ch AS (SELECT a.trip AS c, a.trip AS t1, a.nxt AS t2, b.nxt AS t3 FROM onto a JOIN onto b ON b.trip = a.nxt),
  x AS (SELECT stop AS s, stop AS t, 0 AS w, 120 AS need FROM stops UNION ALL SELECT a, b, seconds, greatest(120, seconds + 60) FROM walks)"""


@query(t.sql(CHAINS + """ SELECT c, min((2*(b1.stop*37 % 400) - b1.dep + x1.w + x2.w + a3.arr + 2*(a3.stop*53 % 400))::DOUBLE) AS cost FROM ch JOIN day b1 ON b1.trip = t1 AND b1.dep - b1.stop*37 % 400 >= c*97 % 86400 - 300 JOIN day a1 ON a1.trip = t1 AND a1.seq > b1.seq
  JOIN x x1 ON x1.s = a1.stop JOIN day b2 ON b2.trip = t2 AND b2.stop = x1.t AND b2.dep >= a1.arr + x1.need JOIN day a2 ON a2.trip = t2 AND a2.seq > b2.seq
  JOIN x x2 ON x2.s = a2.stop JOIN day b3 ON b3.trip = t3 AND b3.stop = x2.t AND b3.dep >= a2.arr + x2.need JOIN day a3 ON a3.trip = t3 AND a3.seq > b3.seq AND a3.arr + a3.stop*53 % 400 <= 100000 GROUP BY 1"""))
def refined_chains(spark, sf_dir):
    """Journeys of three fixed trips, each the next one to leave from a stop of the one before: the best places to change. The SQL tries all places of all three."""
    st = cut(day(spark, sf_dir))
    last = st.groupBy("trip").agg(F.max("seq").alias("last"))
    onward = st.join(last, "trip").where("seq < last").groupBy("stop", "dep").agg(F.min(F.struct(F.col("dep").alias("at"), F.col("trip").alias("nxt"))).alias("x"))
    # of a stop the next departure after each time at which somebody is ready: one window, no pairs of calls
    ready = st.where("seq > 1").select("trip", "stop", (F.col("arr") + 120).alias("ready"))
    asks = ready.select("stop", F.col("ready").alias("dep")).distinct().withColumn("x", F.lit(None).cast(onward.schema["x"].dataType)).withColumn("asks", F.lit(True))
    after = Window.partitionBy("stop").orderBy(F.desc("dep")).rangeBetween(Window.unboundedPreceding, 0)
    found = onward.withColumn("asks", F.lit(False)).unionByName(asks).select("stop", F.col("dep").alias("ready"), "asks", F.min("x").over(after).alias("x")).where("asks and x is not null")
    onto = cut(ready.join(found, ["stop", "ready"]).groupBy("trip").agg(F.min("x").alias("x")).select("trip", "x.nxt"))
    two = onto.select(F.col("trip").alias("nxt"), F.col("nxt").alias("third"))
    c = F.col("trip")
    chains = onto.join(two, "nxt").select(c.alias("c"), (c * 97 % 86_400 - 300).alias("start"), F.lit(100_000).alias("cap"), F.array("trip", "nxt", "third").alias("trips"))
    chains = cut(chains)
    at = lambda i, k: chains.select("c", F.col("trips")[i].alias("trip")).join(st, "trip").select("c", "stop", (F.col("stop") * k % 400).alias("seconds")).distinct()
    walks = spatial.footpaths(t.stops(spark, sf_dir).join(st.select("stop").distinct(), "stop", "left_semi"))
    return journeys.refined_chains(chains, st, walks, at(0, 37), at(2, 53)).select("c", "cost")

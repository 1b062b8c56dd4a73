"""Destinations, frecency, tallies, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.clock import half_up, micro
from wayline.functions.scores import destination_score, faded, journey_cost, kind_priority, refund_share, transit_kind, usage_bonus, weight_bonus
from wayline.operators import patterns as pat
from wayline.operators import records as rec
from wayline.plans import transit as t
from wayline.registry import query

NOW = "2024-01-31 00:00:00"


@query(f"""WITH h AS (SELECT user_id, event_type, count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS week, max(ts) AS last FROM events GROUP BY 1, 2),
  s AS (SELECT *, floor(epoch_us(TIMESTAMP '{NOW}' - last) / 3600000000)::BIGINT AS hours, user_id % 3 = 0 AS saved FROM h),
  r AS (SELECT user_id, event_type, floor((4*week + 1.5*total + CASE WHEN saved THEN 10 ELSE 0 END + greatest(0.0::DOUBLE, 5 - hours/12.0::DOUBLE))*1e6 + 0.5)/1e6 AS score, total, last FROM s)
  SELECT user_id, event_type, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, total DESC, last DESC, event_type) AS rank FROM r QUALIFY rank <= 3""".replace("epoch_us(TIMESTAMP '2024-01-31 00:00:00' - last)", "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last))"))
def smart_destinations(spark, sf_dir):
    """Of each user the three best destinations (here event types) by use of the last week, all use, saving and recency."""
    now = F.lit(NOW).cast("timestamp")
    h = t.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= now - F.expr("interval 7 days")).alias("week"), F.max("ts").alias("last"))
    hours = F.floor((F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 3_600_000_000)
    rows = h.select("*", micro(destination_score(F.col("week"), F.col("total"), F.col("user_id") % 3 == 0, hours.cast("double"))).alias("score"))
    top = rec.top_of_each(rows, ["user_id"], [F.desc("score"), F.desc("total"), F.desc("last"), F.col("event_type")], 3)
    return top.select("user_id", "event_type", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT user_id, floor(24*u/(u + 4)*1e4 + 0.5)/1e4 AS bonus FROM (SELECT user_id, sum(pow(2.0::DOUBLE, -greatest(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts), 0)/(14*86400000.0::DOUBLE))) AS u FROM events GROUP BY 1)""")
def frecency(spark, sf_dir):
    age = F.unix_millis(F.lit(NOW).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))
    u = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(faded(F.lit(1), age)).alias("u"))
    return u.select("user_id", (F.floor(usage_bonus(F.col("u")) * 1e4 + 0.5) / 1e4).alias("bonus"))


@query("""SELECT o_custkey % 50 AS q, count(*) FILTER (WHERE o_totalprice > 250000) AS win, count(*) FILTER (WHERE o_totalprice BETWEEN 200000 AND 250000) AS tie, count(*) FILTER (WHERE o_totalprice < 200000) AS loss FROM orders GROUP BY 1""")
def win_tie_loss(spark, sf_dir):
    p = F.col("o_totalprice")
    return t.read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("q")).agg(F.count_if(p > 250000).alias("win"), F.count_if(p.between(200000, 250000)).alias("tie"), F.count_if(p < 200000).alias("loss"))


@query("""SELECT l_suppkey AS key, floor(sum(l_quantity*l_linenumber)/sum(l_linenumber)*1e4 + 0.5)/1e4 AS mean, floor(median(l_quantity) + 0.5)::BIGINT AS middle FROM lineitem GROUP BY 1""")
def weighted_means(spark, sf_dir):
    li = t.read(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("key")).agg((F.sum(F.col("l_quantity") * F.col("l_linenumber")) / F.sum("l_linenumber")).alias("m"), F.median("l_quantity").alias("d"))
    return g.select("key", (F.floor(F.col("m") * 1e4 + 0.5) / 1e4).alias("mean"), half_up(F.col("d")).alias("middle"))


KIND = "CASE WHEN rt = 0 THEN 'tram' WHEN rt = 1 THEN 'metro' WHEN rt = 2 THEN 'train' WHEN rt = 4 THEN 'ferry' WHEN rt IN (5,6,7) THEN 'cable' WHEN rt = 11 THEN 'trolleybus' WHEN rt = 3 OR num NOT BETWEEN 1 AND 33 THEN 'bus' ELSE 'tram' END"


@query(t.sql(f"""SELECT stop, arg_max(kind, p) AS kind FROM (SELECT DISTINCT stop, {KIND} AS kind FROM (SELECT stop, route % 13 AS rt, route * 3 AS num FROM stop_times)), (VALUES ('bus',0),('trolleybus',1),('cable',2),('ferry',3),('tram',4),('metro',5),('train',6)) v(k, p) WHERE k = kind GROUP BY 1"""))
def stop_kinds(spark, sf_dir):
    """Each stop by the weightiest kind that serves it."""
    st = t.stop_times(spark, sf_dir).select("stop", transit_kind(F.col("route") % 13, (F.col("route") * 3).cast("string")).alias("kind")).distinct()
    return st.groupBy("stop").agg(F.max_by("kind", kind_priority(F.col("kind"))).alias("kind"))


@query("""SELECT user_id, least(max(CASE WHEN event_type='click' THEN event_id END), max(CASE WHEN event_type='view' THEN event_id END), max(CASE WHEN event_type='signup' THEN event_id END)) AS until FROM events GROUP BY 1""")
def known_until(spark, sf_dir):
    """The least of several greatest, nulls left out."""
    most = lambda k: F.max(F.when(F.col("event_type") == k, F.col("event_id")))
    return t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.least(most("click"), most("view"), most("signup")).alias("until"))


@query("""SELECT user_id, event_id, eta FROM (SELECT user_id, event_id, (event_id*37 % 1800) AS eta FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY eta, event_id) = 1""")
def best_eta(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 1800).alias("eta"))
    return rec.one_of_each(e, ["user_id"], [F.col("eta"), F.col("event_id")]).select("user_id", "event_id", "eta")


@query(f"""SELECT event_type AS line, user_id, max(ts) AS seen FROM events GROUP BY 1, 2 HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY""")
def recent_lines(spark, sf_dir):
    m = t.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("line"), "user_id").agg(F.max("ts").alias("seen"))
    return m.where(F.col("seen") >= F.lit(NOW).cast("timestamp") - F.expr("interval 14 days"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 7200 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def repeated_use(spark, sf_dir):
    """Uses that follow one another within two hours are one."""
    return rec.within_repeats(t.read(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", 7200)


@query("""SELECT event_id FROM events WHERE user_id % 7 <> 0 AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 7 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 300)""")
def evicted_rows(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 7 == 0).alias("pinned"))
    return rec.evicted(e, "pinned", "ts", "event_id", 300).select("event_id")


@query("""SELECT event_id, CASE WHEN d >= 120 THEN 50 WHEN d >= 60 THEN 25 WHEN d >= 50 THEN 0 END AS percent, floor((300 + w + n*300.0::DOUBLE + u)*1e4 + 0.5)/1e4 AS cost FROM (SELECT event_id, event_id*7 % 200 AS d, event_id % 900 AS w, event_id % 4 AS n, value AS u FROM events)""")
def refunds_and_costs(spark, sf_dir):
    i = F.col("event_id")
    cost = journey_cost(F.lit(300), i % 900, i % 4, F.col("value"))
    return t.read(spark, sf_dir, "events").select("event_id", refund_share(i * 7 % 200).alias("percent"), (F.floor(cost * 1e4 + 0.5) / 1e4).alias("cost"))


@query(t.sql("SELECT stop, floor(least(12.0::DOUBLE, log10(n + 1)*4)*1e6 + 0.5)/1e6 AS bonus FROM (SELECT stop, count(*) AS n FROM stop_times GROUP BY 1)"))
def stop_bonus(spark, sf_dir):
    n = t.stop_times(spark, sf_dir).groupBy("stop").agg(F.count("*").alias("n"))
    return n.select("stop", micro(weight_bonus(F.col("n"))).alias("bonus"))


NEXT = ", k{b} AS (SELECT a.route, a.stop, min({{'dep': s.dep, 'trip': s.trip}}) AS x FROM k{a} a JOIN stop_times s ON s.route = a.route AND s.stop = a.stop AND s.dep >= a.x.dep + 180 GROUP BY 1, 2)"
SPACED = ", k1 AS (SELECT route, stop, min({'dep': dep, 'trip': trip}) AS x FROM stop_times GROUP BY 1, 2)" + "".join(NEXT.format(a=k, b=k + 1) for k in (1, 2, 3))


@query(t.sql(SPACED + " " + " UNION ALL ".join(f"SELECT route, stop, x.dep AS dep, x.trip AS trip FROM k{k}" for k in (1, 2, 3, 4))))
def spaced_departures(spark, sf_dir):
    """Of each line and stop at most four departures, three minutes apart, taken greedily in order of time."""
    st = t.stop_times(spark, sf_dir).select("route", "stop", "dep", "trip")
    return pat.spaced(st, ["route", "stop"], ["dep", "trip"], "dep", 4, 180)


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, count(*) AS n, floor(avg(l_quantity)*1e4 + 0.5)/1e4 AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '2002-09-02' GROUP BY 1, 2""")
def flag_summary(spark, sf_dir):
    """Beyond the timetable (an extra): totals by two flags; the date filter and five columns go to the scan."""
    li = t.read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2002-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), (F.floor(F.avg("l_quantity") * 1e4 + 0.5) / 1e4).alias("avg_qty"))


@query("""SELECT event_type, to_timestamp(floor(epoch(ts)/3600)*3600)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY ROLLUP (event_type, hour)""".replace("GROUP BY ROLLUP (event_type, hour)", "GROUP BY ROLLUP (event_type, to_timestamp(floor(epoch(ts)/3600)*3600)::TIMESTAMP)"))
def hourly_rollup(spark, sf_dir):
    """Beyond the reference (an extra): counts by type and hour with their totals."""
    e = t.read(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return e.rollup("event_type", "hour").agg(F.count("*").alias("n"))

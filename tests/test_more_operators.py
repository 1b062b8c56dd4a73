"""Journeys as segments, stations, tracking and news on small cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wayline.operators import itineraries as it
from wayline.operators import news, stations, tracking


def seg(kind, dep, arr, line=None, trip=None, metres=0.0, stops=0, board=None, alight=None):
    return (kind, line, trip, board, alight, dep, arr, metres, stops)


def frame(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], f"s {it.SEGMENTS}")


def test_segments(spark):
    walks = [seg("walk", 0, 10, metres=100.0), seg("walk", 10, 30, metres=50.0), seg("bus", 40, 90, "7", 1, stops=1), seg("walk", 90, 99, metres=400.0)]
    row = frame(spark, walks).select(it.merged_walks(F.col("s")).alias("m"), it.pointless(F.col("s")).alias("p"), it.combination(F.col("s")).alias("c"), it.moved(F.col("s"), F.create_map(F.lit(1).cast("bigint"), F.lit(5))).alias("d")).first()
    assert [(x["kind"], x["dep"], x["arr"], x["metres"]) for x in row["m"]] == [("walk", 0, 30, 150.0), ("bus", 40, 90, 0.0), ("walk", 90, 99, 400.0)]
    assert row["p"] is True and row["c"] == "7" and [x["dep"] for x in row["d"]] == [5, 15, 45, 95]
    assert frame(spark, []).select(it.merged_walks(F.col("s")).alias("m"), it.pointless(F.col("s")).alias("p")).first()["m"] == []
    arr = spark.createDataFrame([([1, 2, 3, 2],)], "s array<int>")
    part = lambda a, b: arr.select(it.slice_between(F.col("s"), F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert part(2, 2) == [2, 3, 2] and part(3, 1) is None and part(1, 3) == [1, 2, 3] and part(9, 1) is None
    assert spark.createDataFrame([([1, 1, 2, None, None, 1],)], "s array<int>").select(it.without_repeats(F.col("s")).alias("x")).first()["x"] == [1, 2, None, 1]


def test_chosen(spark):
    rows = [(1, d, a, n, [seg("bus", d, a, line, 1, stops=9)]) for d, a, n, line in [(0, 1000, 0, "7"), (60, 1010, 0, "7"), (600, 1500, 0, "7"), (0, 900, 3, "9"), (0, 900, 3, "9")]]
    j = spark.createDataFrame(rows, f"q long, dep long, arr long, transfers int, segments {it.SEGMENTS}")
    assert [(r["dep"], r["arr"]) for r in it.chosen(j).orderBy("place").collect()] == [(0, 1000), (600, 1500), (0, 900)]
    assert [(r["dep"], r["arr"]) for r in it.chosen(j, most=1).collect()] == [(0, 900)]
    w = spark.createDataFrame([(1, 0, 950)], "q long, dep long, seconds long")
    assert sorted(r["arr"] for r in it.with_walk_only(j, w).collect()) == [900, 900, 950]


def test_stations(spark):
    n = spark.createDataFrame([("Granica Wrocław - Oława (D7)",), ("Rynek",)], "n string").select(stations.fare_border(F.col("n")).alias("x")).collect()
    assert tuple(n[0]["x"]) == ("Wrocław", "Oława", "D7") and n[1]["x"] is None
    p = spark.createDataFrame([(1, 51.0, 17.0)], "p long, p_lat double, p_lon double")
    e = spark.createDataFrame([("a", 1, False, 51.0002, 17.0), ("b", 2, True, 51.00021, 17.0), ("c", 3, False, 51.000195, 17.0)], "entrance string, place int, step_free boolean, lat double, lon double")
    assert stations.best_entrance(p, e).first()["entrance"] == "b"
    s = spark.createDataFrame([(1, 51.0, 17.0), (2, 51.5, 17.5)], "stop long, lat double, lon double")
    f = spark.createDataFrame([("lift", 51.0001, 17.0), ("wc", 51.505, 17.505)], "kind string, lat double, lon double")
    a = spark.createDataFrame([(2, [(51.49, 17.49), (51.49, 17.52), (51.52, 17.52), (51.52, 17.49)])], "stop long, points array<struct<lat:double,lon:double>>")
    assert {r["stop"]: r["kinds"] for r in stations.amenities(s, f, a).collect()} == {1: ["lift"], 2: ["wc"]}
    rows = spark.createDataFrame([("g", 1, "a", "x"), ("g", 2, "a", "y"), ("g", 3, "b", "y"), ("g", 4, "c", "z"), ("h", 5, "a", "x")], "g string, i int, one string, other string")
    assert sorted(r["i"] for r in stations.deduped_in_order(rows, "i", "one", "other", ["g"]).collect()) == [1, 4, 5]
    t = spark.createDataFrame([("t", "A", "8308/9"), ("u", "A", "1")], "trip string, agency string, numbers string")
    known = spark.createDataFrame([("A", "8309", 3)], "agency string, number string, bits int")
    assert {r["trip"]: r["bits"] for r in stations.amenities_by_number(t, known).collect()} == {"t": 3, "u": None}
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or "/tmp/wayline-hubs")
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3)], "hub long, item long")
    assert stations.covering_hubs(c, passes=1) == [1, 2] and stations.covering_hubs(c, most=1) == [1]
    v = spark.createDataFrame([([("20240101", "20240131", False, [("a", 0, ["x"]), ("b", 50, ["wifi", "ac"])]), ("20240201", "20240228", True, [("c", 70, ["ac"])])],)], "v array<struct<start:string,end:string,current:boolean,cars:array<struct<kind:string,seats:int,amenities:array<string>>>>>")
    got = lambda d: v.select(stations.composition_summary(stations.composition_on(F.col("v"), F.lit(d))).alias("x")).first()["x"]
    assert tuple(got("20240110")) == (["ac", "wifi"], 50, 1) and got("20250101")["seats"] == 70
    assert spark.range(1).select(stations.model_class(F.lit("Moderus Beta"), [("(?i)beta", "low"), ("Moderus", "tram")]).alias("x")).first()["x"] == "low"


def test_tracking(spark):
    fixes = [("d", 0, 51.0, 17.0, 5.0), ("d", 10, 51.00001, 17.0, 5.0), ("d", 20, 52.0, 17.0, 5.0), ("d", 30, 51.001, 17.0, 5.0)]
    out = tracking.filtered_fixes(spark.createDataFrame(fixes, "device string, ts long, lat double, lon double, accuracy double")).orderBy("ts").collect()
    assert [r["used"] for r in out] == [True, True, False, True] and out[1]["f_lat"] == 51.0 and out[2]["f_lat"] == 51.0 and 51.0005 < out[3]["f_lat"] < 51.001
    path = spark.createDataFrame([("p", 0, 51.0, 17.0), ("p", 1, 51.001, 17.0), ("p", 2, 51.001, 17.002), ("p", 3, 51.001, 17.004)], "path string, i int, lat double, lon double")
    assert [(r["i"], round(r["turn"])) for r in tracking.turns(path).collect()] == [(1, 90)]
    rider = spark.createDataFrame([(1, 0.0, 51.0, 17.0)], "p long, heading double, p_lat double, p_lon double")
    cars = spark.createDataFrame([("a", "7", 0, 10.0, 51.0001, 17.0), ("b", "7", 0, 10.0, 51.0002, 17.0), ("c", "7", 1, 180.0, 51.0, 17.0), ("d", "8", 0, None, 51.0003, 17.0)], "vehicle string, line string, direction int, bearing double, lat double, lon double")
    assert sorted(r["vehicle"] for r in tracking.onboard_candidates(rider, cars).collect()) == ["a", "d"]
    saved = spark.createDataFrame([("home", 51.0, 17.0), ("work", 51.0001, 17.0)], "place string, lat double, lon double")
    assert tracking.nearest_saved(rider, saved, spark.createDataFrame([("home",)], "place string")).first()["place"] == "work"


def test_news(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert v(news.written_date(F.lit("od 12 marca 2024 r."))) == dt.date(2024, 3, 12) == v(news.written_date(F.lit("dnia 12.3.2024"))) == v(news.written_date(F.lit("x 2024-03-12")))
    assert v(news.written_date(F.lit("31.02.2024"))) is None and v(news.written_date(F.lit(None).cast("string"))) is None
    assert v(news.canonical(F.array(F.lit("RYNEK"), F.lit("x"), F.lit("rynek")), F.create_map(F.lit("rynek"), F.lit("Rynek")))) == ["Rynek", "x"]
    assert v(news.sanitized(F.lit(" A\n b !! see https://a.b/c  now ,, "))) == "A b! see now,"
    assert v(news.unknown_names(F.lit("Plac Nowy and Rynek"), F.lit("near Rynek"), F.array(F.lit("Dom")))) == ["Plac Nowy"]

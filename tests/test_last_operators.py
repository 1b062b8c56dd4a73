from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import codec, geometry
from wayline.operators import alerts, journeys, live, stations


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_codecs(spark):
    texts = ["", "a", "trip-1", "Łódź", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(codec.fnv1a(F.col("t")).alias("h"), codec.shard_of(F.col("t")).alias("s")).collect()
    assert [r["h"] for r in got] == [fnv(t.encode()) if t is not None else None for t in texts] and got[2]["s"] == fnv(b"trip-1") % 256
    legs = [(5, 1, 900, 28800, 30000), (2, 900, 3, 30100, 99999)]
    df = spark.createDataFrame([(legs,), ([],), (None,)], "l array<struct<trip:bigint,board:bigint,alight:bigint,dep:bigint,arr:bigint>>").select(codec.encode_journey(F.col("l")).alias("t"))
    out = df.select("t", codec.decode_journey(F.col("t")).alias("l")).collect()
    assert [tuple(x) for x in out[0]["l"]] == legs and out[1]["l"] == [] and out[2]["l"] is None and len(out[0]["t"]) < 40
    line = spark.createDataFrame([([(51.0, 17.0), (51.0, 17.2), (51.0, 17.4)],), ([],)], "p array<struct<lat:double,lon:double>>")
    m = line.select(geometry.midpoint(F.col("p")).alias("m")).collect()
    assert abs(m[0]["m"]["lon"] - 17.2) < 1e-9 and m[1]["m"] is None


def test_journey_parts(spark):
    calls = [(1, 1, 10, 100, 110), (1, 2, 11, 200, 210), (1, 3, 12, 300, 310), (2, 1, 12, 380, 390), (2, 2, 13, 480, 490), (2, 3, 14, 600, 610)]
    st = spark.createDataFrame(calls, "trip long, seq long, stop long, arr long, dep long")
    assert sorted(tuple(r) for r in journeys.boarded_queries(st, spark.createDataFrame([(7, 1, 1)], "q long, trip long, seq long")).collect()) == [(7, 11, 200), (7, 12, 300)]
    q = spark.createDataFrame([(1, 10, 50)], "q long, stop long, dep long")
    assert sorted(r["dep"] for r in journeys.departure_windows(q, [0, 300]).collect()) == [50, 350]
    walks = spark.createDataFrame([(11, 13, 30)], "a long, b long, seconds int")
    c = spark.createDataFrame([(1, 1, 1, 2, 3)], "c long, first long, from_seq long, second long, to_seq long")
    assert tuple(journeys.transfer_points(c, st, walks).first()) == (1, 12, 12, 90)
    assert tuple(journeys.transfer_points(c, st, walks, slack=100).first()) == (1, 11, 13, 260)
    kept = spark.createDataFrame([(1, "a", "7", 100), (2, "b", "8", 100), (3, "c", "9", 100)], "q long, key string, combo string, dep long")
    new = spark.createDataFrame([(1, "a", "7", 100), (2, "x", "8", 300), (2, "y", "8", 150), (3, "z", "1", 100)], kept.schema)
    assert {r["q"]: (r["decision"], r["key"]) for r in journeys.tracked(kept, new).collect()} == {1: ("keep", "a"), 2: ("switch", "y"), 3: ("none", None)}


def test_live_parts(spark):
    m = spark.createDataFrame([(1, 5, 300), (1, 6, 100)], "vehicle long, trip long, score int")
    assert {r["trip"]: r["score"] for r in live.with_previous(m, spark.createDataFrame([(1, 5)], "vehicle long, trip long")).collect()} == {5: 60, 6: 100}
    rows = spark.createDataFrame([([0, 60], [0, 100, 160, 400]), ([0, 60], [5]), ([0, 60], [0, 60])], "p array<bigint>, d array<bigint>")
    assert [r[0] and tuple(r[0]) for r in rows.select(live.best_window(F.col("p"), F.col("d"))).collect()] == [(0, 1), None, (0, 0)]


def test_station_parts(spark):
    p = spark.createDataFrame([(1, "1", 51.0001, 17.0, None), (1, "2", 51.0, 17.1, 0)], "stop long, key string, lat double, lon double, layer int")
    t = spark.createDataFrame([(51.0, 16.9999, 51.0, 17.0001, 0), (51.0, 17.0999, 51.0, 17.1001, 1)], "lat1 double, lon1 double, lat2 double, lon2 double, layer int")
    got = {r["key"]: r["bearing"] for r in stations.platform_bearings(p, t).collect()}
    assert set(got) == {"1"} and min(got["1"], 360 - got["1"]) < 1
    known = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "y")], "stop long, name string, code string")
    asked = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", None)], "id long, name string, code string")
    assert {r["id"]: r["stop"] for r in stations.resolved(asked, known, ["name", "code"]).collect()} == {1: 1, 2: None, 3: 3}


def test_stored_alerts(spark):
    rows = spark.createDataFrame([('{"id":"a","line":"7","valid_to":"2024-01-01 10:00:00"}',), ('{"version":2,"id":"b","lines":["1","2"],"resolved":true}',), ('{"title":"x"}',), ("no",), (None,)], "value string")
    got = {r["id"]: (r["lines"], r["resolved"], r["valid_to"] is not None) for r in alerts.parsed(rows).collect()}
    assert got == {"a": (["7"], False, True), "b": (["1", "2"], True, False)}

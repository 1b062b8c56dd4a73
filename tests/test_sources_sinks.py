from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wayline.sinks import tables
from wayline.sources import feeds
from wayline.sources import timetable_files as files


def put(path, name, text):
    (path / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(path / f"{name}.txt")


def test_timetable_files(spark, tmp_path):
    s = files.stops(files.read_file(spark, put(tmp_path, "stops", '﻿stop_id,stop_name,stop_lat,stop_lon\r\n1,"Plac ""Nowy"", 3",51.1,17\r\n2,Łąka,x,\r\n3,,1,1\r\n2,Łąka II,50,16\r\n\r\n'), "stops"))
    got = {r["stop_id"]: r for r in s.collect()}
    assert set(got) == {"1", "2"} and got["1"]["stop_name"] == 'Plac "Nowy", 3'
    assert got["2"]["stop_name"] == "Łąka II" and got["2"]["normalized_name"] == "laka ii" and got["2"]["stop_lat"] == 50.0
    r = files.routes(files.read_file(spark, put(tmp_path, "routes", "route_short_name,route_id,route_type\n,R1,\nA,R2,0\n"), "routes")).collect()
    assert sorted((x["route_id"], x["route_short_name"], x["route_type"]) for x in r) == [("R1", "R1", 3), ("R2", "A", 0)]
    st = files.stop_times(files.read_file(spark, put(tmp_path, "stop_times", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,25:10:00,,1,1\nT,8:00:00,8:01:00,2,1\nT,,,2,x\nT,,,,3\nU,,,2,4\n"), "stop_times"), spark.createDataFrame([("T",)], "trip_id string")).collect()
    assert [(x["trip_id"], x["seq"], x["stop_id"], x["arr"], x["dep"]) for x in st] == [("T", 1, "1", 90600, 90600)]
    c = files.calendar_dates(files.read_file(spark, put(tmp_path, "calendar_dates", "date,service_id,exception_type\n20240101,W,1\n20240102,W,9\n"), "calendar_dates")).collect()
    assert [tuple(x) for x in c] == [("W", "20240101", 1)]
    assert files.read_file(spark, str(tmp_path / "none.txt"), "calendar", required=False) is None
    with pytest.raises(ValueError, match="trip_id"):
        files.read_file(spark, put(tmp_path, "trips", "route_id,service_id\n1,2\n"), "trips")
    with pytest.raises(ValueError, match="incomplete"):
        files.complete({"stops": s, "trips": s.where("false")})
    sh = files.shapes(files.read_file(spark, put(tmp_path, "shapes", "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\nA,2,51,17\nA,1,50,16\n"), "shapes")).first()
    assert [tuple(p) for p in sh["points"]] == [(50.0, 16.0), (51.0, 17.0)]


def test_archive_in_force(spark):
    rows = spark.createDataFrame([("a", "20240101"), ("b", "20240201"), ("c", "20240301")], "name string, effective string")
    assert files.archive_in_force(rows, "20240210").first()["name"] == "b"
    assert files.archive_in_force(rows, "20230210").first()["name"] == "a"


def test_feeds(spark):
    osm = json.dumps({"elements": [{"type": "node", "id": 1, "lat": 51.0, "lon": 17.0, "tags": {"addr:street": "Long", "addr:housenumber": "3a", "name": "Shop", "shop": "yes"}}, {"type": "way", "id": 2, "center": {"lat": 51.1, "lon": 17.1}, "tags": {"amenity": "cafe", "name": "C"}}, {"type": "node", "id": 3, "lat": 10.0, "lon": 17.0, "tags": {"name": "far"}}]})
    e = feeds.map_elements(spark.createDataFrame([(osm,), ("no json",)], "value string"), (50, 16, 52, 18))
    assert sorted(r["osm_id"] for r in e.collect()) == ["node/1", "way/2"]
    assert [r["house"] for r in feeds.addresses(e).collect()] == ["3a"]
    assert sorted((r["kind"], r["category"]) for r in feeds.places(e, ["amenity", "shop"]).collect()) == [("amenity", "cafe"), ("shop", "yes")]
    rail = json.dumps({"timestamp": 1, "trip_updates": [{"trip_id": "x", "numbers": ["8308/9"], "stop_times": [{"stop_sequence": 1, "confirmed": True}, {"stop_sequence": 2, "confirmed": False}]}]})
    rows = feeds.rail_updates(spark.createDataFrame([(rail,)], "value string")).collect()
    assert sorted(r["number"] for r in rows) == ["8308", "8309"] and {(r["finished"], r["last_confirmed"]) for r in rows} == {(False, 1)}
    rss = "<rss><item><title>Line 7 &amp; 8</title><link>http://a</link><description><![CDATA[<p>Closed</p>]]></description></item><item><title>B</title></item></rss>"
    assert [tuple(r) for r in feeds.news_items(spark.createDataFrame([(rss,)], "value string")).collect()] == [("Line 7 & 8", "http://a", "Closed"), ("B", "", "")]
    raw = spark.createDataFrame([(bytearray("Łódź".encode("iso-8859-2")),), (None,)], "b binary")
    assert [r[0] for r in raw.select(feeds.decoded(F.col("b"))).collect()] == ["Łódź", None]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    tables.replace(rows, path)
    tables.append(rows.where("id < 3").select((F.col("id") + 1000).alias("id"), "v"), path)
    tables.upsert(spark, spark.createDataFrame([(1, 7, 1), (1, 8, 2), (5000, 9, 1)], "id long, v long, n int"), path, ["id"], "n")
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 104 and got[1] == 8 and got[5000] == 9 and got[2] == 4
    m = tables.publish(rows, str(tmp_path / "p"), "id", 8)
    again = tables.publish(rows.orderBy(F.desc("id")), str(tmp_path / "q"), "id", 8)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect())) and m.agg(F.sum("rows")).first()[0] == 100

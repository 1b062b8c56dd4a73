"""Operators that SQL can't say, against plain loops; scalar functions against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import clock, codec, fuzzy, geometry, words
from wayline.operators import alerts, journeys, live, patterns, search, spatial


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clock(spark):
    assert value(spark, clock.seconds_of(F.lit("25:10:05"))) == 90605
    assert value(spark, clock.clock_text(F.lit(90605))) == "01:10"
    assert value(spark, clock.clock_text(F.lit(-60))) == "23:59"
    assert value(spark, clock.parse_clock(F.lit("47:59"))) == 172740 and value(spark, clock.parse_clock(F.lit("48:00"))) is None and value(spark, clock.parse_clock(F.lit("8:61"))) is None
    assert value(spark, clock.wrapped_difference(F.lit(60), F.lit(86340))) == 120
    assert value(spark, clock.half_up(F.lit(-0.5))) == 0
    assert str(value(spark, clock.easter(F.lit(2038)))) == "2038-04-25"


def test_words(spark):
    w = lambda c: value(spark, c)
    assert w(words.normalized(F.lit(" Święta ŁĄKA "))) == "swieta laka"
    assert w(words.title_case(F.lit("plac (nowy)/stary-dom"))) == "Plac (Nowy)/Stary-Dom"
    assert w(words.pole_base(F.lit("Rynek 02"))) == "Rynek" and w(words.pole_base(F.lit("Long 3"))) == "Long 3" and w(words.pole_base(F.lit("Dom (4)"))) == "Dom"
    assert w(words.number_variants(F.lit("8308/9"))) == ["8308", "8309"] and w(words.number_variants(F.lit(None).cast("string"))) == []
    assert w(words.line_name(F.lit("linia 07 a"))) == "7A" and w(words.platform_key(F.lit("Peron IV"))) == "4"
    assert w(words.page_text(F.lit("<p>a&amp;b<script>x</script></p> c"))) == "a&b c"
    assert w(words.named_lines(F.lit("Line 7 and 145, not 77"), ["7", "145"])) == ["145", "7"]
    assert "plac" in w(words.with_synonyms(F.lit("pl"))) and w(words.with_synonyms(F.lit("x"))) == ["x"]
    assert w(words.trip_base(F.lit("12#3_20240101"))) == "12" and w(words.slug(F.lit("Łódź Główna!"))) == "lodz-glowna"


@pytest.mark.parametrize(("q", "n", "want"), [("Rynek", "rynek", 100), ("ryn", "Rynek", 96), ("pg", "Plac Grunwaldzki", 85), ("plac grunwaldzki", "Grunwaldzki Plac", 98), ("rynke", "Rynek", 74), ("zzz", "Rynek", 0), ("", "a", 0), ("dw wroclaw", "Wroclaw Dworzec", 98)])
def test_fuzzy(q, n, want):
    assert fuzzy.score(q, n) == want


def test_osa():
    assert fuzzy.osa("ca", "abc") == 3 and fuzzy.osa("ab", "ba") == 1 and fuzzy.osa("", "abc") == 3 and fuzzy.osa("kitten", "sitting") == 3


def test_lines_round_trip(spark):
    pts = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    df = spark.createDataFrame([(pts,), ([],), (None,)], "p array<struct<lat:double,lon:double>>")
    out = df.select(codec.encode_line(F.col("p")).alias("t")).select("t", codec.decode_line(F.col("t")).alias("p")).collect()
    assert out[0]["t"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and [tuple(x) for x in out[0]["p"]] == pts
    assert out[1]["p"] == [] and out[2]["t"] is None


def test_polyline(spark):
    line = [(51.0, 17.0), (51.001, 17.0000001), (51.002, 17.0), (51.002, 17.01)]
    df = spark.createDataFrame([(line, 51.001, 17.001), ([], 1.0, 1.0)], "p array<struct<lat:double,lon:double>>, lat double, lon double")
    a, b = df.select(geometry.simplify(F.col("p"), 5.0).alias("s"), geometry.project(F.col("p"), F.col("lat"), F.col("lon")).alias("j")).collect()
    assert [tuple(x) for x in a["s"]] == [line[0], line[2], line[3]] and b["s"] == [] and b["j"] is None
    assert abs(a["j"]["off"] - 70.05) < 0.2 and abs(a["j"]["along"] - 111.32) < 0.2
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    inside = spark.createDataFrame([(ring, 1.0, 1.0), (ring, 3.0, 1.0), (ring, None, 1.0)], "p array<struct<lat:double,lon:double>>, lat double, lon double")
    assert [r[0] for r in inside.select(geometry.inside(F.col("p"), F.col("lat"), F.col("lon"))).collect()] == [True, False, False]


def test_band_join_finds_all(spark):
    rng = np.random.default_rng(3)
    pts = [(int(i), float(54.5 + y), float(17 + x)) for i, (y, x) in enumerate(rng.uniform(0, 0.05, (150, 2)))]
    got = {(r["a"], r["b"]) for r in spatial.footpaths(spark.createDataFrame(pts, "stop long, lat double, lon double")).collect()}

    def far(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p != q and far(p, q) <= 800}


def test_fifo_and_spacing(spark):
    rows = [(1, 2, 10, [5, 6], [0, 100], [0, 100]), (1, 2, 11, [5, 6], [10, 90], [10, 90]), (1, 2, 12, [5, 6], [20, 120], [20, 120])]
    t = spark.createDataFrame(rows, "route long, service long, trip long, stops array<long>, arrs array<long>, deps array<long>")
    assert {r["trip"]: r["chain"] for r in patterns.fifo_groups(t).collect()} == {10: 0, 11: 1, 12: 0}
    rng = np.random.default_rng(1)
    deps = [(int(k), int(d), int(i)) for i, (k, d) in enumerate(zip(rng.integers(0, 5, 400), rng.integers(0, 3000, 400), strict=True))]
    got = {(r["k"], r["i"]) for r in patterns.spaced(spark.createDataFrame(deps, "k long, d long, i long"), ["k"], ["d", "i"], "d", 4, 180).collect()}
    want = set()
    for k in range(5):
        kept = []
        for _, d, i in sorted((x for x in deps if x[0] == k), key=lambda x: x[1:]):
            if len(kept) < 4 and all(abs(d - x) >= 180 for x in kept):
                kept.append(d)
                want.add((k, i))
    assert got == want


def test_smoothed(spark):
    rows = [("a", 0, 10.0), ("a", 15, 20.0), ("a", 45, 0.0), ("b", 3, 7.0)]
    out = {(r["k"], r["t"]): r["smooth"] for r in live.smoothed(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", "v").collect()}
    s1 = 10 + (1 - math.exp(-1)) * 10
    assert out["a", 0] == 10 and abs(out["a", 15] - s1) < 1e-9 and abs(out["a", 45] - (s1 - (1 - math.exp(-2)) * s1)) < 1e-9 and out["b", 3] == 7


def test_reference_order(spark):
    rows = [("q", 1, 90.0, 1), ("q", 2, 85.0, 9), ("q", 3, 70.0, 99)]
    out = {r["id"]: r["place"] for r in search.reference_order(spark.createDataFrame(rows, "q string, id long, score double, weight long")).collect()}
    assert out == {2: 0, 1: 1, 3: 2}


def test_grounding_and_names(spark):
    names = spark.createDataFrame([("Rynek",), ("Placc Nowy",), ("Nowhere",)], "name string")
    known = spark.createDataFrame([(1, "RYNEK"), (2, "Plac Nowy"), (3, "Rynek")], "stop long, stop_name string")
    got = {r["name"]: (r["stop"], r["score"]) for r in alerts.grounded(names, known, least=70.0).collect()}
    assert got["Rynek"] == (1, 100.0) and got["Placc Nowy"][0] == 2 and "Nowhere" not in got
    alert = spark.range(1).select(F.lit(None).cast(alerts.ALERT).alias("a"))
    assert alert.select(alerts.names_in(F.col("a")).alias("n")).first()["n"] == []


def chain(trip, route, stops, start, step=300):
    return [(trip, route, i + 1, s, start + i * step - 20, start + i * step) for i, s in enumerate(stops)]


def test_journeys(spark):
    calls = chain(1, 10, [1, 2, 3], 28800) + chain(2, 10, [1, 2, 3], 30000) + chain(3, 20, [4, 5], 30000) + chain(4, 30, [3, 6], 29700)
    st = spark.createDataFrame(calls, "trip long, route long, seq long, stop long, arr long, dep long")
    walks = spark.createDataFrame([(3, 4, 100), (4, 3, 100)], "a long, b long, seconds long")
    out = journeys.earliest_arrivals(st, walks, spark.createDataFrame([(1, 1, 28700)], "q long, stop long, dep long"), rounds=3).collect()
    best = {}
    for r in out:
        if r["stop"] not in best or r["arr"] < best[r["stop"]]["arr"]:
            best[r["stop"]] = r
    assert {k: v["arr"] for k, v in best.items()} == {2: 29080, 3: 29380, 4: 29480, 5: 30280, 6: 29980}
    legs = best[5]["legs"]
    assert [leg["trip"] for leg in legs if leg["trip"] is not None] == [1, 3] and best[5]["round"] == 2
    assert [(leg["board"], leg["alight"], leg["arr"] - leg["dep"]) for leg in legs if leg["trip"] is None] == [(3, 4, 100)]
    back = journeys.latest_departures(st, walks, spark.createDataFrame([(1, 5, 30280)], "q long, stop long, arr long"), rounds=2).collect()
    latest = {}
    for r in back:
        latest[r["stop"]] = max(latest.get(r["stop"], 0), r["dep"])
    assert latest[4] == 30000 and latest[3] == 29900 and latest[1] == 28800


def test_skyline(spark):
    rng = np.random.default_rng(8)
    rows = [(int(q), int(d), int(d + a), int(n)) for q, d, a, n in zip(rng.integers(0, 4, 300), rng.integers(0, 40, 300), rng.integers(5, 40, 300), rng.integers(0, 4, 300), strict=True)]
    got = sorted(map(tuple, journeys.skyline(spark.createDataFrame(rows, "q long, dep long, arr long, transfers long")).collect()))
    want = sorted(r for r in rows if not any(o[0] == r[0] and o[1] >= r[1] and o[2] <= r[2] and o[3] <= r[3] and o[1:] != r[1:] for o in rows))
    assert got == want


def test_joined_itineraries_wait_for_the_next_morning(spark):
    first = spark.createDataFrame([(1, 7, 28800, 32400, 0), (2, 7, 79200, 82800, 1), (3, 8, 0, 600, 0)], "q long, hub long, dep long, arr long, transfers long")
    second = spark.createDataFrame([(7, 61200, 64800, 0), (7, 64000, 64500, 2), (7, 32500, 33000, 0), (9, 1000, 2000, 0)], "hub long, dep2 long, arr2 long, transfers2 long")
    assert sorted(map(tuple, journeys.joined_itineraries(first, second).collect())) == [(1, 7, 28800, 64500, 3), (2, 7, 79200, 86400 + 33000, 2)]
    assert sorted(map(tuple, journeys.joined_itineraries(first, second, wrap=None).collect())) == [(1, 7, 28800, 64500, 3)]

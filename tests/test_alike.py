"""Searches over one stop and one query of each kind, told for all, against searches over every stop and query."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import alike, journeys, patterns, spatial, tables

KIND = "trip long, route long, service long, seq long, stop long, arr long, dep long"


@pytest.fixture(scope="module")
def town(spark):
    """Six places of stops with calls and without, one of only such, a stop of two places, one of none, and a stop with calls that no place is known of."""
    rng = random.Random(11)
    stops = [(s, 51.0 + s % 7 * 0.004, 17.0) for s in range(40)] + [(40, 51.0, 17.0), (40, 51.02, 17.0), (41, None, None)]
    rows = []
    for n in range(60):
        at = 30_000 + rng.randrange(0, 7_200, 60)
        for i, s in enumerate(rng.choice([(0, 2, 4), (5, 3, 1), (7, 10, 5), (4, 99, 0), (2, 0)])):
            rows.append((n, s, 1, i, s, at, at))
            at += rng.choice([200, 400])
    rows = [(n, rows[[r[0] for r in rows].index(n)][1], *rest) for n, _, *rest in rows]
    asked = [(q, q, 30_000 + q % 3 * 1_800) for q in range(42)] + [(50, 8, 30_000), (50, 15, 30_050), (50, 1, 31_000), (51, 77, 30_000), (52, 99, 30_000)]
    calls = patterns.chained(spark.createDataFrame(rows, KIND))
    return calls, spark.createDataFrame(stops, "stop long, lat double, lon double"), spark.createDataFrame(asked, "q long, stop long, dep long")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_earliest_and_latest(spark, town, monkeypatch):
    monkeypatch.setattr(tables, "SET", 2)
    calls, stops, asked = town
    walks = spatial.footpaths(stops).select("a", "b", "seconds")
    nodes, ways = alike.places(stops, calls)
    kinds, own = alike.asks(asked, nodes, "dep")
    assert kinds.select("q").distinct().count() < 40 and ways.count() < walks.count() / 2
    want = told(journeys.earliest_arrivals(calls, walks, asked, rounds=3, told=False).select("q", "stop", "round", "arr"))
    found = journeys.earliest_arrivals(calls, ways, kinds, rounds=3, told=False).select("q", "stop", "round", "arr")
    assert len(want) > 500 and told(alike.told(found, nodes, own, "dep")) == want
    by = asked.select("q", "stop", (F.col("dep") + 3_600).alias("arr"))
    want = told(journeys.latest_departures(calls, walks, by, rounds=3).select("q", "stop", "round", (-F.col("dep")).alias("arr")))
    kinds, own = alike.asks(by, nodes, "arr")
    found = journeys.latest_departures(calls, ways, kinds, rounds=3).select("q", "stop", "round", (-F.col("dep")).alias("arr"))
    assert len(want) > 500 and told(alike.told(found, nodes, own.withColumn("arr", -F.col("arr")), "arr")) == want


def test_range(spark, town, monkeypatch):
    monkeypatch.setattr(tables, "SET", 2)
    calls, stops, asked = town
    queries = asked.select("q", "stop", F.col("dep").alias("first"), (F.col("dep") + 2_400).alias("last"))
    want = told(journeys.range_arrivals(calls, spatial.footpaths(stops), queries, rounds=2))
    nodes, ways = alike.places(stops, calls)
    kinds, own = alike.asks(queries, nodes, "first", "last")
    found = journeys.range_arrivals(calls, ways, kinds, rounds=2)
    assert found.count() < len(want) / 2 and told(alike.told(found, nodes, own)) == want


def test_rides_back_before_the_walk(spark):
    """A ride back to the place of the start beats the walk to another stop there, but not being at one's own stop."""
    calls = spark.createDataFrame([(1, "l", 0, 9, 100, 100), (1, "l", 1, 8, 110, 110)], "trip long, route string, seq long, stop long, arr long, dep long")
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (8, 8), (9, 9)], "stop long, node long")
    ways = spark.createDataFrame([(1, 1, 45), (1, 9, 5), (9, 1, 5), (8, 1, 5), (1, 8, 90)], "a long, b long, seconds long")
    asked = spark.createDataFrame([(q, q, 90) for q in (1, 2)] + [(7, 1, 120), (7, 2, 90)], "q long, stop long, dep long")
    kinds, own = alike.asks(asked, nodes, "dep")
    found = journeys.earliest_arrivals(calls, ways, kinds, rounds=1, told=False).select("q", "stop", "arr")
    assert told(alike.told(found, nodes, own, "dep")) == [(1, 2, 115), (1, 3, 115), (1, 8, 110), (2, 1, 115), (2, 3, 115), (2, 8, 110), (7, 1, 115), (7, 3, 115), (7, 8, 110)]

"""Joins by distance anywhere on the globe, names with typing errors, journeys with their legs: against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wayline.functions import fuzzy
from wayline.operators import alerts, journeys, live, patterns, search, spatial


def far(p, q):
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize(("lat", "lon", "span"), [(0.0, 10.0, 0.03), (75.0, 17.0, 0.04), (-68.9, 179.99, 0.03), (89.99, 0.0, 180.0), (51.1, -180.0, 0.02)])
def test_pairs_within_a_distance_anywhere(spark, lat, lon, span):
    rng = np.random.default_rng(3)
    pts = [(int(i), float(min(90.0, lat + y)), float((lon + x + 540) % 360 - 180)) for i, (y, x) in enumerate(np.column_stack([rng.uniform(-0.01, 0.01, 120), rng.uniform(-span, span, 120)]))]
    got = {(r["a"], r["b"]) for r in spatial.footpaths(spark.createDataFrame(pts, "stop long, lat double, lon double")).collect()}
    want = {(p[0], q[0]) for p in pts for q in pts if p != q and far(p, q) <= 800}
    assert got == want and want


def words(rng, n):
    out = []
    for _ in range(n):
        k = int(rng.integers(1, 4))
        out.append(" ".join("".join(rng.choice(list("abcdr"), int(rng.integers(1, 9)))) for _ in range(k)))
    return out


def mistyped(rng, name):
    c = list(name)
    for _ in range(int(rng.integers(0, 3))):
        i = int(rng.integers(len(c)))
        kind = int(rng.integers(4))
        if kind == 0:
            c[i] = "x"
        elif kind == 1:
            c.insert(i, "y")
        elif kind == 2 and len(c) > 1:
            del c[i]
        elif i + 1 < len(c):
            c[i], c[i + 1] = c[i + 1], c[i]
    return "".join(c).strip() or "a"


def test_search_finds_all_that_score(spark):
    rng = np.random.default_rng(5)
    names = words(rng, 300) + ["Plac Grunwaldzki", "Rynek", "Dworzec Główny", "", "  ", "(x)"]
    rows = [(i, n, i % 7) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, weight long").cache()
    for q in ["rynke", "pg", "dw glowny", "", ".", "grunwalzdki plac", *(mistyped(rng, names[i]) for i in range(12))]:
        want = sorted(((-fuzzy.score(q, n), -w, i) for i, n, w in rows if fuzzy.score(q, n) > 0))[:15]
        assert [(-r["score"], -r["weight"], r["id"]) for r in search.search(df, q).collect()] == want, q


def test_grounding_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    known = [(i, n) for i, n in enumerate(words(rng, 250) + ["Plac Nowy", "Aleja Bema", "al Dworcowa", "Dworzec"])]
    asked = sorted({mistyped(rng, n) for _, n in known[::2]} | {"PLAC nowy", "pl nowy", "aleje bema", "an", "xlac nowy", "dworcowa"})
    for least in (60.0, 80.0):
        got = {r["name"]: (r["stop"], r["score"]) for r in alerts.grounded(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(known, "stop long, stop_name string"), least).collect()}
        want = {}
        for a in asked:
            best = min(((-fuzzy.score(a, n), s) for s, n in known), default=None)
            if best and -best[0] >= least:
                want[a] = (best[1], -best[0])
        assert got == want


def test_repeated_rows_keep_their_nearest(spark):
    a = spark.createDataFrame([(1, 100), (1, 100)], "k long, at long")
    b = spark.createDataFrame([(1, 130), (1, 86390)], "k long, o long")
    assert [r["o"] for r in live.nearest_in_time(a, b, "k", "at", "o", 600).collect()] == [130, 130]


def plain_journeys(calls, walks, q, rounds, change=120):
    """Earliest arrivals by trying every trip and walk."""
    trips = {}
    for trip, _, seq, stop, arr, dep in calls:
        trips.setdefault(trip, []).append((seq, stop, arr, dep))
    at = {q[1]: q[2]}
    for a, b, s in walks:
        if a == q[1]:
            at[b] = min(at.get(b, 1 << 60), q[2] + s)
    best, out = dict(at), {}
    for r in range(1, rounds + 1):
        new = {}
        for stops in trips.values():
            for seq, stop, _, dep in stops:
                if stop in at and dep >= at[stop] + (change if r > 1 else 0):
                    for seq2, stop2, arr2, _ in stops:
                        if seq2 > seq:
                            new[stop2] = min(new.get(stop2, 1 << 60), arr2)
        for a, b, s in walks:
            if a in new:
                new.setdefault(b, 1 << 60)
        reached = dict(new)
        for a, b, s in walks:
            if new.get(a, 1 << 60) < 1 << 60:
                reached[b] = min(reached[b], new[a] + s)
        at = {s: t for s, t in reached.items() if t < best.get(s, 1 << 60)}
        best |= at
        out |= {(s, r): t for s, t in at.items()}
    return out


def test_journeys_and_their_legs(spark):
    rng = np.random.default_rng(6)
    calls, route_of = [], {}
    for trip in range(60):
        route = trip % 6
        line = np.random.default_rng(route).permutation(12)[:5]
        t = int(rng.integers(0, 80_000))
        for seq, stop in enumerate(line):
            calls.append((trip, route, seq, int(stop), t + seq * 300, t + seq * 300 + 20))
        route_of[trip] = route
    walks = [(0, 1, 200), (1, 0, 200), (5, 9, 400), (9, 5, 400)]
    asked = [(1, 0, 20_000), (2, 7, 70_000), (3, 11, 0)]
    st = spark.createDataFrame(calls, "trip long, route long, seq long, stop long, arr long, dep long")
    w = spark.createDataFrame(walks, "a long, b long, seconds long")
    got = journeys.earliest_arrivals(st, w, spark.createDataFrame(asked, "q long, stop long, dep long"), rounds=4).collect()
    for q in asked:
        assert {(r["stop"], r["round"]): r["arr"] for r in got if r["q"] == q[0]} == plain_journeys(calls, walks, q, 4)
    by = {(c[0], c[3]): c for c in calls}
    for r in got:
        _, stop, now = next(q for q in asked if q[0] == r["q"])
        for leg in r["legs"]:
            assert leg["board"] == stop and leg["dep"] >= now
            if leg["trip"] is None:
                assert (leg["board"], leg["alight"], leg["arr"] - leg["dep"]) in walks
            else:
                assert by[leg["trip"], leg["board"]][5] == leg["dep"] and by[leg["trip"], leg["alight"]][4] == leg["arr"] and by[leg["trip"], leg["board"]][2] < by[leg["trip"], leg["alight"]][2]
            stop, now = leg["alight"], leg["arr"]
        assert (stop, now) == (r["stop"], r["arr"]) and sum(x["trip"] is not None for x in r["legs"]) == r["round"]
    soon = journeys.earliest_arrivals(st, w, spark.createDataFrame(asked, "q long, stop long, dep long"), rounds=1, wait=600).collect()
    assert all(r["legs"][-1]["arr"] == r["arr"] for r in soon) and len(soon) < sum(r["round"] == 1 for r in got)
    assert journeys.earliest_arrivals(st, w, spark.createDataFrame([], "q long, stop long, dep long")).count() == 0


def test_fifo_over_many_batches(spark):
    rng = np.random.default_rng(9)
    rows = [(1, 2, i, [5, 6, 7], *([[int(x), int(x + a), int(x + a + 50)]] * 2)) for i, (x, a) in enumerate(zip(rng.integers(0, 5000, 300), rng.integers(10, 400, 300), strict=True))]
    t = spark.createDataFrame(rows, "route long, service long, trip long, stops array<long>, arrs array<long>, deps array<long>")
    got = {r["trip"]: r["chain"] for r in patterns.fifo_groups(t).collect()}
    last, want = [], {}
    for _, _, i, _, _, deps in sorted(rows, key=lambda r: (r[5][0], r[2])):
        k = next((k for k, d in enumerate(last) if all(a <= b for a, b in zip(d, deps, strict=True))), len(last))
        last[k : k + 1] = [deps]
        want[i] = k
    assert got == want

"""Nearest segments and crossings against plain loops, at poles and across 180 degrees too."""

from __future__ import annotations

import math
import random

from wayline.operators.segments import crossings, nearest_segment


def turn(a, b):
    return (b - a + 180) % 360 - 180


def metrics(p, s):
    wide = math.cos(math.radians(p[1])) * 111_320
    ax, ay = turn(p[2], s[2]) * wide, (s[1] - p[1]) * 111_320
    dx, dy = turn(s[2], s[4]) * wide, (s[3] - s[1]) * 111_320
    n = dx * dx + dy * dy
    t = 0 if n < 1e-6 else max(0, min(1, -(ax * dx + ay * dy) / n))
    off = math.hypot(ax + t * dx, ay + t * dy)
    askew = (1 - abs((dx * p[3] + dy * p[4]) / math.sqrt(n))) * 20 if n > 9 and p[3] is not None else 0
    return off, math.floor((off + s[5] + askew) * 1000 + 0.5) / 1000


def lines(rng, lat, lon, n, size):
    out = []
    for i in range(n):
        y, x = lat + rng.uniform(-0.01, 0.01), lon + rng.uniform(-0.02, 0.02)
        y2, x2 = y + rng.uniform(-size, size), x + rng.uniform(-size, size) / max(0.02, math.cos(math.radians(lat)))
        wrap = lambda v: (v + 180) % 360 - 180
        out.append((i, y, wrap(x), min(89.99, y2), wrap(x2), float(i % 3)))
    return out


def test_nearest_segment(spark):
    rng = random.Random(1)
    for lat, lon in ((51.1, 17.0), (0.0, 179.995), (-70.0, -180.0), (85.0, 10.0)):
        segs = lines(rng, lat, lon, 60, 0.004) + [(60, lat, (lon - 0.2 + 180) % 360 - 180, lat + 0.001, (lon + 0.2 + 180) % 360 - 180, 1.0), (61, lat, lon, lat, lon, 0.0)]
        pts = [(i, lat + rng.uniform(-0.01, 0.01), (lon + rng.uniform(-0.02, 0.02) + 180) % 360 - 180, *((None, None) if i % 3 == 0 else (math.sin(i), math.cos(i)))) for i in range(150)]
        df = spark.createDataFrame([*pts, (999, None, 1.0, 0.0, 1.0)], "p long, lat double, lon double, east double, north double")
        sf = spark.createDataFrame([*segs, (998, None, 1.0, 1.0, 1.0, 0.0)], "seg long, lat1 double, lon1 double, lat2 double, lon2 double, penalty double")
        want = {}
        for p in pts:
            near = [(m[1], s[0]) for s in segs if (m := metrics(p, s))[0] <= 120]
            if near:
                want[p[0]] = min(near)
        got = {r["p"]: (r["score"], r["seg"]) for r in nearest_segment(df, sf, 120.0).collect()}
        assert set(got) == set(want) and len(want) > 20
        assert all(abs(got[k][0] - want[k][0]) < 0.0011 for k in want)
        assert sum(got[k][1] == want[k][1] for k in want) >= len(want) - 1


def test_crossings_are_told_once(spark):
    rng = random.Random(2)
    for lat, lon in ((51.1, 17.0), (10.0, 179.999), (84.0, 0.0)):
        a, b = lines(rng, lat, lon, 50, 0.02), lines(rng, lat, lon, 50, 0.02)
        kind = "{} long, lat1 double, lon1 double, lat2 double, lon2 double"

        def side(p, q, r):
            return (r[1] - p[1]) * (q[0] - p[0]) - (q[1] - p[1]) * (r[0] - p[0])

        want = set()
        for s in a:
            for o in b:
                p, q = (0.0, s[1]), (turn(s[2], s[4]), s[3])
                r = (turn(s[2], o[2]), o[1])
                z = (r[0] + turn(o[2], o[4]), o[3])
                if side(p, q, r) * side(p, q, z) < 0 and side(r, z, p) * side(r, z, q) < 0:
                    want.add((s[0], o[0]))
        rows = crossings(spark.createDataFrame([x[:5] for x in a], kind.format("a")), spark.createDataFrame([x[:5] for x in b], kind.format("b"))).collect()
        got = [(r["a"], r["b"]) for r in rows]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
        assert all(-180 <= r["lon"] < 180 and abs(r["lat"] - lat) < 0.05 for r in rows)


def test_touching_and_equal_do_not_cross(spark):
    kind = "{} long, lat1 double, lon1 double, lat2 double, lon2 double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], kind.format("a"))
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.5, 1.0, 0.5), (3, -1.0, 0.25, 1.0, 0.25), (4, None, 0.0, 1.0, 1.0)], kind.format("b"))
    assert [(r["b"], r["lat"], r["lon"]) for r in crossings(a, b).collect()] == [(3, 0.0, 0.25)]
    assert crossings(a.limit(0), b).count() == 0

"""Chains of fixed trips against all places; fronts against all pairs."""

from __future__ import annotations

import itertools
import random

import pytest

from wayline.operators import itineraries, journeys


@pytest.mark.parametrize("legs", [1, 3, 4])
def test_refined_chains(spark, legs):
    rng = random.Random(legs)
    trips, rows = {}, []
    for t in range(40):
        at = 28_800 + (t % 5) * 900
        calls = []
        for i, s in enumerate(rng.sample(range(7), 5)):
            calls.append((i, s, at, at + 20))
            at += rng.choice([120, 240, 400])
        trips[t] = calls
        rows += [(t, *c) for c in calls]
    walks = {(a, b): rng.choice([50, 150]) for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.3}
    chains = [(c, 28_800, 28_800 + 9_000, [rng.choice([t for t in trips if t % 5 == min(k, 4)]) for k in range(legs)]) for c in range(25)]
    access = {(c, s): rng.choice([30, 300]) for c, *_ in chains for s in range(7) if rng.random() < 0.6}
    egress = {(c, s): rng.choice([30, 300]) for c, *_ in chains for s in range(7) if rng.random() < 0.6}

    def plain(c, start, cap, path):
        best = None
        states = [(2 * access[c, s] - d, i, ()) for i, s, _, d in trips[path[0]] if (c, s) in access and d - access[c, s] >= start]
        for k, t in enumerate(path):
            off = [(cost, (*places, (t, i, j)), s, a) for cost, i, places in states for j, s, a, _ in trips[t] if j > i]
            if k == len(path) - 1:
                ends = [cost + a + 2 * egress[c, s] for cost, _, s, a in off if (c, s) in egress and a + egress[c, s] <= cap]
                best = min(ends, default=None)
            else:
                states = []
                for cost, places, s, a in off:
                    for i, to, _, d in trips[path[k + 1]]:
                        w = 0 if to == s else walks.get((s, to))
                        if w is not None and d >= a + (120 if to == s else max(120, w + 60)):
                            states.append((cost + w, i, places))
        return best

    df = journeys.refined_chains(
        spark.createDataFrame(chains, "c long, start long, cap long, trips array<long>"),
        spark.createDataFrame(rows, "trip long, seq long, stop long, arr long, dep long"),
        spark.createDataFrame([(*k, v) for k, v in walks.items()], "a long, b long, seconds long"),
        spark.createDataFrame([(*k, v) for k, v in access.items()], "c long, stop long, seconds long"),
        spark.createDataFrame([(*k, v) for k, v in egress.items()], "c long, stop long, seconds long"),
    )
    got = {r["c"]: r for r in df.collect()}
    want = {c[0]: x for c in chains if (x := plain(*c)) is not None}
    assert {c: r["cost"] for c, r in got.items()} == want and len(want) >= 3
    for c, _, _, path in chains:
        if c in got:
            told = got[c]["legs"]
            assert [x["trip"] for x in told] == path and all(x["board"] < x["alight"] for x in told)
            place = lambda t, i: next(x for x in trips[t] if x[0] == i)
            cost = 2 * access[c, place(path[0], told[0]["board"])[1]] - place(path[0], told[0]["board"])[3] + sum(x["walk"] for x in told[1:])
            end = place(path[-1], told[-1]["alight"])
            assert cost + end[2] + 2 * egress[c, end[1]] == want[c]


def test_front_and_weighed_skyline(spark):
    rng = random.Random(9)
    rows = [(i, i % 3 if i % 4 else 0, rng.randrange(40), rng.randrange(4), rng.randrange(40), rng.randrange(200)) for i in range(1500)] + [(9000, 1, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "id long, q long, arr long, transfers long, cost long, walk long").repartition(5)
    fine = [r for r in rows if r[2] is not None]
    points = {(r[1], *r[2:]) for r in fine}
    want = sorted(p for p in points if not any(o[0] == p[0] and o != p and all(a <= b for a, b in zip(o[1:], p[1:], strict=True)) for o in points))
    got = sorted(map(tuple, itineraries.front(df, "q", ["arr", "transfers", "cost", "walk"], deals=(7, 1)).collect()))
    assert got == want

    def beats(o, x):
        return o[1] == x[1] and o[2] <= x[2] and o[3] <= x[3] and o[4] <= x[4] and o[5] <= x[5] + 30 and (o[2] < x[2] or o[3] < x[3] or o[4] < x[4] or o[5] < x[5] - 30)

    stands = {x[0] for x in fine if not any(beats(o, x) for o in fine)}
    assert {r["id"] for r in itineraries.weighed_skyline(df).collect()} - {9000} == stands
    assert itineraries.front(df.limit(0), "q", ["arr"]).count() == 0

"""Range search and boarding where trips overtake, against plain searches."""

from __future__ import annotations

import random

import pytest

from wayline.operators import journeys, patterns

KIND = "trip long, route long, service long, seq long, stop long, arr long, dep long"


def network(rng, stops=12, lines=6, trips=9):
    """Lines of which trips overtake one another; some trips share a stop sequence with another line."""
    rows, n = [], 0
    for line in range(lines):
        path = rng.sample(range(stops), rng.choice([3, 4, 5]))
        for _ in range(trips):
            n += 1
            at, pace = rng.randrange(28_800, 32_400, 60), rng.choice([60, 180, 600])
            for i, s in enumerate(path):
                rows.append((n, line, 1, i, s, at - (30 if i else 0), at))
                at += pace + rng.randrange(0, 120, 30)
    return rows


def by_trip(rows):
    own = {}
    for trip, _, _, seq, s, arr, d in rows:
        own.setdefault(trip, []).append((seq, s, arr, d))
    return own


def spread(own, walks, boarded, rounds, change=120):
    """{stop: arrival}: the least over all trips, nothing left out, from the (trip, place) boarded first."""
    want, seen = {}, {}
    for t, i in boarded:
        for j, to, arr, _ in own[t]:
            if j > i:
                seen[to] = min(arr, seen.get(to, 1e9))
    for r in range(rounds):
        for to, t in [*seen.items(), *((b, seen[a] + w) for a, b, w in walks if a in seen)]:
            want[to] = min(t, want.get(to, 1e9))
        base, seen = dict(want), {}
        for c in own.values():
            for i, at, _, d in c:
                if at in base and d >= base[at] + change:
                    for j, to, arr, _ in c:
                        if j > i:
                            seen[to] = min(arr, seen.get(to, 1e9))
    return want


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    rows = network(rng)
    walks = [(a, b, rng.choice([60, 200])) for a, b in [(0, 1), (1, 0), (2, 5), (5, 2), (7, 3)]]
    return rows, walks, patterns.chained(spark.createDataFrame(rows, KIND)), spark.createDataFrame(walks, "a long, b long, seconds long")


def test_chains_never_overtake(made):
    rows, _, chained, _ = made
    got = chained.collect()
    assert len(got) == len(rows) and len({r["route"] for r in got}) > 12
    trips, chains = {}, {}
    for r in sorted(got, key=lambda r: r["seq"]):
        trips.setdefault((r["route"], r["trip"]), []).append((r["dep"], r["arr"]))
    for (chain, _), times in trips.items():
        chains.setdefault(chain, []).append(times)
    for x in chains.values():
        x.sort()
        assert all(a[0] <= b[0] and a[1] <= b[1] for one, two in zip(x, x[1:], strict=False) for a, b in zip(one, two, strict=True))


def test_earliest_arrivals_where_trips_overtake(spark, made):
    rows, walks, chained, foot = made
    queries = spark.createDataFrame([(s, s, 29_000) for s in range(12)], "q long, stop long, dep long")
    best = {}
    for r in journeys.earliest_arrivals(chained, foot, queries, rounds=3).collect():
        best[r["q"], r["stop"]] = min(best.get((r["q"], r["stop"]), 1e9), r["arr"])
    assert len(best) > 60
    own = by_trip(rows)
    for s in range(12):
        start = {s: 29_000} | {b: 29_000 + w for a, b, w in walks if a == s}
        want = spread(own, walks, {(t, i) for t, c in own.items() for i, at, _, d in c if at in start and d >= start[at]}, 3)
        want = {to: t for to, t in want.items() if t < start.get(to, 1e9)}
        assert {to: t for (q, to), t in best.items() if q == s} == want


def test_range_is_one_run_for_each_minute(spark, made):
    rows, walks, chained, foot = made
    first, last = 28_800, 30_600
    queries = spark.createDataFrame([(s, s, first, last) for s in range(12)], "q long, stop long, first long, last long")
    labels = [tuple(r) for r in journeys.range_arrivals(chained, foot, queries, rounds=3).collect()]
    assert len(labels) > 150
    access = {s: [(s, 0)] + [(b, w) for a, b, w in walks if a == s] for s in range(12)}
    own = by_trip(rows)
    for s in range(12):
        for minute in range(first, last + 1, 300):
            got = {}
            for q, to, _, dep, arr in labels:
                if q == s and dep >= minute:
                    got[to] = min(arr, got.get(to, 1e9))
            # of journeys that leave within the span only: the first ride's departure, less the walk to it, is at most ``last``
            allowed = {(t, i) for t, c in own.items() for i, at, _, d in c for o, w in access[s] if o == at and minute <= d - w <= last}
            want = spread(own, walks, allowed, 3)
            assert got == want, (s, minute)


def test_empty_span_and_no_trips(spark, made):
    _, _, chained, foot = made
    queries = spark.createDataFrame([(1, 1, 29_000, 28_000)], "q long, stop long, first long, last long")
    assert journeys.range_arrivals(chained, foot, queries, rounds=2).count() == 0
    assert journeys.range_arrivals(chained, foot, queries.limit(0), rounds=2).count() == 0

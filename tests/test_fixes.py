"""Steady positions: jumps, rest, fresh starts, lost accuracy."""

from __future__ import annotations

from wayline.operators.fixes import Seen, followed, steadied

LAT, LON = 51.0, 17.0
M = 1 / 111_195  # degrees of a metre to the north


def run(*fixes):
    track, out = None, []
    for f in fixes:
        track = followed(track, f)
        out.append(track)
    return out


def at(ts, north, acc=5.0, speed=None, heading=None):
    return Seen(ts, LAT + north * M, LON, acc, speed, heading)


def north(track):
    return round((track.lat - LAT) / M, 1)


def test_a_jump_must_come_twice():
    one = run(at(0, 0), at(1, 0.5), at(2, 300), at(3, 1))
    assert north(one[2]) == north(one[1]) and one[2].jump and one[3].jump is None and north(one[3]) < 2
    two = run(at(0, 0), at(1, 0.5), at(2, 300), at(3, 310))
    assert north(two[3]) == 310.0
    apart = run(at(0, 0), at(1, 0.5), at(2, 300), at(3, 600), at(4, 605))
    assert north(apart[3]) == north(apart[1]) and north(apart[4]) == 605.0
    # a fast vehicle may move that far
    assert north(run(at(0, 0), at(1, 5, speed=20.0), at(2, 38, speed=20.0))[2]) > 20


def test_rest_around_an_anchor():
    still = run(at(0, 0), *(at(i, 3.0 if i % 2 else -3.0) for i in range(1, 20)))
    assert all(abs(north(t)) < 1 for t in still) and all(t.anchor == (LAT, LON) for t in still)
    away = run(at(0, 0), *(at(2 * i, 3.0 * i) for i in range(1, 10)))
    assert north(away[-1]) > 20 and away[-1].anchor != (LAT, LON)
    assert away[-1].heading is not None and (away[-1].heading < 1 or away[-1].heading > 359)


def test_fresh_starts_and_losses():
    assert north(run(at(0, 0, 60.0), at(1, 100, 10.0))[1]) == 100.0, "a fine fix after a coarse one"
    assert north(run(at(0, 0, 10.0), at(1, 20, 4.0))[1]) == 20.0, "twice as accurate"
    assert north(run(at(0, 0), at(31, 400, 40.0))[1]) == 400.0, "after a pause"
    assert run(at(0, 0), at(5, 80, 60.0))[1] == run(at(0, 0))[0], "accuracy is lost"
    assert run(Seen(0, float("nan"), LON))[0] is None
    first = run(at(0, 0), at(4, 500))
    assert 0 < north(first[1]) <= 500, "a first fix may be stale: no jump"


def test_many_devices(spark):
    rows = [(d, float(t), LAT + t * M, LON, 5.0, None, None) for d in ("a", "b") for t in range(5)] + [("c", 0.0, None, None, None, None, None), (None, 1.0, LAT, LON, 5.0, None, None), ("a", None, LAT, LON, 5.0, None, None)]
    got = steadied(spark.createDataFrame(rows, "device string, ts double, lat double, lon double, accuracy double, speed double, heading double")).collect()
    assert len(got) == 11 and [r["f_lat"] for r in got if r["device"] == "c"] == [None]
    want = [t.lat for t in run(*(at(float(t), t) for t in range(5)))]
    assert [r["f_lat"] for r in sorted((r for r in got if r["device"] == "a"), key=lambda r: r["ts"])] == want

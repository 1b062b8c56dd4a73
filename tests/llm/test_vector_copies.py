"""Near copies among vectors against all pairs in double precision."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm.vector_copies import Quantisers, fit, near_copies

LEAST = 0.9


def brute(rows):
    """Rows (id, vector or None): {row number: (links, component, kept)}."""
    fine = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    use = [i for i in range(n) if fine(rows[i][1])]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = [0] * n
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in use}
    for k, i in enumerate(use):
        for j in use[k + 1 :]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= LEAST:
                count[i] += 1
                count[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], count[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(n)), key=repr)


def ours(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, node string, n long")
    out = near_copies(df.repartition(3), LEAST, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def around(rng, centre, n, spread):
    noise = rng.standard_normal((n, len(centre)))
    return centre / np.linalg.norm(centre) + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)


def single(x):
    """What Spark's floats hold."""
    return [[float(np.float32(c)) for c in v] for v in x]


def test_copies_of_all_kinds(spark):
    """One tight group, one close to the first, pairs further apart, equal vectors, strangers; small buckets are hot."""
    rng = np.random.default_rng(1)
    c = rng.standard_normal(24)
    near = around(rng, c, 1, 0.3)[0]
    x = [*around(rng, c, 60, 0.05), *around(rng, near, 50, 0.05), *around(rng, rng.standard_normal(24), 3, 0.2), *rng.standard_normal((120, 24))]
    x = single(x) + single([x[0]] * 3) + single([2 * v for v in x[:2]])
    rows = [(i, v) for i, v in enumerate(x)]
    rng.shuffle(rows)
    rows = [(int(i), list(map(float, v))) for i, v in rows]
    want = brute(rows)
    got = ours(spark, rows, crowd=4, block=16)
    assert sum(r[1] for r in want) > 3000
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)), "a link below the threshold or counted twice"
    assert sum(a[2:] == b[2:] for a, b in zip(got, want, strict=True)) >= 0.98 * len(rows)


def test_spread_group_without_balls(spark):
    """A hot bucket whose vectors are linked but lie too far apart for balls: cells of blocks find each pair once."""
    rng = np.random.default_rng(2)
    x = single(around(rng, rng.standard_normal(16), 150, 0.3))
    rows = list(enumerate(x))
    want, got = brute(rows), ours(spark, rows, crowd=4, block=16)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    assert got == ours(spark, rows, crowd=10_000, block=10_000)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 0.0]), (9, [2.0, 2.0])]
    rows += [(9, [2.0, 2.0]), (None, [1.0, 1.0]), (None, [5.0, -5.0]), (10, [-1.0, -1.0]), (11, [3.0])]
    want = brute(rows)
    want = sorted([(i, n, c, True if i is None and c is None else k) for i, n, c, k in want], key=repr)
    for kind in ("float", "double"):
        assert ours(spark, rows, kind) == want
    assert ours(spark, []) == []


def test_threshold_decides_on_the_original_vectors(spark):
    """Angles that bytes can't tell from the threshold's."""
    rows = []
    for i in range(40):
        s = LEAST + (i - 20) * 1e-6
        rows += [(100 * i, [1.0, 0.0, float(i), 0.0]), (100 * i + 1, [s, (1 - s * s) ** 0.5, 0.0, 0.0])]
    rows = [(i, v[:2] + [0.0] * (i // 100 * 2) + [0.0] * 2) for i, v in rows]  # pairs of lengths of their own
    got = {r[0]: r[1] for r in ours(spark, rows, "double")}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.75 * sum(want.values())


@pytest.mark.parametrize("d", [2, 3, 24, 64, 200])
@pytest.mark.parametrize("mean", [0.0, 2.0, 30.0])
def test_pairs_at_the_threshold_meet(d, mean):
    """Recall of the tables alone on random pairs at the threshold, also where all vectors lie to one side."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((800, d)) + mean
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((800, d))
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = LEAST * x + (1 - LEAST**2) ** 0.5 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    assert fit(x, d, LEAST).found(x, y) >= 0.88
    assert Quantisers({}, LEAST)[d].found(x, y) >= 0.88


def test_bits_are_balanced():
    x = np.random.default_rng(3).standard_normal((4000, 48)) * np.linspace(0.5, 2, 48) + 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    on = np.unpackbits(fit(x, 48, LEAST).parts(x).view(np.uint8), axis=1).mean(axis=0)
    assert abs(on - 0.5).max() < 0.08


def test_rows_of_one_hot_ball_are_linear(spark):
    """Cells of a bucket that one ball fills: each of its rows goes to the blocks of the others, not to its own."""
    from wayline.llm.vector_copies import cells

    rows = spark.range(5000).select(F.lit(2).alias("d"), F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.when(F.col("id") < 4900, 1).cast("long").alias("ball"))
    out = cells(rows, rows.select("d", "key", "ball"), 100, "test").groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("ball").isNull().cast("int")).alias("others")).collect()
    assert sum(r["n"] for r in out) < 5000 + 100 * 50 + 100
    assert max(r["n"] for r in out) < 400 and all(r["others"] for r in out)

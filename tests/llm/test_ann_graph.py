"""NN-descent and greedy search against all pairs; rows that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm.ann_graph import nearest

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, asks, top=5):
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asks:
        s = y @ y[int(np.flatnonzero(ids == q)[0])]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:top]
        out[q] = [int(ids[k]) for k in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 24))
    x = (centres[rng.integers(0, 12, 1200)] + rng.normal(0, 0.7, (1200, 24))).astype(np.float32)
    x[1100:] = x[:100] * 2
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall(spark, rows):
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    want = exact(rows, range(0, 1200, 50))
    found = {}
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12 and r["vec_id"] != r["query_id"]
    assert set(found) == set(want) and all(sorted(k for k, _ in v) == [1, 2, 3, 4, 5] for v in found.values())
    hits = sum(len({i for _, i in found[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as rank", "3 as node"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]


def test_empty_and_single(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0])], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_all_the_same(spark):
    got = nearest(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(300)], SCHEMA), F.col("vec_id") == 250).collect()
    assert sorted(r["vec_id"] for r in got) == [0, 1, 2, 3, 4]


def test_doubles_are_scored_as_doubles(spark):
    a, b, c = [1.0, 1e-9], [1.0, 2e-9], [1.0, 0.5]
    got = nearest(spark.createDataFrame([(0, a), (1, b), (2, c), (3, a)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] in ([1, 3, 2], [3, 1, 2]) and {r["vec_id"]: r["score"] for r in got}[2] == (1 + 0.5e-9) / (1 + 1e-18) ** 0.5 / 1.25**0.5


def test_repeated_ids_in_any_order(spark):
    """An id with unlike vectors: the same lists whatever the order of rows, each vector a candidate and a query of its own."""
    rng = np.random.default_rng(8)
    rows = [(i % 40, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(120)]
    rows += [rows[0], rows[7]]

    def lists(order):
        df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<float>")
        return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest(df, F.col("vec_id") % 20 == 0, top=3).collect())

    got = lists(range(len(rows)))
    assert got == lists(rng.permutation(len(rows)))
    x = {(i, tuple(v)) for i, v in rows}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    for q, v in x:
        if q % 20 == 0:
            best = sorted(((-cos(np.array(v), np.array(w)), i) for i, w in x if i != q))[:3]
            want += [(q, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)

"""Near-copy removal against all pairs, and its parts by themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import near_copies
from wayline.llm.near_copies import forest, pairs_of_run, without_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(rows, least=0.8):
    """Ids that stay, by comparing all pairs."""
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    out = {}
    for i, (key, _) in enumerate(rows):
        out[find(i)] = min(out.get(find(i), key), key)
    return sorted(out.values())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(40):
        base = list(rng.choice(words, int(rng.integers(20, 300))))
        out.append(base)
        for _ in range(int(rng.integers(0, 4))):
            w = list(base)
            for i in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0, 0.06))), replace=False):
                w[i] = str(rng.choice(words))
            out.append(w)
        if rng.random() < 0.3:
            out.append(list(base))
    order = rng.permutation(len(out))
    return [(int(i), " ".join(out[k])) for i, k in enumerate(order)]


def test_same_as_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r[0] for r in without_copies(docs).select("doc_id").collect())
    want = groups(rows)
    assert len(set(got) ^ set(want)) <= 1, (len(got), len(want))


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " end"), (None, "a b c"), (6, "A  b C"), (7, "other"), (7, "other"), (8, "other words"), (8, "quite different here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as h", "3 as root")
    out = without_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(1, ""), (4, long), (6, "A  b C"), (7, "other"), (8, "other words"), (8, "quite different here")]


def test_empty_table(spark):
    assert without_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def connected(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_forest_connects_what_near_pairs_connect():
    rng = np.random.default_rng(2)
    for radius in (3, 5, 8):
        c1, c2 = (rng.integers(0, 1 << 10, 90).astype(np.uint64) for _ in range(2))
        near = [(i, j) for i in range(90) for j in range(i) if int(c1[i] ^ c1[j]).bit_count() + int(c2[i] ^ c2[j]).bit_count() <= radius]
        got = forest(c1, c2, radius).tolist()
        assert connected(90, got) == connected(90, near) and len(got) == 90 - len(set(connected(90, near)))
        assert all((max(p), min(p)) in set(near) for p in got)


def test_stars_connect_what_pairs_connect():
    rng = np.random.default_rng(7)
    for n in (0, 5, 60, 140):
        pairs = rng.integers(0, 100, (n, 2))
        got = near_copies.stars(pairs)
        assert connected(100, got.tolist()) == connected(100, pairs.tolist()) and (got[:, 0] > got[:, 1]).all()


def test_runs():
    key = np.array([1, 2, 2, 3, 3, 3] + [4] * 12 + [5] * 100)
    c1 = np.array([5, 1, 3, 0, 1, 255] + list(range(12)) + list(range(1000, 1100)), np.int64)
    got = set(map(tuple, pairs_of_run(key, c1, c1 * 0, 2).tolist()))
    assert (3, 1) in got and (1, 0) in got and (255, 0) not in got and (5, 1) not in got
    assert {b for e in got for b in e} >= set(range(12)) | set(range(1000, 1100))
    near = [(int(a), int(b)) for k in set(key.tolist()) for a in c1[key == k] for b in c1[key == k] if a > b and int(a ^ b).bit_count() <= 2]
    assert connected(1100, got) == connected(1100, near) and got <= set(near)


def stretched(rng, base, share, at=None):
    """``base`` with one stretch of new words."""
    k = int(len(base) * share)
    at = int(rng.integers(4, len(base) - k - 4)) if at is None else at
    return [*base[:at], *(f"n{i}" for i in rng.integers(0, 1 << 40, k)), *base[at + k :]]


@pytest.mark.parametrize("leaves", [30, 100])
def test_star_is_one_group(spark, leaves):
    rng = np.random.default_rng(leaves)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))] + [(i, " ".join(stretched(rng, base, 0.085))) for i in range(1, leaves + 1)]
    out = without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r[0] for r in out] == groups(rows) == [0]


def test_links_do_not_depend_on_the_tree(spark):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(400)]
    rows = [(i, " ".join(stretched(rng, base, rng.uniform(0.06, 0.17)))) for i in range(60)]
    got = sorted(r[0] for r in without_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert got == groups(rows)


def test_equal_check_words(spark):
    """Texts of the same two-word shingles: the links that the least name does not have."""
    words = [f"v{i}" for i in range(5)]
    rng, rows = np.random.default_rng(1), []
    de_bruijn = [f"{a} {b}" for a in words for b in words]
    for i in range(12):
        parts = [de_bruijn[k] for k in rng.permutation(25)]
        text = " ".join(parts * 2)
        rows += [(2 * i, text), (2 * i + 1, text + " " + " ".join(parts[:3]))]
    got = sorted(r[0] for r in without_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert got == groups(rows)


def test_links_within_equal_all_pairs():
    rng = np.random.default_rng(3)
    for k in range(30):
        base = rng.integers(0, 1 << 60, 40)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(20, 41)), replace=False), rng.integers(0, 1 << 60, int(rng.integers(0, 6)))])) for _ in range(int(rng.integers(2, 40)))] + [np.zeros(0, np.int64)] * (k % 3)
        root = rng.integers(0, 1 + len(sets) * (1 + k % 2) // 2, len(sets))
        want, got = ({r: r for r in root.tolist()} for _ in range(2))

        def top(of, r):
            while of[r] != r:
                r = of[r]
            return r

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.7 * max(1, len(sets[i]) + len(sets[j]) - both):
                    a, b = top(want, root[i]), top(want, root[j])
                    want[max(a, b)] = min(a, b)
        links = near_copies.links_within(root, sets, 0.7)
        assert len(links) < len(set(root.tolist()))
        for i, j in links:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert both >= 0.7 * (len(sets[i]) + len(sets[j]) - both)
            a, b = top(got, root[i]), top(got, root[j])
            got[max(a, b)] = min(a, b)
        assert {r: top(got, r) for r in got} == {r: top(want, r) for r in want}


def variants(rng, n, words=200):
    base = [f"b{i}" for i in rng.integers(0, 1 << 30, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.choice(words, max(1, int(words * rng.uniform(0.01, 0.045))), replace=False):
            w[i] = f"n{rng.integers(0, 1 << 40)}"
        out.append(" ".join(w))
    return out


def test_families_of_sixty_lose_no_link(spark):
    """Every pair of 0.8 or more ends in one group: against all pairs, without tolerance."""
    rng = np.random.default_rng(12)
    texts = [t for _ in range(6) for t in variants(rng, 60, int(rng.integers(120, 300)))]
    rows = [(int(i), texts[k]) for i, k in enumerate(rng.permutation(len(texts)))]
    got = sorted(r[0] for r in without_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert got == groups(rows)


def test_small_blocks_change_nothing(spark):
    rng = np.random.default_rng(13)
    texts = [t for _ in range(2) for t in variants(rng, 150)]
    rows = [(int(i), texts[k]) for i, k in enumerate(rng.permutation(len(texts)))]
    told = near_copies.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=40, crowd=40).collect()
    assert sorted(r["id"] for r in told if r["first"]) == groups(rows)


def test_rows_of_a_group_that_one_root_fills_are_linear(spark):
    for n in (1000, 4000):
        rows = spark.range(n).selectExpr("1L as key", f"{n} div 100 as g", "id as n", "case when id < 10 then id else 99L end as root")
        assert near_copies.to_blocks(rows, "key").count() == n - 10 + 10 * (n // 100)
        assert near_copies.to_blocks(rows.selectExpr("key", "g", "n", "1L as root"), "key").count() == 0


@pytest.mark.parametrize("kind", ["replaced", "removed", "added"])
def test_stretch_at_least_similarity(kind):
    """Pairs at about 0.8 with one stretch changed meet: a key in common, and the check words within the radius."""
    rng, missed = np.random.default_rng(4), 0
    for _ in range(300):
        base = [f"w{i}" for i in rng.integers(0, 50000, int(rng.integers(200, 300)))]
        at, n = int(rng.integers(4, 120)), len(base) - 4
        if kind == "replaced":
            other = stretched(rng, base, (n / 9 - 4) / len(base), at)
        elif kind == "removed":
            other = base[:at] + base[at + int(n / 5) - 4 :]
        else:
            other = base[:at] + [f"n{i}" for i in rng.integers(0, 1 << 40, int(n / 4) - 4)] + base[at:]
        a, b = near_copies.print_of(" ".join(base)), near_copies.print_of(" ".join(other))
        keys, of = near_copies.fuzzy_keys([a[3], b[3]])
        apart = sum(((a[k] ^ b[k]) & (1 << 64) - 1).bit_count() for k in (1, 2))
        missed += not np.intersect1d(keys[of == 0], keys[of == 1]).size or apart > 34
    assert missed <= 3


def test_cells_of_a_group_without_a_large_root_are_bounded(spark):
    """4,096 nodes of as many roots: every pair meets, and no cell holds more than two blocks."""
    rows = spark.range(4096).select(F.lit(1).cast("long").alias("family"), F.lit(16).cast("long").alias("g"), F.col("id").alias("n"), F.col("id").alias("root"))
    out = near_copies.to_blocks(rows, "family")
    assert out.count() == 4096 * 16
    assert out.groupBy("block").count().agg(F.max("count")).first()[0] < 2.5 * 4096 / 16
    small = near_copies.to_blocks(rows.where("n < 60").withColumn("g", F.lit(5).cast("long")).withColumn("root", F.when(F.col("n") < 30, 0).otherwise(F.col("n"))), "family").collect()
    cells, root = {}, {}
    for r in small:
        cells.setdefault(r["block"], set()).add(r["n"])
        root[r["n"]] = r["root"]
    assert all(any(a in c and b in c for c in cells.values()) for a in range(60) for b in range(a) if root[a] != root[b])


def test_near_copies_without_ids(spark):
    """Near, not equal, texts with null ids: one stays."""
    words = [f"w{i * 7919 % 1000}x{i}" for i in range(300)]
    one, two = " ".join(words), " ".join([*words[:150], "other", *words[151:]])
    df = spark.createDataFrame([(None, one), (None, two), (None, "something else altogether"), (5, "five")], "doc_id long, text string")
    assert near_copies.without_copies(df).count() == 3
    df = spark.createDataFrame([(None, one), (7, two)], "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.without_copies(df).collect()] == [7]

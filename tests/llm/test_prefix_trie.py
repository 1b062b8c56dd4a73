"""The conversation trie against a plain one built of nested dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wayline.llm.prefix_trie import conversation_trie, peel

KIND = "turn long, role string, text string, conv_id long, depth string, p0 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, family, borrowed):
    """Rows of (turn, role, text, conv_id); turns of a conversation are unlike or equal in all."""
    convs = {}
    for t, r, x, c in sorted((r[:4] for r in rows if r[3] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % borrowed
        out[c] = convs.get(c - c % family, [])[:h] + own[h:]
    nodes = {}
    for c, seq in out.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    told = []
    for p, who in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = {q[: len(p) + 1] for q in below if len(q) > len(p)}
        leaves = sum(not any(z[: len(q)] == q and len(z) > len(q) for z in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in who if len(out[c]) == len(p))))
        told.append((min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(told)


def ours(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)
    out = conversation_trie(df, **options)
    assert sorted(out.columns) == sorted(COLUMNS)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), 50):
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((None if t == 0 and rng.random() < 0.5 else t, rng.choice(["user", None, "bot"]), rng.choice(["", None, "häh😀", "ja"]), c))
    rows = [r for r in rows if r[3] % 10 or r[3] % 20 == 0]  # some conversations that others borrow from are absent
    rng.shuffle(rows)
    # Python's % takes the sign of the divisor, SQL's that of the dividend: negative ids are told apart below
    rows = [r for r in rows if r[3] >= 0]
    assert ours(spark, rows, family=10) == plain(rows, 10, 6)


def test_prefixes_of_one_another_and_copies(spark):
    """Chains of one child each through many conversations, and exact copies; a conversation that ends inside another."""
    line = [(t, "user", f"turn {t}") for t in range(24)]
    rows = [(*x, 100 * c) for c in range(1, 25) for x in line[:c]] + [(*x, 100 * c) for c in (50, 51, 52) for x in line]
    assert ours(spark, rows) == plain(rows, 100, 6)


def test_turnless_and_repeated_rows(spark):
    """c borrows no turns (its base is absent) and has none after its first h: it is a member of the root alone."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(0, "a", "b", c), (1, "a", "b", c), (0, "a", "b", 300), (0, "a", "b", 300), (0, "z", "z", None)]
    got = ours(spark, rows)
    assert got == plain(rows, 100, 6)
    assert (c, 0, None, 2, 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) in got


def test_empty(spark):
    assert ours(spark, []) == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_many_ends_at_one_node(spark):
    """Ids of a node come in more than one batch and partition, in numeric order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(0, "u", "hello", 100 * c) for c in range(150)]
        assert ours(spark, rows) == plain(rows, 100, 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chain_takes_few_rounds(spark):
    """300 nodes, one below the other, each with a finished side leaf at every third: about log2 n rounds, not n."""
    n = 300
    rows = [(1, d, 1 if d else None, 2, 1 if d else 0) for d in range(n)] + [(1000 + d, d + 1, 1, 1, 0) for d in range(0, n - 1, 3)]
    nodes = spark.createDataFrame(rows, "conv_id long, depth long, parent long, n_convs long, own long")
    got = {(r["conv_id"], r["depth"]): (r["n_leaves"], r["saved"]) for r in peel(nodes, most_rounds=16).collect()}
    assert len(got) == len(rows)
    for d in range(n):
        assert got[1, d] == (1 + len(range(0, n - 1, 3)) - len(range(0, d, 3)), n - d if d else n - 1)


def test_bushy_tree(spark):
    rng = random.Random(3)
    nodes, kids = {(0, 0): None}, {}
    for i in range(1, 200):
        p = rng.choice(list(nodes))
        key = (i, p[1] + 1)
        nodes[key] = p
        kids.setdefault(p, []).append(key)
    own = {k: rng.randrange(9) if k[1] else 0 for k in nodes}

    def total(k):
        below = [total(x) for x in kids.get(k, [])]
        return (sum(x[0] for x in below) or 1, own[k] + sum(x[1] for x in below))

    df = spark.createDataFrame([(c, d, p[0] if p else None, 2, own[c, d]) for (c, d), p in nodes.items()], "conv_id long, depth long, parent long, n_convs long, own long")
    assert {(r["conv_id"], r["depth"]): (r["n_leaves"], r["saved"]) for r in peel(df).collect()} == {k: total(k) for k in nodes}
    assert peel(df).agg(F.count("*")).first()[0] == len(nodes)

"""Collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from wayline.llm.phrases import best_phrases, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    gone = {(lang, w[i:j]) for (lang, w), a in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and (lang, w[i:j]) in cand and 100 * a >= 100 * cand[lang, w[i:j]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, l, r = min(((1000 * a * n[lang]) // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, score))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], s) for lang, x in out.items() for i, (_, a, p, l, r, s) in enumerate(sorted(x)[:top]))


def ours(spark, rows, **options):
    df = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, n long, words int")
    out = collocations(df.repartition(3), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_plain(spark, seed):
    """Few words, so repeats overlap; small sketches collide; many shards and automata."""
    rng = random.Random(seed)
    words = ["a", "A", "b", "bb", "ä", "Ä", "😀", "x\x1cy", "c\x85", "ab", "a-b", "d'"]
    gaps = [" ", "  ", "\t", ". ", "\n", "\r\n", ",", " \x0b"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words[: rng.choice([2, 12])]) + rng.choices(gaps, [30, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.choice([0, 1, 6, 80])))
        rows.append((text, rng.choice(["en", "en", None, "und", "x y", ""])))
    rows += [(None, "en"), ("", None), (" \t\n.", "empty")] + [rows[0]] * 5
    want = plain(rows, 6, 40)
    assert len(want) > 60
    assert ours(spark, rows, least=6, top=40, shard_chars=700, most_patterns=9, most_bits=14) == want


def test_every_passing_cell_and_still_exact(spark):
    """A sketch far too small lets nearly all phrases pass; results stay exact."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(300)), "en") for _ in range(40)] + [("one two three four five six", "en")] * 9
    assert ours(spark, rows, least=7, most_bits=14) == plain(rows, 7, 2000)


def test_subsumed_and_tied(spark):
    rows = [("w x y z", "en")] * 4 + [("w x y", "en")] + [("q w", None)] * 4
    got = ours(spark, rows, least=4)
    assert got == plain(rows, 4, 2000)
    assert [r[2] for r in got] == ["w x y", "w x y z", "q w"] or {r[2] for r in got} == {"w x y z", "w x y", "q w"}


def test_long_text_is_one_shard(spark):
    rows = [("k l m. " * 30_000, "en"), ("k l", "en")]
    assert ours(spark, rows, shard_chars=1000) == plain(rows, 100, 2000)


def test_empty(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, None), ("", "en")]) == []


def test_products_past_64_bits(spark):
    big = 9 * 10**12
    rows = [("en", "", 0, 10**13), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    assert [tuple(r) for r in best_phrases(df, 5).collect()] == [("en", 1, "a b", big - 2, big, big - 1, 10**13, 1000 * (big - 2) * 10**13 // (big * (big - 1)))]
    with pytest.raises(ValueError):
        collocations(df, least=300)

"""Typing-error tolerant scores of a query against names, 0 to 100, as an Arrow function."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.functions.words import BLANKS, SYNONYMS, bare

_CUT = re.compile(r"[\s,./()\\-]+")
_ALSO = {w: {x for g in SYNONYMS if w in g for x in g} for g in SYNONYMS for w in g}


def fold(text: str | None) -> str:
    """As ``words.normalized``."""
    return bare((text or "").lower()).strip(BLANKS)


def osa(a: str, b: str) -> int:
    """Edits between two words: one character more, less or other, or two neighbours swapped; no part is edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last2, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last2[j - 2] + 1)
            row.append(cost)
    return row[-1]


@lru_cache(200_000)
def token_distance(token: str, word: str) -> tuple[int, bool]:
    """(edits, whether from the word's start) of a query token in a name's word; 99 where it isn't there."""
    if word.startswith(token):
        return 0, True
    if token in word:
        return 0, False
    if len(token) < 3:
        return 99, False
    allowed = 2 if len(token) > 6 else 1
    heads = {word[: len(token)], word[: len(token) + 1]} | ({word[: len(token) - 1]} if len(token) > 3 else set())
    least = min(osa(token, h) for h in heads)
    return (least, True) if least <= allowed else (99, False)


def score(query: str | None, name: str | None) -> float:
    """100 for the same name; a name that starts so 92 to 98; initials 85; all tokens 98, 90 or 82 by how they meet, less 8 an edit; some tokens by their share."""
    q, t = fold(query), fold(name)
    if not q or not t:
        return 0.0
    if q == t:
        return 100.0
    if t.startswith(q):
        return float(max(92, 98 - (len(t) - len(q))))
    asked, words = [x for x in _CUT.split(q) if x], [x for x in _CUT.split(t) if x]
    if not asked or not words:
        return 0.0
    if len(asked) == 1 and 2 <= len(q) <= 4 and "".join(w[0] for w in words).startswith(q):
        return 85.0
    met = [min((*token_distance(v, w)[:1], not token_distance(v, w)[1], v != w) for v in {a} | _ALSO.get(a, set()) for w in words) for a in asked]
    good = [m for m in met if m[0] <= 2]
    if len(good) == len(asked):
        edits = sum(m[0] for m in good)
        if edits:
            return float(max(50, 74 - 8 * (edits - 1)))
        return 98.0 if not any(m[2] for m in good) else 90.0 if not any(m[1] for m in good) else 82.0
    if good and len(asked) > 1 and 2 * len(good) >= len(asked):
        return float(max(40, 60 * len(good) // len(asked) - 8 * sum(m[0] for m in good)))
    return 0.0


def fuzzy_score(query: Column, name: Column) -> Column:
    """``score`` of two columns; one Arrow batch at a time. Put a cheap filter on tokens before it on long tables."""

    def run(q: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([score(a, b) for a, b in zip(q.to_pylist(), n.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(query, name)


def edit_distance(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else osa(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(a, b)

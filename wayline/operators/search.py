"""Finding and ranking names."""

from __future__ import annotations

import re
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.fuzzy import fold, fuzzy_score
from wayline.functions.words import SYNONYMS, normalized, squeezed, tokens

_ALSO = {w: sorted({x for g in SYNONYMS if w in g for x in g}) for g in SYNONYMS for w in g}


def prefiltered(names: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Rows whose normalised name holds every token of the query, or a word that stands for it; also with all blanks taken out."""
    norm = normalized(F.col(column))
    q = fold(query).replace("%", "").replace("_", "")
    every = F.lit(True)
    for t in q.split():
        any_ = F.lit(False)
        for v in _ALSO.get(t, [t]):
            any_ = any_ | F.contains(norm, F.lit(v))
        every = every & any_
    return names.where(every | F.contains(squeezed(norm), F.lit(q.replace(" ", ""))))


def may_match(name: Column, query: str) -> Column:
    """False only for names whose fuzzy score for the query is 0: half of the tokens, or the initials, or the start have to be there, with typing errors.

    Within JVM expressions. An edit that swaps two letters is two of ``levenshtein``, so twice the allowed edits pass here; the score decides.
    """
    norm, q = normalized(name), fold(query)
    words, asked = tokens(norm), [x for x in re.split(r"[\s,./()\\-]+", q) if x]

    def meets(token: str) -> Column:
        def one(w: Column) -> Column:
            hit = F.contains(w, F.lit(token))
            if len(token) >= 3:
                edits = 4 if len(token) > 6 else 2
                for n in (len(token) - 1, len(token), len(token) + 1):
                    hit = hit | (F.levenshtein(F.substring(w, 1, n), F.lit(token), edits) >= 0)
            return hit

        return F.exists(words, one)

    met = F.lit(0)
    for a in asked:
        any_ = F.lit(False)
        for v in _ALSO.get(a, [a]):
            any_ = any_ | meets(v)
        met = met + any_.cast("int")
    if not asked:
        return F.lit(bool(q)) & F.startswith(norm, F.lit(q))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return (met * 2 >= len(asked)) | F.startswith(norm, F.lit(q)) | F.startswith(initials, F.lit(q))


def search(names: DataFrame, query: str, most: int = 15) -> DataFrame:
    """The best ``most`` names (id, name, weight) for a query, typing errors allowed, by score, weight, id: a total order.

    ``may_match`` keeps names that can't score from the Arrow function, and none that can.
    """
    scored = names.where(may_match(F.col("name"), query)).withColumn("score", fuzzy_score(F.lit(query), F.col("name"))).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("weight"), "id").limit(most)


def reference_order(found: DataFrame, near: float = 12.0) -> DataFrame:
    """Adds ``place`` to the few rows found for one query (q, id, score, weight): scores that differ by more than ``near`` decide, else weights.

    That rule is no total order: the result depends on the order before it, which is by id here. Only for the bounded lists that a search gives.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.sort_values("id").to_dict("records"), key=cmp_to_key(lambda a, b: (b["score"] - a["score"]) if abs(a["score"] - b["score"]) > near else (b["weight"] - a["weight"])))
        return pd.DataFrame([{**r, "place": i} for i, r in enumerate(rows)], columns=[*pdf.columns, "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.groupBy("q").applyInPandas(order, f"{kinds}, place long")


def grouped_poles(stops: DataFrame) -> DataFrame:
    """(base, id, weight, poles): stops of one name with pole numbers as one, with the heaviest as its id (ties: the smaller)."""
    from wayline.functions.words import pole_base

    g = stops.withColumn("base", pole_base(F.col("name"))).groupBy("base")
    return g.agg(F.min(F.struct((-F.col("weight")).alias("less"), "id")).alias("x"), F.sum("weight").alias("weight"), F.count("*").alias("poles")).select("base", "x.id", "weight", "poles")

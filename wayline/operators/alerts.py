"""Service alerts and news: nested records, names in them, and what is in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT = "struct<lines:array<struct<line:string,stops:array<string>>>,stops:array<string>,phases:array<struct<stops:array<string>>>>"


def in_force(now: Column, start: Column, end: Column, resolved: Column, grace_hours: int = 12) -> Column:
    """Begun (or without a begin), not resolved, and not past its end by more than ``grace_hours`` (or without an end)."""
    return (start.isNull() | (start <= now)) & (end.isNull() | (end + F.expr(f"interval {grace_hours} hours") >= now)) & ~F.coalesce(resolved, F.lit(False))


def names_in(alert: Column) -> Column:
    """All stop names of an alert's tree, each once whatever its case (as first written), in order of the alphabet."""
    empty = F.array().cast("array<string>")
    nested = F.flatten(F.array(F.coalesce(alert["stops"], empty), F.flatten(F.coalesce(F.transform(alert["lines"], lambda x: F.coalesce(x["stops"], empty)), F.array(empty))), F.flatten(F.coalesce(F.transform(alert["phases"], lambda x: F.coalesce(x["stops"], empty)), F.array(empty)))))
    clean = F.filter(F.transform(nested, lambda s: F.trim(s)), lambda s: s != "")
    low = F.transform(clean, F.lower)
    return F.array_sort(F.transform(F.array_distinct(low), lambda s: F.get(clean, F.array_position(low, s) - 1)))


def shortened(word: Column, edits: int) -> Column:
    """The word and what is left of it when up to ``edits`` (1 or 2) of its letters go: two words that many edits apart have one in common."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.concat(F.array(word), less(word))
    return F.array_distinct(once if edits == 1 else F.concat(once, F.flatten(F.transform(once, less))))


def token_matches(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(token, word) of all tokens of ``asked`` (token) and words of ``known`` (word) that the fuzzy score takes for each other.

    Joins on equal keys only: a token inside a word shares its first two letters (or its one) with a place in the word; a mistyped one shares a
    shortened form with a start of the word. The exact edit distance decides.
    """
    from wayline.functions.fuzzy import edit_distance

    pieces = lambda w, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    short = F.least(F.length("token"), F.lit(2))
    inside = known.select("word", F.explode(F.array_union(pieces(F.col("word"), 1), pieces(F.col("word"), 2))).alias("k"))
    held = asked.select("token", F.substring(F.col("token"), F.lit(1), short).alias("k")).join(inside, "k").where(F.contains("word", "token")).select("token", "word")
    out = held
    for edits, longs in ((1, F.length("token").between(3, 6)), (2, F.length("token") > 6)):
        some = asked.where(longs)
        sizes = some.select(F.explode(F.sequence(F.length("token") - edits, F.length("token") + 1)).alias("n")).distinct()
        ends = known.where(F.length("word") >= 2).select("word", F.explode(F.sequence(F.lit(2), F.length("word"))).alias("n"))
        heads = ends.join(sizes, "n").select("word", F.expr("substring(word, 1, n)").alias("head"))
        keyed = heads.select("head").distinct().select("head", F.explode(shortened(F.col("head"), edits)).alias("k"))
        near = some.select("token", F.explode(shortened(F.col("token"), edits)).alias("k")).join(keyed, "k").where(F.abs(F.length("token") - F.length("head")) <= edits).select("token", "head").distinct()
        near = near.where(edit_distance(F.col("token"), F.col("head")) <= edits)
        out = out.unionByName(near.join(heads, "head").select("token", "word"))
    return out.distinct()


def grounded(names: DataFrame, known: DataFrame, least: float = 80.0) -> DataFrame:
    """(name, stop, score): each name's stop, by equality of normalised names, else the best fuzzy score of at least ``least``; ties: the smaller stop.

    No cross join and no pair left out. At 60 or more a score needs all tokens of the name (or its initials) in the stop's name; so a name meets only the stops that hold a
    match of its rarest token, told by ``token_matches`` over distinct words.
    """
    from wayline.functions.fuzzy import fuzzy_score
    from wayline.functions.words import normalized, tokens, with_synonyms

    if least < 60:
        raise ValueError("below 60 a part of a name's tokens is enough, which the search by the rarest token would miss")
    asked = names.select("name").distinct()
    exact = asked.withColumn("k", normalized(F.col("name"))).join(known.groupBy(normalized(F.col("stop_name")).alias("k")).agg(F.min("stop").alias("stop")), "k").select("name", "stop", F.lit(100.0).alias("score"))
    rest = asked.join(exact, "name", "left_anti")
    said = rest.select("name", F.posexplode(tokens(normalized(F.col("name")))).alias("i", "t")).select("name", "i", F.explode(with_synonyms(F.col("t"))).alias("token"))
    words = known.select("stop", "stop_name", F.explode(F.array_distinct(tokens(normalized(F.col("stop_name"))))).alias("word"))
    seen = words.groupBy("word").agg(F.count("*").alias("stops"))
    matches = token_matches(said.select("token").distinct(), seen.select("word"))
    weight = said.join(matches.join(seen, "word").groupBy("token").agg(F.sum("stops").alias("n")), "token", "left").groupBy("name", "i").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = weight.groupBy("name").agg(F.min(F.struct("n", "i")).alias("x")).select("name", "x.i")
    pairs = said.join(rarest, ["name", "i"]).join(matches, "token").join(words, "word").select("name", "stop", "stop_name")
    initials = lambda c: F.array_join(F.transform(tokens(normalized(c)), lambda w: F.substring(w, 1, 1)), "")
    own = known.select("stop", "stop_name", initials(F.col("stop_name")).alias("all")).select("stop", "stop_name", F.explode(F.array(*[F.substring("all", 1, n) for n in (2, 3, 4)])).alias("k"))
    by_initials = rest.select("name", normalized(F.col("name")).alias("k")).where(F.length("k").between(2, 4)).join(own, "k").select("name", "stop", "stop_name")
    scored = pairs.unionByName(by_initials).distinct().select("name", "stop", fuzzy_score(F.col("name"), F.col("stop_name")).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "stop")).alias("x")).select("name", "x.stop", (-F.col("x.less")).alias("score"))
    return exact.unionByName(best)


def corridor(patterns: DataFrame, pairs: DataFrame, most: int = 25) -> DataFrame:
    """(a, b, pattern, stops): of all patterns (pattern, stops) that call at a and then at b within ``most`` stops the shortest part between, both included; ties: the smaller pattern."""
    at = patterns.select("pattern", "stops", F.posexplode("stops").alias("i", "a"))
    met = at.join(pairs, "a").withColumn("j", F.array_position(F.slice("stops", F.col("i") + 2, F.size("stops")), F.col("b"))).where((F.col("j") > 0) & (F.col("j") <= most))
    part = F.slice("stops", F.col("i") + 1, F.col("j").cast("int") + 1)
    best = met.groupBy("a", "b").agg(F.min(F.struct("j", "pattern", part.alias("stops"))).alias("x"))
    return best.select("a", "b", "x.pattern", "x.stops")

STORED = "struct<version:int,id:string,title:string,line:string,lines:array<string>,stops:array<string>,valid_from:string,valid_to:string,resolved:boolean>"


def parsed(texts: DataFrame, column: str = "value") -> DataFrame:
    """Stored alerts (JSON text) as rows, with defaults; the first version's single ``line`` becomes the list of the second. Text that is no such JSON, or has no id, is dropped."""
    a = texts.select(F.from_json(column, STORED).alias("a")).select("a.*").where("id is not null")
    empty = F.array().cast("array<string>")
    lines = F.when(F.coalesce("version", F.lit(1)) < 2, F.array_compact(F.array("line"))).otherwise(F.coalesce("lines", empty))
    return a.select("id", F.coalesce("title", F.lit("")).alias("title"), lines.alias("lines"), F.coalesce("stops", empty).alias("stops"), F.col("valid_from").try_cast("timestamp").alias("valid_from"), F.col("valid_to").try_cast("timestamp").alias("valid_to"), F.coalesce("resolved", F.lit(False)).alias("resolved"))

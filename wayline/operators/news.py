"""News and alerts as text: dates, expiry, canonical names, unknown names, bonds with lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Polish month names in the genitive.
MONTHS = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]


def written_date(text: Column) -> Column:
    """The first date in a text, as 12.03.2024, 2024-03-12 or 12 marca 2024; null if there is none."""
    word = F.regexp_extract(F.lower(text), r"(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})", 2)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), word).cast("int")
    part = lambda p, i: F.regexp_extract(F.lower(text), p, i).try_cast("int")
    named = r"(\d{1,2})\s+(?:" + "|".join(MONTHS) + r")\s+(\d{4})"
    dotted, iso = r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"(\d{4})-(\d{2})-(\d{2})"
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    ok = lambda p, c: F.when(text.isNotNull() & F.lower(text).rlike(p), c)
    return F.coalesce(ok(iso, made(part(iso, 1), part(iso, 2), part(iso, 3))), ok(dotted, made(part(dotted, 3), part(dotted, 2), part(dotted, 1))), ok(named, made(part(named, 2), month, part(named, 1))))


def canonical(names: Column, table: Column) -> Column:
    """Names mapped by a table (map of lower-case name to canonical name); unknown ones stay as they are; each once."""
    return F.array_distinct(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, F.lower(n)), n)))


def omitted(stops: Column, first: Column, last: Column, via: Column) -> Column:
    """The stops of a line between two stops that a detour leaves out: those between, less those of ``via``; empty if the two don't come in this order."""
    i, j = F.array_position(stops, first).cast("int"), F.array_position(stops, last).cast("int")
    return F.when((i > 0) & (j > i + 1), F.array_except(F.slice(stops, F.greatest(i + 1, F.lit(1)), F.greatest(j - i - 1, F.lit(0))), via)).otherwise(F.array().cast("array<string>"))


def unknown_names(text: Column, source: Column, allowed: Column) -> Column:
    """Capitalised names in a text that are neither in its source nor allowed."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\b\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)*)"), 1))
    return F.filter(F.array_except(names, allowed), lambda n: ~F.contains(source, n))


def sanitized(text: Column) -> Column:
    """One line without control characters, links, doubled marks and blanks."""
    x = F.regexp_replace(text, r"https?://\S+", "")
    for pattern, by in ((r"[\x00-\x1f\x7f]+", " "), (r"([!?.,])\1+", "$1"), (r"\s+([!?.,])", "$1"), (r"\s+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def about_lines(news: DataFrame, lines: DataFrame) -> DataFrame:
    """(news, line): news (news, tags, text) about lines (line): by a tag, else, for news without tags, by the name as a word of the text.

    The words of a text meet the lines by equality, so no text is compared with every line.
    """
    tagged = news.select("news", F.explode("tags").alias("line")).select("news", F.upper("line").alias("line"))
    word = F.array_distinct(F.filter(F.split(F.upper("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    spoken = news.where(F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0).select("news", F.explode(word).alias("line"))
    known = lines.select(F.upper("line").alias("line")).distinct()
    return tagged.union(spoken).distinct().join(known, "line", "left_semi").select("news", "line")

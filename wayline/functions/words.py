"""Names, lines, platforms, numbers and page text as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The marks that go (U+0300 to U+036F), the letter with a stroke that counts as marked, and what is white space at the ends of names.
FIRST_MARK, LAST_MARK = 0x0300, 0x036F
STROKED = {"ł": "l", "Ł": "l"}
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Words that stand for one another in names.
SYNONYMS = [
    ["pl", "plac"],
    ["dw", "dworzec"],
    ["al", "aleja", "aleje"],
    ["os", "osiedle"],
    ["sw", "swiety", "swietego", "swietej"],
    ["gal", "galeria"],
    ["pkp", "dworzec", "glowny", "kolejowa", "stacja"],
    ["jp2", "jana", "pawla"],
    ["rd", "rondo"],
    ["ul", "ulica"],
]


def bare(text: str) -> str:
    """Canonical decomposition without marks, and l for its form with a stroke: the rule by which ``unmarked`` is made."""
    if text.isascii():
        return text
    return "".join(STROKED.get(x, x) for x in unicodedata.normalize("NFD", text) if not FIRST_MARK <= ord(x) <= LAST_MARK)


@lru_cache(1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """What canonical decomposition makes of letters once marks are gone, by rule: characters that become one other or, at the end, none; and those (but Hangul) that become several."""
    ones, others, none, several = [], [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "\uac00" <= c <= "\ud7a3" or "\ud800" <= c <= "\udfff":
            continue
        told = bare(c)
        if told == c:
            continue
        if len(told) == 1:
            ones.append(c)
            others.append(told)
        elif told:
            several[c] = told
        else:
            none.append(c)
    return "".join(ones + none), "".join(others), several


def _hangul(c: Column) -> Column:
    """A syllable as its two or three letters."""
    i = F.ascii(c) - 0xAC00
    letter = lambda first, n, at: F.element_at(F.array(*[F.lit(chr(first + k)) for k in range(n)]), at.cast("int") + 1)
    tail = F.element_at(F.array(F.lit(""), *[F.lit(chr(0x11A8 + k)) for k in range(27)]), (i % 28).cast("int") + 1)
    return F.concat(letter(0x1100, 19, F.floor(i / 588)), letter(0x1161, 21, F.floor(i % 588 / 28)), tail)


def unmarked(text: Column) -> Column:
    """Canonical decomposition without the marks U+0300 to U+036F, and l for its form with a stroke.

    One pass by a table of single characters; only texts with characters that decompose to several (Hangul, kana with marks, some Indic letters) go character by character.
    """
    ones, others, several = _decomposed()
    plain = F.translate(text, ones, others)
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    one = lambda c: F.when((c >= "\uac00") & (c <= "\ud7a3"), _hangul(c)).otherwise(F.coalesce(F.try_element_at(table, c), c))
    rare = "[\uac00-\ud7a3" + "".join(f"\\x{{{ord(c):x}}}" for c in several) + "]"
    return F.when(plain.rlike(rare), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)


def normalized(name: Column) -> Column:
    """Lower case, without marks on letters, trimmed; null is empty."""
    return F.btrim(unmarked(F.lower(F.coalesce(name, F.lit("")))), F.lit(BLANKS))


def squeezed(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+", "")


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"[\s,./()\\-]+"), lambda t: t != "")


def title_case(name: Column) -> Column:
    """First letters in upper case after a start, a space, - / or (; the others in lower case."""
    marks = F.regexp_replace(F.lower(name), r"([\s\-/(])", "$1\u0001")
    return F.array_join(F.transform(F.split(marks, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, F.length(w)))), "")


def with_synonyms(token: Column) -> Column:
    """The token itself and all words that stand for it."""
    table = {w: sorted({x for g in SYNONYMS if w in g for x in g}) for g in SYNONYMS for w in g}
    out = F.array(token)
    for w, group in table.items():
        out = F.when(token == w, F.array_distinct(F.concat(F.array(token), F.array(*map(F.lit, group))))).otherwise(out)
    return out


def pole_base(name: Column) -> Column:
    """A stop's name without the number of its pole: two digits at the end, or digits in brackets."""
    return F.trim(F.regexp_replace(name, r"\s+(\(\d+\)|\d{2})$", ""))


def line_name(name: Column) -> Column:
    """A line as people write it: without the words for line, tram or bus, upper case, no blanks or leading zeros."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\b(line|linia|tram|tramwaj|bus|autobus|nr)\b\.?", "")
    return F.regexp_replace(F.regexp_replace(F.upper(bare), r"[\s.]+", ""), r"^0+(?=\d)", "")


def platform_key(name: Column) -> Column:
    """Platform or track as a key: Roman numerals up to ten become digits, words around are dropped."""
    bare = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"(PLATFORM|TRACK|PERON|TOR|[\s.:])", "")
    out = bare
    for i, roman in enumerate(("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"), 1):
        out = F.when(bare == roman, str(i)).otherwise(out)
    return F.regexp_replace(out, r"^0+(?=\d)", "")


def trip_base(trip: Column) -> Column:
    """A trip id without the suffixes of variants and dates."""
    return F.regexp_replace(F.regexp_replace(trip, r"[_-]\d{8}$", ""), r"(#|~)\d+$", "")


def number_variants(numbers: Column) -> Column:
    """The train numbers that a text like ``8308/9`` stands for: a shorter part replaces the end of the first one."""
    parts = F.filter(F.transform(F.split(F.coalesce(numbers, F.lit("")), "/"), lambda p: F.regexp_replace(p, r"\D", "")), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    full = F.transform(parts, lambda p: F.when(F.length(p) < F.length(first), F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(p)), p)).otherwise(p))
    return F.array_distinct(F.transform(full, lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalized(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def page_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags; the common entities decoded; blanks made single."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        x = F.regexp_replace(x, f"&{name};", char)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def short_label(text: Column, words: int = 3, chars: int = 26) -> Column:
    """The first words of a text, cut to ``chars`` characters."""
    few = F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, words), " ")
    return F.rtrim(F.substring(few, 1, chars))


def named_lines(text: Column, known: list[str]) -> Column:
    """The known line names that stand in a text as words of their own, in order of the alphabet."""
    seen = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]?[0-9]{1,3}|[A-Z])\b"), 1)
    return F.array_sort(F.array_intersect(seen, F.array(*map(F.lit, sorted(known)))))

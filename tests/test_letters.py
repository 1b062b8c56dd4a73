"""Names without marks, against Python's own decomposition, for every letter there is."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from wayline.functions.words import normalized


def plain(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)
    return bare.replace("ł", "l").replace("Ł", "l")


def test_every_letter(spark):
    letters = [c for c in map(chr, range(0x21, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LM" and c == c.lower() and not c.isspace()]
    rows = [(i, f"a{c}b") for i, c in enumerate(letters)]
    got = {r["i"]: r["n"] for r in spark.createDataFrame(rows, "i long, x string").repartition(4).select("i", normalized(F.col("x")).alias("n")).collect()}
    bad = [(hex(ord(c)), got[i], plain(f"a{c}b")) for i, c in enumerate(letters) if got[i] != plain(f"a{c}b")]
    assert not bad, (len(bad), bad[:5])


def test_case_blanks_and_marks_of_their_own(spark):
    rows = [("  ŁÓDŹ\t", "lodz"), ("été", "ete"), ("İstanbul", "istanbul"), ("Ğ ő ž ā", "g o z a"), (None, ""), ("́", ""), ("ø đ ß", "ø đ ß"), ("한글 が", unicodedata.normalize("NFD", "한글 が")), ("Ệ😀", "e😀")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(normalized(F.col("x"))).collect()]
    assert got == [y for _, y in rows]

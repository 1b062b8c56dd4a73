"""Quotation linking against the SQL and against what a reader would say."""

from __future__ import annotations

import duckdb
import pytest

from wayline.llm.quotes import ORACLE_SQL, without_quotes

A = "We should move the depot to the north side. It has far more room for trams.\n\nThe old yard floods each spring."
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", "On Monday the user wrote:\n> We should move the depot to the north\n> side. It has far more room for trams.\nI agree with all of that, in the main."),
    (1, 2, "user", "> The old yard floods each spring.\n\nThat is what I fear the most by far."),
    (1, 3, "user", "A thought of its own about the new line."),
    (1, 4, "assistant", "> On Monday the user wrote:\n> > It has far more room for trams.\n> I agree with all of that, in the main.\nSo do we, after some thought."),
    (1, 5, "user", "> A thought of its own about the new line.\nGo on, please tell us more of it."),
    (2, 0, "user", "> The old yard floods each spring.\nQuoted from another conversation here."),
    (2, 1, "user", "> Nothing known here at all.\n> OK.\nplain > mark within"),
    (3, 0, "user", ""),
    (3, 1, "user", "  >\n>\n\n"),
    (4, 0, "user", "On a line that only\nsaid:\nno quote follows here"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_links_threads_and_bodies(spark):
    out = {(r["conv_id"], r["turn"]): r for r in without_quotes(frame(spark, ROWS)).collect()}
    assert len(out) == len(ROWS)
    got = {k: (r["reply_to"], r["thread"], r["reply_depth"], r["position"], r["quotes"], r["linked"]) for k, r in out.items()}
    assert got[1, 0] == (None, 0, 0, 0, 0, 0)
    assert got[1, 1] == (0, 0, 1, 1, 1, 1)
    assert got[1, 2] == (0, 0, 1, 2, 1, 1)
    assert got[1, 4] == (1, 0, 2, 3, 2, 2)
    assert got[1, 3] == (None, 3, 0, 4, 0, 0)
    assert got[1, 5] == (3, 3, 1, 5, 1, 1)
    assert got[2, 0][:1] == (None,) and got[2, 0][4:] == (1, 1)
    assert got[2, 1][4:] == (1, 0)
    assert out[1, 1]["body"] == "I agree with all of that, in the main."
    assert out[2, 1]["body"] == "plain > mark within"
    assert out[3, 1]["body"] == ""
    assert out[4, 0]["body"] == "On a line that only\nsaid:\nno quote follows here"


def test_same_as_sql(spark):
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    want = db.execute(ORACLE_SQL)
    names = [d[0] for d in want.description]
    out = without_quotes(frame(spark, ROWS))
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in out.collect())


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "> x"), (5, None, "user", "hello there you"), (5, 1, "user", "> hello there you\nyes"), (5, 1, "user", "> hello there you\nyes")]
    out = without_quotes(frame(spark, rows).selectExpr("*", "1 as body", "2 as position", "3 as thread")).collect()
    assert len(out) == 5
    assert [r["position"] for r in sorted((r for r in out if r["conv_id"] == 5), key=lambda r: r["position"])] == [0, 1, 2]
    assert all(r["reply_to"] is None for r in out)


def test_empty_table(spark):
    assert without_quotes(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [2, 40])
def test_chain_of_replies(spark, n):
    said = [f"Message number {i} says this thing." for i in range(n)]
    rows = [(7, i, "user", (f"> {said[i - 1]}\n" if i else "") + said[i]) for i in range(n)]
    out = sorted(without_quotes(frame(spark, rows)).collect(), key=lambda r: r["turn"])
    assert [r["reply_depth"] for r in out] == list(range(n)) and {r["thread"] for r in out} == {0}


def test_whole_passage_goes_to_the_message_that_has_it(spark):
    stock, own = "We thank you for your letter of today.", "Trams run late."
    rows = [(1, 0, "user", stock), (1, 1, "user", "Nothing of the kind here."), (1, 2, "user", f"{stock} {own}"), (1, 3, "user", f"> {stock} {own}\nWhy is that so?")]
    out = {r["turn"]: r for r in without_quotes(frame(spark, rows)).collect()}
    assert (out[3]["reply_to"], out[3]["thread"], out[3]["reply_depth"]) == (2, 2, 1)


def test_quoters_own_later_copy_hides_no_original(spark):
    said = "The bridge at the mill is closed."
    rows = [(1, 0, "user", f"> {said}\nIs it true?"), (1, 1, "user", said), (2, 0, "user", said)]
    assert {(r["conv_id"], r["turn"]): r["linked"] for r in without_quotes(frame(spark, rows)).collect()} == {(1, 0): 1, (1, 1): 0, (2, 0): 0}


def test_short_and_unspaced_sentences(spark):
    rows = [(1, 0, "user", "Hello to all of you."), (1, 1, "user", "Agreed."), (1, 2, "user", "> Agreed.\nGood."), (1, 3, "user", "\u5317\u4eac\u7684\u7535\u8f66\u4eca\u5929\u665a\u70b9\u4e86"), (1, 4, "user", "> \u5317\u4eac\u7684\u7535\u8f66\u4eca\u5929\u665a\u70b9\u4e86\nYes."), (2, 0, "user", "> Agreed.\nSo."), (2, 1, "user", "> \u5317\u4eac\u7684\u7535\u8f66\u4eca\u5929\u665a\u70b9\u4e86\nNo.")]
    out = {(r["conv_id"], r["turn"]): r for r in without_quotes(frame(spark, rows)).collect()}
    assert (out[1, 2]["reply_to"], out[1, 4]["reply_to"]) == (1, 3)
    assert (out[2, 0]["linked"], out[2, 1]["linked"]) == (0, 1)

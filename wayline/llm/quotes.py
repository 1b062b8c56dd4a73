"""Quotation linking: conversations in reply order, without quotes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import numbered, written

#: Starts a passage in the joined lines of a message; taken out of the lines before.
MARK = "\u0001"
ATTRIBUTION = r"(?i)\b(wrote|writes|said)\s*:$"
SENTENCE_END = r"(?<=[.!?])\s+"
NOT_WORDS = r"[^\p{L}\p{N}]+"
#: Letters of scripts that put no spaces between words: two count as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def quote_lines(text: Column) -> Column:
    """The lines of a text: depth (number of > before the words), content, raw, and whether it only says who is quoted."""

    def line(raw: Column) -> Column:
        return let(F.regexp_extract(raw, r"^[ \t>]*", 0), lambda p: F.struct(F.regexp_count(p, F.lit(">")).alias("depth"), F.trim(F.translate(F.substring(raw, F.length(p) + 1, F.length(raw)), MARK + "\t", "  ")).alias("content"), raw.alias("raw")))

    def told(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(rows, F.when(F.get(rows, i + 1)["content"] == "", i + 2).otherwise(i + 1))
            says = x["content"].rlike(ATTRIBUTION) & F.coalesce(after["depth"] > x["depth"], F.lit(False))
            return F.struct(x["depth"].alias("depth"), x["content"].alias("content"), x["raw"].alias("raw"), says.alias("attribution"))

        return F.transform(rows, one)

    return let(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), line), told)


def body_of(lines: Column) -> Column:
    """The lines outside quotes, as they stand, without blank lines at both ends."""
    own = F.filter(lines, lambda x: (x["depth"] == 0) & ~x["attribution"])
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")


def passages_of(lines: Column) -> Column:
    """Runs of lines of one depth, ended by blank lines, each joined to one text: array of (depth, text)."""

    def coded(rows: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(rows, i - 1)
            goes_on = F.coalesce((i > 0) & (last["depth"] == x["depth"]) & (last["content"] != "") & ~last["attribution"], F.lit(False))
            return F.when((x["content"] == "") | x["attribution"], MARK).otherwise(F.concat(F.when(goes_on, " ").otherwise(F.concat(F.lit(MARK), x["depth"].cast("string"), F.lit(":"))), x["content"]))

        return F.array_join(F.transform(rows, one), "")

    runs = F.filter(F.split(let(lines, coded), MARK), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("depth"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("text")))


def pieces_of(passages: Column, least_words: int) -> Column:
    """Of each passage its sentences, normalised (lower case, words and digits only) and hashed: array of (passage, depth, h1, h2, chars, telling).

    Sentences of fewer than ``least_words`` words are not telling: they are common to messages that have no bond.
    """

    def sentences(p: Column, i: Column) -> Column:
        norm = F.transform(F.split(p["text"], SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_WORDS, " ")))
        telling = lambda s: (F.size(F.split(s, " ")) >= least_words) | (F.regexp_count(s, F.lit(UNSPACED)) >= 2 * least_words)
        return F.transform(F.filter(norm, lambda s: s != ""), lambda s: F.struct(i.alias("passage"), p["depth"].alias("depth"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), F.length(s).alias("chars"), telling(s).alias("telling")))

    return F.flatten(F.transform(passages, sentences))


def quote_links(read: DataFrame, least_words: int = 3) -> DataFrame:
    """(conv_id, turn, passage, depth, source_conv, source_turn, chars): each quoted passage and the message that it comes from.

    ``read``: a written table (conv_id, turn, passages). A passage comes from the earlier message of the same conversation with most
    characters of its sentences outside quotes (ties: the earliest); where there is none, from the first message
    of another conversation, in order of (conv_id, turn), by the same count, of sentences of ``least_words`` words or more. Within a conversation
    all earlier holders count: those that hold the same quoted sentences are brought down to the earliest before the join. For other
    conversations a sentence has its holders in the two least conversations, one of which is not the quoter's.
    Messages with a null conv_id or turn link to nothing.
    """
    pieces = read.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(pieces_of(F.col("passages"), least_words)).alias("p")).select("conv_id", "turn", "p.*")
    quoted = written(pieces.where("depth > 0"), "quoted")
    asked = written(quoted.select("h1", "h2").distinct(), "asked")
    sources = written(pieces.where("depth = 0").select("conv_id", "turn", "h1", "h2", "telling").join(asked, ["h1", "h2"], "left_semi"), "quote-sources")
    kinds = sources.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("held")).groupBy("conv_id", "held").agg(F.min("turn").alias("t"))
    held = kinds.select("conv_id", "t", F.explode("held").alias("s")).select("conv_id", "t", "s.h1", "s.h2")
    passage = ["conv_id", "turn", "passage", "depth"]

    def most(counted: DataFrame) -> DataFrame:
        return counted.groupBy(*passage).agg(F.min(F.struct((-F.col("chars")).alias("less"), "c", "t")).alias("b")).select(*passage, F.col("b.c").alias("source_conv"), F.col("b.t").alias("source_turn"), (-F.col("b.less")).alias("chars"))

    near = quoted.join(held, ["h1", "h2", "conv_id"]).where("t < turn").groupBy(*passage, "t").agg(F.sum("chars").alias("chars")).withColumn("c", F.col("conv_id"))
    near = written(most(near), "near-links")
    holders = sources.where("telling").groupBy("h1", "h2", "conv_id").agg(F.min("turn").alias("t"))
    first = written(holders.groupBy("h1", "h2").agg(F.min(F.struct(F.col("conv_id").alias("c"), "t")).alias("first")), "first-holders")
    second = holders.join(first, ["h1", "h2"]).where(F.col("conv_id") != F.col("first.c")).groupBy("h1", "h2").agg(F.min(F.struct(F.col("conv_id").alias("c"), "t")).alias("second"))
    across = written(first.join(second, ["h1", "h2"], "left"), "two-holders")
    other = F.when(F.col("first.c") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    far = quoted.where("telling").join(near.select(*passage), passage, "left_anti").join(across, ["h1", "h2"]).withColumn("s", other).where("s is not null")
    far = most(far.groupBy(*passage, "s.c", "s.t").agg(F.sum("chars").alias("chars")))
    return near.unionByName(far)


def reply_threads(replies: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, reply_to, thread, reply_depth) of messages with a ``reply_to`` before them, by doubling steps to the root.

    Each round joins every message with where its farthest known ancestor stands; their number grows with the logarithm of the longest chain.
    """
    state = written(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("reply_depth")), "threads-0")
    for r in range(1, max_rounds + 1):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__up"), F.col("reply_depth").alias("__more"))
        step = state.join(up, ["conv_id", "thread"], "left")
        step = step.select("conv_id", "turn", "reply_to", F.coalesce("__up", "thread").alias("thread"), (F.col("reply_depth") + F.coalesce("__more", F.lit(0))).alias("reply_depth"), F.col("__up").isNotNull().alias("__moved"))
        step = written(step, f"threads-{r}")
        moved = step.where("__moved").limit(1).count()
        state = step.drop("__moved")
        if not moved:
            return state
    raise RuntimeError("reply chains did not end")


def without_quotes(messages: DataFrame, least_words: int = 3) -> DataFrame:
    """Conversations in reply order and without quotes: a row per message.

    ``messages``: conv_id, turn, role, text. Adds body (the text without quoted lines and the lines that only say who is quoted), quotes and linked
    (numbers of quoted passages, and of those whose original is known), reply_to (the turn that the outermost quotes come from, by most
    characters; null: the message starts a thread), thread (turn of the thread's first message), reply_depth and position (from 0
    within the conversation). Order: threads by their first turn, messages by turn within, so that each stands after what it answers.
    Repeated rows keep a place each; null texts have an empty body; null turns come first and link to nothing; rows of a null
    conv_id are one conversation. Other columns are dropped. Texts move in one shuffle by ranges, which splits conversations of any length.
    """
    parsed = messages.select("conv_id", "turn", "role", quote_lines(F.col("text")).alias("lines"))
    parsed = parsed.select("conv_id", "turn", "role", let(F.col("lines"), lambda x: F.struct(body_of(x).alias("body"), passages_of(x).alias("passages"))).alias("p")).select("conv_id", "turn", "role", "p.*")
    read = written(parsed, "messages")
    links = written(quote_links(read.select("conv_id", "turn", "passages"), least_words), "quote-links")
    outer = links.where("depth = 1 and source_conv = conv_id").groupBy("conv_id", "turn", "source_turn").agg(F.sum("chars").alias("chars"))
    replies = outer.groupBy("conv_id", "turn").agg(F.min(F.struct((-F.col("chars")).alias("less"), "source_turn")).alias("b")).select("conv_id", "turn", F.col("b.source_turn").alias("reply_to"))
    threads = reply_threads(replies)
    known = links.groupBy("conv_id", "turn").agg(F.count("*").alias("linked"))
    rows = read.select("conv_id", "turn", "role", "body", F.size(F.filter("passages", lambda p: p["depth"] > 0)).cast("long").alias("quotes"))
    rows = rows.join(known, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    rows = rows.select("conv_id", "turn", "role", "body", "quotes", F.coalesce("linked", F.lit(0)).alias("linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("reply_depth", F.lit(0)).alias("reply_depth"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "thread", "turn", "role", "body")]
    placed, _ = numbered(rows, order, "reply-order", "__row")
    first = written(placed.groupBy("conv_id").agg(F.min("__row").alias("__first")).withColumnRenamed("conv_id", "__conv"), "starts")
    placed = placed.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return placed.select(*rows.columns, (F.col("__row") - F.col("__first")).alias("position"))


#: DuckDB SQL for ``without_quotes`` over the table conversations (unique (conv_id, turn), no nulls there).
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations
), raw AS (
  SELECT conv_id, turn, role, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM split
), line AS (
  SELECT *, len(regexp_replace(regexp_extract(raw, '^[ \t>]*'), '[^>]', '', 'g')) AS depth,
    trim(translate(substring(raw, len(regexp_extract(raw, '^[ \t>]*')) + 1), chr(1) || chr(9), '  ')) AS content FROM raw
), near AS (
  SELECT *, lead(depth) OVER w AS d1, lead(content) OVER w AS c1, lead(depth, 2) OVER w AS d2 FROM line WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), told AS (
  SELECT *, regexp_matches(content, '(?i)\b(wrote|writes|said)\s*:$') AND coalesce(CASE WHEN c1 = '' THEN d2 ELSE d1 END > depth, false) AS attribution FROM near
), body AS (
  SELECT conv_id, turn, any_value(role) AS role,
    regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE depth = 0 AND NOT attribution), ''), '^\s+|\s+$', '', 'g') AS body FROM told GROUP BY 1, 2
), breaks AS (
  SELECT *, CASE WHEN lag(depth) OVER w = depth AND lag(content) OVER w <> '' AND NOT lag(attribution) OVER w THEN 0 ELSE 1 END AS new
  FROM told WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM breaks WHERE content <> '' AND NOT attribution
), passages AS (
  SELECT conv_id, turn, passage, depth, string_agg(content, ' ' ORDER BY i) AS text FROM runs GROUP BY ALL
), sentences AS (
  SELECT conv_id, turn, passage, depth, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM passages
), pieces AS (
  SELECT conv_id, turn, passage, depth, trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g')) AS s FROM sentences
), long AS (
  SELECT * FROM pieces WHERE s <> '' AND len(string_split(s, ' ')) >= 3
), within AS (
  SELECT s, conv_id, min(turn) AS own_turn FROM long WHERE depth = 0 GROUP BY 1, 2
), across AS (
  SELECT s, min({'c': conv_id, 't': own_turn}) AS first FROM within GROUP BY 1
), met AS (
  SELECT q.conv_id, q.turn, q.passage, q.depth, len(q.s) AS chars,
    CASE WHEN w.own_turn < q.turn THEN {'far': 0, 'c': q.conv_id, 't': w.own_turn} WHEN a.first.c <> q.conv_id THEN {'far': 1, 'c': a.first.c, 't': a.first.t} END AS src
  FROM long q LEFT JOIN within w ON q.s = w.s AND q.conv_id = w.conv_id LEFT JOIN across a ON q.s = a.s WHERE q.depth > 0
), counted AS (
  SELECT conv_id, turn, passage, depth, src, sum(chars) AS chars FROM met WHERE src IS NOT NULL GROUP BY ALL
), links AS (
  SELECT conv_id, turn, passage, depth, src.c AS c, src.t AS t, chars FROM counted
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, passage, depth ORDER BY src.far, chars DESC, src.c, src.t) = 1
), replies AS (
  SELECT conv_id, turn, t AS reply_to FROM (SELECT conv_id, turn, t, sum(chars) AS chars FROM links WHERE depth = 1 AND c = conv_id GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, t) = 1
), up(conv_id, turn, thread, reply_depth) AS (
  SELECT conv_id, turn, reply_to, 1 FROM replies
  UNION ALL SELECT up.conv_id, up.turn, r.reply_to, up.reply_depth + 1 FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.thread
), threads AS (
  SELECT conv_id, turn, min(thread) AS thread, max(reply_depth) AS reply_depth FROM up GROUP BY 1, 2
), rows AS (
  SELECT b.conv_id, b.turn, b.role, b.body,
    coalesce((SELECT count(*) FROM passages p WHERE p.conv_id = b.conv_id AND p.turn = b.turn AND p.depth > 0), 0) AS quotes,
    coalesce((SELECT count(*) FROM links l WHERE l.conv_id = b.conv_id AND l.turn = b.turn), 0) AS linked,
    r.reply_to, coalesce(t.thread, b.turn) AS thread, coalesce(t.reply_depth, 0)::BIGINT AS reply_depth
  FROM body b LEFT JOIN replies r USING (conv_id, turn) LEFT JOIN threads t USING (conv_id, turn)
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, body) - 1 AS position FROM rows
"""

"""Conversation prefixes as a trie: nodes by prefix sums of turn hashes, subtree totals by leaf peeling, as Spark joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import shuffle_partitions, written

#: 32-bit pieces of a turn's hash. Their sums stay longs without overflow for any conversation of under 2^31 turns.
PIECES = ("p0", "p1", "p2", "p3")


def turns_in_place(turns: DataFrame) -> DataFrame:
    """(conv_id, part, at, role_text, chars): each turn with its place in the conversation, from 0, and the stretch of it that a task held.

    ``turns``: (conv_id, turn, role_text, chars), role_text a hash. Turns are dealt by ranges of their order, so a conversation that holds
    a third of all turns lies in many stretches; a window numbers each stretch, and only counts of stretches meet by conversation.
    """
    dealt = (
        turns.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", F.col("turn").asc_nulls_first(), "role_text", "tie")
        .drop("tie")
        .withColumn("part", F.spark_partition_id())
    )
    dealt = written(dealt, "turns")
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role_text")
    counts = dealt.groupBy("conv_id", "part").count()
    starts = counts.select("conv_id", "part", before("count", "conv_id", "part").alias("start"))
    placed = dealt.withColumn("in_part", F.row_number().over(order) - 1).join(starts, ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("in_part") + F.col("start")).alias("at"), "role_text", "chars")


def before(value: str, key: str, order: str) -> Column:
    """The sum of the key's values before this row."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rebuilt(turns: DataFrame, family: int, borrowed: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, size) and their turns (conv_id, part, depth, role_text, chars), depth from 1.

    A conversation c takes the first h turns of conversation c - c % family, h = crc32(c) % borrowed, and its own turns after its first h.
    Of a conversation that others borrow from, at most borrowed - 1 turns meet with its at most 2 * family borrowers.
    """
    placed = written(turns_in_place(turns), "places")
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("at") < borrowed - 1)).select(F.col("conv_id").alias("base"), "at", "role_text", "chars")
    lengths = heads.groupBy("base").agg(F.count("*").alias("has"))
    convs = counts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    convs = convs.join(lengths, "base", "left").withColumn("takes", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "takes", (F.col("takes") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "rebuilt")
    first = convs.join(heads, "base").where(F.col("at") < F.col("takes")).select("conv_id", F.lit(-1).alias("part"), (F.col("at") + 1).alias("depth"), "role_text", "chars")
    stretches = placed.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).join(convs.select("conv_id", "h", "takes"), "conv_id")
    own = placed.join(stretches, ["conv_id", "part"]).where(F.col("at") >= F.col("h"))
    own = own.select("conv_id", "part", (F.col("at") - F.col("h") + F.col("takes") + 1).alias("depth"), "role_text", "chars")
    return convs.select("conv_id", "size"), first.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds to each rebuilt turn the hash of the prefix that it ends (p0 to p3) and of the one before it (q0 to q3).

    A turn's hash covers its depth, so a prefix is the sum of its turns' hashes, 128 bits wide: sums of stretches add up, and no
    conversation is read in one piece.
    """
    hashed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "role_text"), 256)
    rows = written(turns.withColumn("hashed", hashed).select("conv_id", "part", "depth", "chars", *[F.conv(F.substring("hashed", 8 * i + 1, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(PIECES)]), "hashed-turns")
    sums = rows.groupBy("conv_id", "part").agg(*[F.sum(p).alias(p) for p in PIECES])
    carried = sums.select("conv_id", "part", *[before(p, "conv_id", "part").alias(f"c_{p}") for p in PIECES])
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv_id", "part", "depth", "chars", *[F.col(p).alias(f"own_{p}") for p in PIECES], *[F.sum(p).over(upto).alias(f"sum_{p}") for p in PIECES])
    joined = running.join(carried, ["conv_id", "part"])
    total = {p: F.col(f"sum_{p}") + F.col(f"c_{p}") for p in PIECES}
    return joined.select("conv_id", "depth", "chars", *[total[p].alias(p) for p in PIECES], *[(total[p] - F.col(f"own_{p}")).alias(p.replace("p", "q")) for p in PIECES])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, p0 to p3, ends_sha256) of ``ends`` (conv_id, depth, p0 to p3): the SHA-256 of each node's ids, ascending, comma-joined.

    Ids are dealt by ranges and joined to stretches of text; a second pass feeds the stretches of a node, in order, to its
    hash. So a task holds a batch, and of a node with a third of all conversations only texts of whole batches meet.
    """
    key = ["depth", *PIECES]
    n = shuffle_partitions(ends.sparkSession)
    names = [*key, "first", "ids"]
    kind = "depth long, p0 long, p1 long, p2 long, p3 long, first long, ids string"

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple, list[int]] = {}
            for *k, c in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                rows.setdefault(tuple(k), []).append(c)
            out = [(*k, ids[0], ",".join(map(str, ids))) for k, ids in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 6 else pa.int64()) for i in range(7)], names=names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, h = None, None
        for b in batches:
            done = []
            for *k, _, ids in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if k != held:
                    if held:
                        done.append((*held, h.hexdigest()))
                    held, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string() if i == 5 else pa.int64()) for i in range(6)], names=[*key, "ends_sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if i == 5 else pa.int64()) for i, x in enumerate((*held, h.hexdigest()))], names=[*key, "ends_sha256"])

    cast = ends.select(F.col("depth").cast("long").alias("depth"), *PIECES, "conv_id")
    parts = cast.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(stretches, kind)
    return parts.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(hashes, "depth long, p0 long, p1 long, p2 long, p3 long, ends_sha256 string")


def peel(nodes: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """(conv_id, depth, n_leaves, saved) of each node's whole subtree, by peeling leaves.

    ``nodes``: (conv_id, depth, parent, n_convs, own), parent null at the root. A waiting node counts the children that it still waits for and
    holds their ids xor-ed; a finished node sends its totals to its parent. A node of one conversation has one leaf below and nothing saved and is finished
    at once. When a node waits for one child only, the xor names it: it then asks that child instead of being told, and while
    the child itself waits for one child, it asks that grandchild in its place (its own totals grow by what it passes over), so a chain
    of n nodes takes about log2 n rounds, not n. Each round is a pair of written tables; one count a round meets on the driver. Ends when the root has finished.
    """
    below = nodes.where(F.col("parent").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id"))
    wide = F.col("n_convs") > 1
    below = below.agg(F.sum(wide.cast("long")).alias("left"), F.bit_xor(F.when(wide, F.col("conv_id"))).alias("kids"), F.sum((~wide).cast("long")).alias("done"), F.count("*").alias("children"))
    state = nodes.where(wide | (F.col("depth") == 0)).select("conv_id", "depth", "parent", "own").join(below, ["conv_id", "depth"], "left")
    state = state.select("conv_id", "depth", "parent", F.coalesce("left", F.lit(0)).alias("left"), (F.col("depth") + 1).alias("kid_depth"), F.coalesce("kids", F.lit(0)).alias("kids"), F.when(F.coalesce("children", F.lit(0)) == 0, 1).otherwise(F.col("done")).cast("long").alias("leaves"), F.col("own").alias("saved"))
    state = written(state, "peel-0")
    out = [nodes.where(~wide & (F.col("depth") > 0)).select("conv_id", "depth", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))]
    fresh = state.where("left = 0")
    waiting = state.where("left > 0")
    for r in range(1, most_rounds + 1):
        out.append(fresh.select("conv_id", "depth", F.col("leaves").alias("n_leaves"), "saved"))
        if not waiting.limit(1).count():
            break
        told = fresh.where(F.col("parent").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id"))
        told = told.agg(F.count("*").alias("t_n"), F.bit_xor("conv_id").alias("t_kids"), F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
        many = waiting.where("left > 1").join(told, ["conv_id", "depth"], "left")
        many = many.select("conv_id", "depth", "parent", (F.col("left") - F.coalesce("t_n", F.lit(0))).alias("left"), "kid_depth", F.col("kids").bitwiseXOR(F.coalesce("t_kids", F.lit(0))).alias("kids"), (F.col("leaves") + F.coalesce("t_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("t_saved", F.lit(0))).alias("saved"))
        asked = fresh.select(F.col("conv_id").alias("kids"), F.col("depth").alias("kid_depth"), F.lit(True).alias("ended"), F.col("leaves").alias("k_leaves"), F.col("saved").alias("k_saved"))
        chain = waiting.where("left = 1").join(asked, ["kids", "kid_depth"], "left")
        chain = written(chain.withColumn("ended", F.coalesce("ended", F.lit(False))), f"chain-{r}")
        ended = chain.where("ended").select("conv_id", "depth", "parent", F.lit(0).cast("long").alias("left"), "kid_depth", "kids", (F.col("leaves") + F.col("k_leaves")).alias("leaves"), (F.col("saved") + F.col("k_saved")).alias("saved"))
        still = chain.where("not ended")
        over = still.select(F.col("conv_id").alias("kids"), F.col("depth").alias("kid_depth"), F.col("kids").alias("n_kids"), F.col("kid_depth").alias("n_depth"), F.col("leaves").alias("k_l"), F.col("saved").alias("k_s"))
        still = still.join(over, ["kids", "kid_depth"], "left").select("conv_id", "depth", "parent", "left", F.coalesce("n_depth", "kid_depth").alias("kid_depth"), F.coalesce("n_kids", "kids").alias("kids"), (F.col("leaves") + F.coalesce("k_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("k_s", F.lit(0))).alias("saved"))
        state = written(many.unionByName(ended).unionByName(still), f"peel-{r}")
        fresh, waiting = state.where("left = 0"), state.where("left > 0")
    else:
        raise RuntimeError(f"the root did not finish in {most_rounds} rounds")
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def conversation_trie(conversations: DataFrame, family: int = 100, borrowed: int = 6) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Turns are ordered by turn, null first; ties by the hash of role and text. Null role
    or text is empty; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and take no part. An empty table gives the root alone,
    with no conv_id and no members. Two prefixes are one node if the 128-bit sums of their turns' SHA-256 are equal.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("role_text"), F.char_length(text).cast("long").alias("chars"))
    convs, rows = rebuilt(turns, family, borrowed)
    rows = written(prefixes(rows), "prefixes")
    q = [p.replace("p", "q") for p in PIECES]
    nodes = written(rows.groupBy("depth", *PIECES, *q).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(p).alias(b) for p, b in zip(PIECES, q, strict=True)], F.col("conv_id").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    top = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("own"), *[F.lit(0).cast("long").alias(p) for p in PIECES])
    least = root.first()[0]
    shape = lambda df, parent: df.select("conv_id", F.col("depth").cast("long").alias("depth"), parent, "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), *PIECES)
    first = shape(nodes.where("depth = 1"), F.lit(least).cast("long").alias("parent"))
    deeper = shape(nodes.where("depth > 1").join(above, ["depth", *q]), F.col("parent"))
    nodes = written(top.unionByName(first).unionByName(deeper), "trie")
    last = rows.join(convs, "conv_id").where(F.col("depth") == F.col("size")).select("conv_id", "depth", *PIECES)
    none = convs.where("size = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(p) for p in PIECES])
    ends = ends_hashes(last.withColumn("depth", F.col("depth").cast("long")).unionByName(none))
    children = nodes.where(F.col("parent").isNotNull()).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"))
    named = nodes.join(ends, ["depth", *PIECES], "left").select("conv_id", "depth", "parent", "n_convs", "ends_sha256")
    if least is None:
        return named.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"))
    out = named.join(children, ["conv_id", "depth"], "left").join(peel(nodes), ["conv_id", "depth"])
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: The same by aggregates over each node's members: a leaf counts where its smallest member passes, and so does what a node saves.
ORACLE_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(x ORDER BY pos) AS own FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, own, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END)) AS s
  FROM lists),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.own[1:xor(c.s, 4294967295::BIGINT) % 6], []) || coalesce(c.own[xor(c.s, 4294967295::BIGINT) % 6 + 1:], []) AS seq
  FROM crc c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
members AS (
  SELECT conv_id, d AS depth, seq[1:d] AS prefix, len(seq) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(seq[d].t) END AS chars
  FROM rebuilt, unnest(range(len(seq) + 1)) AS u(d)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix),
tied AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tied WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tied t LEFT JOIN kids k USING (conv_id, depth)),
ledger AS (
  SELECT conv_id, depth AS d, (n_convs - 1) * chars AS own, n_children = 0 AS leaf FROM full_nodes),
sums AS (
  SELECT m.depth, m.prefix, sum(l.own) AS saved_tokens, count(*) FILTER (WHERE l.leaf) AS n_leaves
  FROM members m JOIN ledger l ON l.conv_id = m.conv_id AND l.d >= m.depth GROUP BY m.depth, m.prefix)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.depth = f.depth AND s.prefix = f.prefix
"""

"""Sharding by a Feistel permutation of global row numbers, in column expressions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import numbered

PRIME = (1 << 31) - 1


def halves(total: int) -> tuple[int, int]:
    """a x b at least ``total`` and as little above as factors near the square root allow."""
    s = max(1, isqrt(total))
    a = min(range(max(1, s // 8), s + 1), key=lambda x: (-(-total // x) * x - total, -x))
    return a, max(1, -(-total // a))


def round_keys(seed: int, rounds: int) -> list[tuple[int, ...]]:
    """Six constants for each pair of rounds, from the seed by a multiplicative generator."""
    x, out = seed % (PRIME - 1) + 1, []
    for _ in range(rounds // 2):
        row = []
        for _ in range(6):
            for _ in range(3):
                x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def _mixed(x, k1, k2, k3):
    """A square between two affine steps modulo a prime; for ints and for columns alike (all below 2^62)."""
    t = (x * k1 + k2) % PRIME
    return (t * t + k3) % PRIME


def locate(row: int, total: int, shards: int, seed: int, rounds: int = 6) -> tuple[int, int]:
    """(shard, slot) of a global row number, computed alone."""
    a, b = halves(total)
    p = row
    while True:
        left, right = p % a, p // a
        for k in round_keys(seed, rounds):
            left = (left + _mixed(right, *k[:3])) % a
            right = (right + _mixed(left, *k[3:])) % b
        p = right * a + left
        if p < total:
            return p % shards, p // shards


def permuted(row: Column, total: int, seed: int, rounds: int = 6) -> Column:
    """The place of ``row`` under the permutation of 0 .. total-1.

    The network permutes 0 .. a*b-1; places beyond total walk on along their cycle. Only a*b-total places lie
    beyond, so one step more than that always ends the walk.
    """
    a, b = halves(total)
    names = [f"k{i}" for i in range(6)]
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(k, names, strict=True)]) for k in round_keys(seed, rounds)])

    def pair(s: Column, k: Column) -> Column:
        left = (s["l"] + _mixed(s["r"], *[k[n] for n in names[:3]])) % a
        return F.struct(left.alias("l"), ((s["r"] + _mixed(left, *[k[n] for n in names[3:]])) % b).alias("r"))

    def once(p: Column) -> Column:
        begin = F.struct((p % a).alias("l"), F.call_function("div", p, F.lit(a).cast("long")).alias("r"))
        return F.aggregate(keys, begin, pair, lambda s: s["r"] * F.lit(a).cast("long") + s["l"])

    steps = F.sequence(F.lit(1), F.lit(max(1, a * b - total)))
    first = once(row.cast("long"))
    return first if a * b == total else F.aggregate(steps, first, lambda p, _: F.when(p < total, p).otherwise(once(p)))


def sharded(df: DataFrame, order: list, shards: int, seed: int, name: str = "shards") -> DataFrame:
    """Adds row_number, shard and slot: a reproducible shuffle into shards whose counts differ by one at most.

    Row numbers follow ``order``; rows that are equal there are told apart by where Spark read them, which
    only matters to columns outside the order. Slots of a shard are 0, 1, ... without gaps. Empty input gives
    no rows. An input column of a name that is added is replaced.
    """
    rows, total = numbered(df.drop("row_number", "shard", "slot"), order, name, "row_number")
    place = permuted(F.col("row_number"), max(1, total), seed)
    return rows.withColumn("__place", place).withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn("slot", F.call_function("div", F.col("__place"), F.lit(shards).cast("long"))).drop("__place")


def shard_documents(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text and 8 more), text_crc32, law, shard, slot, grown_shard.

    Law ``rows``. Rows are numbered by doc_id (nulls first), crc and size. Null text has no bytes: size 8, crc 0.
    Repeated rows and null ids each get a place of their own. Texts are not moved, only their crc.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharded(rows, [F.col(c).asc_nulls_first() for c in rows.columns[:1]] + [F.col("text_crc32"), F.col("size")], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Keeping one row of several: first, last, newest; merging tables; set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_of_each(df: DataFrame, keys: list[str], order: list[Column], first: bool = True) -> DataFrame:
    """The first (or last) row of each key in an order. As an aggregate of the least struct: rows combine before the shuffle, so a hot key costs no more than others.

    ``order``: ascending columns that tell rows apart; what is equal there may be either row.
    """
    rest = [c for c in df.columns if c not in keys]
    names = [f"__o{i}" for i in range(len(order))]
    whole = F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)], *rest)
    pick = F.min(whole) if first else F.max(whole)
    return df.groupBy(*keys).agg(pick.alias("__x")).select(*[F.col(c) if c in keys else F.col(f"__x.{c}").alias(c) for c in df.columns])


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the changes: the change latest in ``order`` replaces the row of its key."""
    latest = one_of_each(changes, keys, [F.col(order)], first=False).drop(order)
    return current.join(latest, keys, "left_anti").unionByName(latest.select(*current.columns))


def merged_backup(current: DataFrame, incoming: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Both, with the incoming row of an id that both have; the ``most`` newest of all (a limit by design: the backup's cap)."""
    rows = current.join(incoming, key, "left_anti").unionByName(incoming)
    return rows.orderBy(F.desc(at), key).limit(most)


def union_first_wins(parts: list[DataFrame], key: Column) -> DataFrame:
    """All parts, with the earliest part's row where keys are equal."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i)).withColumn("__key", key)
        rows = p if rows is None else rows.unionByName(p)
    order = [F.col("__part"), *[F.col(c) for c in parts[0].columns]]
    return one_of_each(rows, ["__key"], order).select(*parts[0].columns)


def newest_state(feed: DataFrame, key: str, finished: str, start: str) -> DataFrame:
    """One row per key: what runs still goes before what has finished, then the later start."""
    rest = [c for c in feed.columns if c != key]
    best = F.max(F.struct((~F.col(finished)).alias("__live"), F.col(start).alias("__start"), *rest))
    return feed.groupBy(key).agg(best.alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def distinct_latest(df: DataFrame, columns: list[str], at: str) -> DataFrame:
    """Distinct rows of some columns with the latest time that each was seen, newest first."""
    return df.groupBy(*columns).agg(F.max(at).alias(at)).orderBy(F.desc(at), *columns)


def within_repeats(df: DataFrame, key: list[str], at: str, gap: int) -> DataFrame:
    """Runs of rows of a key that follow one another within ``gap`` seconds, as one row: key, first, last, n. A session window, so rows combine before the shuffle's end."""
    w = F.session_window(F.col(at), f"{gap} seconds")
    return df.groupBy(*key, w).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).select(*key, "first", "last", "n")


def evicted(df: DataFrame, pinned: str, at: str, key: str, most: int) -> DataFrame:
    """Rows that go: of those not pinned all but the ``most`` newest (the cap of a cache)."""
    keep = df.where(~F.col(pinned)).orderBy(F.desc(at), F.desc(key)).limit(most).select(key)
    return df.where(~F.col(pinned)).join(keep, key, "left_anti")


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark keeps n a key in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def needs_work(rows: DataFrame, done: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Rows whose content differs from what was done under the same key (key, hash), with the new ``hash``."""
    now = rows.withColumn("hash", F.sha2(F.to_json(F.struct(*content)), 256))
    return now.join(done.select(key, "hash"), [key, "hash"], "left_anti")


def monitored(rides: DataFrame, now: Column, before: int = 7_200, after: int = 7_200, ahead: int = 3_600, least_delay: int = 3_600) -> DataFrame:
    """Rides (added, scheduled, boarding, arrival, delay; seconds) with ``watched`` (from ``before`` seconds before boarding to ``after`` after the arrival, which is never before boarding) and ``candidate``.

    A candidate was added at least ``ahead`` seconds before its scheduled departure, with a known delay below ``least_delay``, and is watched. A null time or delay is no candidate's, and a null time isn't watched.
    """
    watched = (now >= F.col("boarding") - before) & (now <= F.greatest("arrival", "boarding") + after) & F.col("arrival").isNotNull()
    early = (F.col("added") <= F.col("scheduled") - ahead) & (F.col("delay") < least_delay)
    return rides.withColumn("watched", F.coalesce(watched, F.lit(False))).withColumn("candidate", F.coalesce(watched & early, F.lit(False)))

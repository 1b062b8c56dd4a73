"""Journeys as nested segments: clean-up, choice and order. All column expressions or grouped plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = "struct<kind:string,line:string,trip:bigint,board:bigint,alight:bigint,dep:bigint,arr:bigint,metres:double,stops:int>"
SEGMENTS = f"array<{SEGMENT}>"


def rides(segments: Column) -> Column:
    return F.filter(segments, lambda s: s["kind"] != "walk")


def merged_walks(segments: Column) -> Column:
    """Walks that follow one another as one: from the first's start to the last's end, metres added."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["kind"].alias("kind"), last["line"].alias("line"), last["trip"].alias("trip"), last["board"].alias("board"), s["alight"].alias("alight"), last["dep"].alias("dep"), s["arr"].alias("arr"), (last["metres"] + s["metres"]).alias("metres"), last["stops"].alias("stops")).cast(SEGMENT)
        both = (F.size(acc) > 0) & (s["kind"] == "walk") & (F.when(F.size(acc) > 0, last["kind"]) == "walk")
        return F.when(both, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(segments, F.array().cast(SEGMENTS), add)


def pointless(segments: Column, walk: float = 500.0, egress: float = 350.0) -> Column:
    """One ride of a single stop that comes with more than ``walk`` metres on foot, or more than ``egress`` after it; cable cars are exempt."""
    metres = F.aggregate(F.filter(segments, lambda s: s["kind"] == "walk"), F.lit(0.0), lambda a, s: a + s["metres"])
    last = F.try_element_at(segments, F.lit(-1))
    short = (F.size(rides(segments)) == 1) & F.exists(segments, lambda s: (s["kind"] != "walk") & (s["kind"] != "cable") & (s["stops"] <= 1))
    return short & ((metres > walk) | ((last["kind"] == "walk") & (last["metres"] > egress)))


def combination(segments: Column) -> Column:
    """The lines of a journey, in order."""
    return F.array_join(F.transform(rides(segments), lambda s: s["line"]), "+")


def identity(segments: Column) -> Column:
    """A key of what a journey is: its rides by line and times."""
    return F.sha2(F.to_json(F.transform(rides(segments), lambda s: F.struct(s["line"], s["dep"], s["arr"]))), 256)


def chosen(journeys: DataFrame, now: int = 0, penalty: float = 300.0, per_line: int = 5, apart: int = 120, most: int = 10) -> DataFrame:
    """The proposals for each query (q, dep, arr, transfers, segments): one of each identity, no more than ``per_line`` of one combination of
    lines and those ``apart`` seconds apart, the ``most`` cheapest by arrival and transfers; the earliest arrival always is among them, first if it isn't so by cost.

    A limit by design: it is the length of a list of proposals.
    """
    from pyspark.sql.window import Window

    from wayline.operators.patterns import spaced

    rows = journeys.where(~pointless(F.col("segments"))).withColumn("cost", F.col("arr") - F.lit(now) + F.col("transfers") * penalty).withColumn("key", identity(F.col("segments"))).withColumn("combo", combination(F.col("segments")))
    one = rows.groupBy("q", "key").agg(F.min(F.struct("cost", "arr", "dep", "transfers", "combo", "segments")).alias("x")).select("q", "key", "x.*")
    kept = spaced(one, ["q", "combo"], ["cost", "arr", "dep", "key"], "dep", per_line, apart)
    by_cost = F.row_number().over(Window.partitionBy("q").orderBy("cost", "arr", "dep", "key"))
    by_arrival = F.row_number().over(Window.partitionBy("q").orderBy("arr", "cost", "dep", "key"))
    ranked = kept.withColumn("place", by_cost).withColumn("early", by_arrival)
    ranked = ranked.withColumn("place", F.when((F.col("early") == 1) & (F.col("place") > most), 0).otherwise(F.col("place")))
    again = F.row_number().over(Window.partitionBy("q").orderBy("place"))
    return ranked.withColumn("place", again).where(F.col("place") <= most).drop("early", "key")


def with_walk_only(journeys: DataFrame, walks: DataFrame) -> DataFrame:
    """Drops journeys that a walk alone (q, seconds, from ``dep``) beats, and adds the walk as a journey without rides."""
    kept = journeys.join(walks.select("q", F.col("seconds").alias("__w"), F.col("dep").alias("__d")), "q", "left").where(F.col("__w").isNull() | (F.col("arr") < F.col("__d") + F.col("__w"))).drop("__w", "__d")
    own = walks.select("q", "dep", (F.col("dep") + F.col("seconds")).alias("arr"), F.lit(0).alias("transfers"), F.array().cast(SEGMENTS).alias("segments"))
    return kept.unionByName(own.select(*[F.col(c).cast(kept.schema[c].dataType) for c in kept.columns]))


def moved(segments: Column, delays: Column) -> Column:
    """Times with the delays (map trip → seconds) of the rides; a walk takes the shift of the ride before it, at the start that of the next."""
    shift = lambda s: F.coalesce(F.try_element_at(delays, s["trip"]), F.lit(0))
    own = F.transform(segments, lambda s: F.when(s["kind"] == "walk", F.lit(None).cast("bigint")).otherwise(shift(s).cast("bigint")))

    def one(s: Column, i: Column) -> Column:
        before = F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), F.array_compact(F.slice(own, 1, i + 1))), -1)
        after = F.get(F.array_compact(own), F.lit(0))
        by = F.coalesce(before, after, F.lit(0))
        return s.withField("dep", s["dep"] + by).withField("arr", s["arr"] + by)

    return F.transform(segments, one)


def stale_leg(legs: Column, now: Column, most: int = 300) -> Column:
    """The delay that is known best: of the last leg that was updated within ``most`` seconds, else of an earlier such leg; null if none was."""
    known = F.filter(legs, lambda x: x["delay"].isNotNull() & (now - x["updated"] <= most))
    return F.when(F.size(known) > 0, F.try_element_at(known, F.lit(-1))["delay"])


def slice_between(stops: Column, board: Column, alight: Column) -> Column:
    """The part of a stop sequence from ``board`` to the first ``alight`` after it; null if they don't come so."""
    i = F.array_position(stops, board).cast("int")
    rest = F.slice(stops, F.greatest(i, F.lit(1)) + 1, F.size(stops))
    j = F.array_position(rest, alight).cast("int")
    return F.when((i > 0) & (j > 0), F.slice(stops, F.greatest(i, F.lit(1)), j + 1))


def without_repeats(points: Column) -> Column:
    """Points without those equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | ~F.coalesce(F.get(points, i - 1).eqNullSafe(p), F.lit(False)))


def _front_of(points: np.ndarray) -> np.ndarray:
    """Positions of the rows that no other beats (at most as large in all, smaller in one); of equal ones the first."""
    order = np.lexsort(points.T[::-1])
    kept: list[int] = []
    held = np.empty((0, points.shape[1]))
    for i in order:
        if not (held <= points[i]).all(axis=1).any():
            kept.append(int(i))
            held = np.vstack([held, points[i]])
    return np.array(kept, np.int64)


def front(rows: DataFrame, key: str, small: list[str], deals: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """(key, small...): of each key the distinct combinations of values, all wanted small, that no other beats. Nulls take no part.

    A tree of partial fronts: rows of a key are dealt to 64 tasks, each passes on its front, then to 8, then one. What a task holds is a front, so a key with a third of all rows is no hot key; a value that is
    in no partial front is in none.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, *small).schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            values = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(small))], axis=1) if len(b) else np.empty((0, len(small)))
            table = pa.Table.from_batches([b]).select(range(len(small) + 1))
            for k in dict.fromkeys(keys.tolist()):
                at = np.nonzero(keys == k)[0]
                before = held.get(k)
                points = values[at] if before is None else np.vstack([before[0], values[at]])
                own = table.take(pa.array(at))
                own = own if before is None else pa.concat_tables([before[1], own])
                keep = _front_of(points)
                held[k] = (points[keep], own.take(pa.array(keep)))
        for _, own in held.values():
            yield from own.combine_chunks().to_batches()

    out = rows.select(key, *small).dropna()
    for n in deals:
        out = out.withColumn("__deal", F.pmod(F.xxhash64(*small), F.lit(n))).repartition(key, "__deal").mapInArrow(part, kind)
    return out


def weighed_skyline(journeys: DataFrame, key: str = "q", plain: tuple[str, ...] = ("arr", "transfers", "cost"), walk: str = "walk", slack: int = 30) -> DataFrame:
    """Journeys that no other of their key beats: at most as large in the ``plain`` criteria, walking at most ``slack`` seconds more, and better in one of them or walking over ``slack`` seconds less.

    Walks within the slack count as equal, which isn't transitive, so a beaten journey can beat others. It is enough to hold all against the front of plain comparisons: whatever beats one is beaten by, or is,
    a row of that front which beats it too. The front is small and comes from partial fronts; a hot key's rows meet it where the skew join deals them.
    """
    best = front(journeys, key, [*plain, walk])
    best = best.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in (*plain, walk)])
    least = [F.col(f"__{c}") <= F.col(c) for c in plain]
    better = [F.col(f"__{c}") < F.col(c) for c in plain]
    beaten = F.col(f"__{walk}") <= F.col(walk) + slack
    less = F.col(f"__{walk}") < F.col(walk) - slack
    for c in least:
        beaten &= c
    for c in better:
        less |= c
    return journeys.join(best, (journeys[key] == best["__k"]) & beaten & less, "left_anti")


def boarded_choice(journeys: DataFrame, per_line: int = 3, most: int = 12) -> DataFrame:
    """What a rider inside a vehicle is offered of (q, chain, combo, arr, transfers, walk, cost): one journey a chain of rides, the cheapest, of which none beats another whatever its departure, ``per_line`` of a combination of
    lines, the ``most`` cheapest, with place from 1. The earliest arrival (then the cheapest) of all that stand is always among them, last if it isn't so by cost. Lists by design.
    """
    from pyspark.sql.window import Window

    order = ["cost", "transfers", "arr", "chain"]
    rest = [c for c in journeys.columns if c not in ("q", "chain", *order)]
    one = journeys.groupBy("q", "chain").agg(F.min(F.struct("cost", "transfers", "arr", *rest)).alias("x")).select("q", "chain", "x.*")
    stands = weighed_skyline(one)
    line = F.row_number().over(Window.partitionBy("q", "combo").orderBy(*order))
    early = F.row_number().over(Window.partitionBy("q").orderBy("arr", *order))
    ranked = stands.withColumns({"__line": line, "__early": early}).where((F.col("__line") <= per_line) | (F.col("__early") == 1))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("__line") > per_line, *order))
    ranked = ranked.withColumn("place", place).withColumn("__n", F.count("*").over(Window.partitionBy("q")))
    fastest = (F.col("__early") == 1) & (F.col("place") > most)
    ranked = ranked.withColumn("__late", F.max(fastest.cast("int")).over(Window.partitionBy("q")))
    kept = ranked.where((F.col("place") <= most - F.col("__late")) | fastest)
    return kept.withColumn("place", F.least(F.col("place"), F.lit(most))).drop("__line", "__early", "__n", "__late")

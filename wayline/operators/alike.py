"""Stops and queries that are alike: a search runs over one of each kind, and what it finds is told for all of them.

Stops without calls at one place are reached alike, and queries that begin at such stops of one place at the same times find the same. So the rounds of a search grow with places, stops with calls and different
times, whatever the number of stops and queries; only the result has a row for each query and stop, and those are made last, in the tasks that give them out: they are in no shuffle and no written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.spatial import footpaths
from wayline.operators.tables import cut, dealt, tasks

#: Result rows that one task gives out; it holds none of them.
ROWS_TOLD = 4_000_000


def places(stops: DataFrame, stop_times: DataFrame, metres: float = 800.0) -> tuple[DataFrame, DataFrame]:
    """(stop, node) of all stops (stop, lat, lon) and stops with calls, and the walks (a, b, seconds) between nodes.

    A node is a stop with calls, one that has several places, or all other stops of a place, by the least of them; these have a walk to themselves, which is that from one of them to another.
    """
    own = stop_times.select("stop").distinct().union(stops.groupBy("stop").count().where("count > 1").select("stop")).distinct().withColumn("own", F.lit(True))
    rows = cut(stops.select("stop", "lat", "lon").join(own, "stop", "full"))
    least = rows.where("own is null").groupBy("lat", "lon").agg(F.min("stop").alias("least"))
    spots = cut(rows.join(least, ["lat", "lon"], "left").select("stop", "lat", "lon", F.when(F.col("own"), F.col("stop")).otherwise(F.coalesce("least", "stop")).alias("node"), F.col("own").isNull().alias("many")))
    return spots.select("stop", "node").distinct(), cut(footpaths(spots.select(F.col("node").alias("stop"), "lat", "lon", "many").distinct(), metres).select("a", "b", "seconds"))


def asks(queries: DataFrame, nodes: DataFrame, *times: str) -> tuple[DataFrame, DataFrame]:
    """The different queries among ``queries`` (q, stop, *times): (q, stop, *times) of one of each kind, at nodes, and (q, c, stop, node, *times) of all, ``c`` the one that stands for them."""
    rows = cut(queries.select("q", "stop", *[F.col(c).cast("long").alias(c) for c in times]).join(nodes, "stop", "left").withColumn("node", F.coalesce("node", "stop")))
    kinds = rows.groupBy("q").agg(F.array_sort(F.collect_set(F.struct("node", *times))).alias("kind"))
    first = cut(kinds.groupBy("kind").agg(F.min("q").alias("c")))
    own = cut(rows.join(kinds.join(first, "kind").select("q", "c"), "q"))
    return first.select(F.col("c").alias("q"), F.explode("kind").alias("x")).select("q", F.col("x.node").alias("stop"), *[f"x.{c}" for c in times]), own


def told(found: DataFrame, nodes: DataFrame, own: DataFrame, before: str | None = None) -> DataFrame:
    """``found`` (q, stop, ...) of kinds and nodes for all queries and stops. ``before``: the column of ``own`` that a time ``arr`` at a query's own stop must lie before: there the query was from the start."""
    spark, rest = found.sparkSession, [c for c in found.columns if c not in ("q", "stop")]
    rows = cut(found.select(F.col("q").alias("c"), F.col("stop").alias("node"), *rest))
    members = own.select("c", "q").distinct()
    back = None
    if before is not None:
        home = own.groupBy("c", "node", "q", "stop").agg(F.min(before).alias("__before"))
        at = home.select("c", "node").distinct()
        back = cut(rows.join(at, ["c", "node"], "left_semi"))
        rows = rows.join(at, ["c", "node"], "left_anti")
        back = back.join(members, "c").join(nodes, "node").join(home, ["c", "node", "q", "stop"], "left").where("__before is null or arr < __before").select("q", "stop", *rest)
    n = [members.groupBy("c").agg(F.count("*").alias("__q")), nodes.groupBy("node").agg(F.count("*").alias("__s"))]
    many = rows.join(n[0], "c").join(n[1], "node").agg(F.sum(F.col("__q") * F.col("__s"))).first()[0] or 0
    sets = rows.join(dealt(members, ["c"], "q", "__qs"), "c").join(dealt(nodes, ["node"], "stop", "__stops"), "node").repartition(tasks(spark, many, ROWS_TOLD))
    out = sets.withColumn("q", F.explode("__qs")).withColumn("stop", F.explode("__stops")).select("q", "stop", *rest)
    return out if back is None else out.unionByName(back)

"""Many rows at one place or one time: every pair of them would be hundreds of millions of rows."""

from pyspark.sql import functions as F

from wayline.operators import live, spatial, stations, tracking
from wayline.operators.tables import tasks

MANY = 40_000


def spot(spark, key, *more):
    """MANY rows at one place."""
    return spark.range(MANY).select(F.col("id").alias(key), F.lit(51.0).alias("lat"), F.lit(17.0).alias("lon"), *more)


def riders(spark):
    return spot(spark, "p").select("p", F.col("lat").alias("p_lat"), (F.col("lon") + 0.001).alias("p_lon"))


def test_pairs_are_made_in_many_tasks(spark):
    s = spark.range(64).select(F.col("id").alias("stop"), F.lit(51.0).alias("lat"), F.lit(17.0).alias("lon"))
    walks = spatial.footpaths(s)
    assert walks.count() == 64 * 63
    assert walks.rdd.getNumPartitions() >= tasks(spark)


def test_interchanges_only_hubs_look_far(spark):
    s = spark.createDataFrame([(1, 51.0, 17.0), (2, 51.02, 17.0), (3, 51.0, 17.001)], "stop long, lat double, lon double")
    side = lambda p: s.select(F.col("stop").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    got = {(r["a"], r["b"]) for r in spatial.interchanges(side("a"), side("b"), s.where("stop = 3"), metres=600.0, hub_metres=4000.0).collect()}
    assert got == {(1, 3), (2, 3)}


def test_nearest_stops_of_a_crowd(spark):
    out = spatial.nearest(riders(spark), spot(spark, "stop"), k=2)
    assert out.groupBy("stop", "rank").count().orderBy("rank").collect() == [(0, 1, MANY), (1, 2, MANY)]


def test_weight_around_a_crowd(spark):
    out = spatial.weight_around(riders(spark), spot(spark, "stop", F.lit(1).alias("weight")))
    assert [tuple(r) for r in out.groupBy("weight").count().collect()] == [(MANY, MANY)]


def test_amenities_in_a_crowd(spark):
    s = spot(spark, "stop")
    area = s.where("stop = 5").select("stop", F.array(*[F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon")) for y, x in ((-0.01, -0.01), (-0.01, 0.01), (0.01, 0.01), (0.01, -0.01))]).alias("points"))
    out = stations.amenities(s, spot(spark, "id", F.concat(F.lit("k"), F.col("id") % 3).alias("kind")), area)
    assert [tuple(r) for r in out.groupBy("kinds").count().collect()] == [(["k0", "k1", "k2"], MANY)]


def test_best_entrance_in_a_crowd(spark):
    e = spot(spark, "entrance", (-F.col("id")).alias("place"), (F.col("id") % 2 == 0).alias("step_free"))
    out = stations.best_entrance(spot(spark, "p").select("p", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), e, other_than_itself=True)
    got = dict(out.groupBy("entrance").count().collect())
    # read from the last one down, the step-free one before it in number wins over the stepped one; it takes the next
    assert got == {MANY - 2: MANY - 1, MANY - 4: 1}


def test_saved_place_of_a_crowd(spark):
    out = tracking.nearest_saved(riders(spark), spot(spark, "place"), spark.range(7).select(F.col("id").alias("place")))
    assert [tuple(r) for r in out.groupBy("place").count().collect()] == [(7, MANY)]


def test_matches_need_a_call_of_the_route(spark):
    """Stops around a vehicle at which its route doesn't call make no rows."""
    v = spot(spark, "vehicle", F.lit(1).alias("route"), F.lit(1000).alias("sec"))
    calls = spark.createDataFrame([(1, 9, 3, 900), (2, 9, 4, 900)], "route long, trip long, stop long, dep long")
    out = live.schedule_matches(v, calls, spot(spark, "stop"))
    assert [tuple(r) for r in out.groupBy("trip", "score", "delay", "metres").count().collect()] == [(9, 100, 100, 0, MANY)]


def test_nearest_in_time_of_a_crowd(spark):
    a = spark.range(MANY).select(F.lit(1).alias("k"), F.lit(5).alias("at"))
    b = spark.range(MANY).select(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, 86_400 - 95).otherwise(106).alias("dep"), F.col("id").alias("trip"))
    out = live.nearest_in_time(a, b, "k", "at", "dep", 700)
    assert [tuple(r) for r in out.groupBy("gap", "dep", "trip").count().collect()] == [(100, 86_305, 0, MANY)]


def test_nearest_in_time_against_all_pairs(spark):
    for most in (7, 600, 50_000, 86_400):
        a = [(i % 3, i * 7919 % 90_000) for i in range(60)]
        b = [(i % 3, i * 104_729 % 87_000, i) for i in range(80)]
        out = live.nearest_in_time(spark.createDataFrame(a, "k long, at long"), spark.createDataFrame(b, "k long, dep long, trip long"), "k", "at", "dep", most)
        gap = lambda t, d: abs((t - d + 43_200) % 86_400 - 43_200)
        want = [(k, t, *min((gap(t, d), d, n) for m, d, n in b if m == k)) for k, t in a]
        assert sorted(map(tuple, out.collect())) == sorted(w for w in want if w[2] <= most)


def test_better_walks_of_crowded_places(spark, monkeypatch):
    """Walks are made by sets of stops, however many a place has; better ones stand instead of them, both ways, and where there was none."""
    from wayline.operators import tables

    monkeypatch.setattr(tables, "SET", 3)
    stops = [(i, 51.0 + i % 3 * 0.003, 17.0) for i in range(30)] + [(90, 52.0, 17.0), (91, None, None)]
    s = spark.createDataFrame(stops, "stop long, lat double, lon double")
    near = {(a, b): abs(a % 3 - b % 3) for a in range(30) for b in range(30) if a != b and abs(a % 3 - b % 3) < 3}
    better = [(0, 3, 7), (0, 6, 7), (0, 1, 7), (4, 0, 8), (5, 90, 9), (77, 1, 9)]
    both = {(a, b): x for a, b, x in better} | {(b, a): x for a, b, x in better}
    walks = spatial.footpaths(s, 700.0)
    got = {(r["a"], r["b"]): r["seconds"] for r in walks.collect()}
    assert walks.count() == len(got) and set(got) == {k for k, d in near.items()}
    frame = spark.createDataFrame(better, "a long, b long, seconds long")
    out = spatial.replaced(s, frame, 700.0)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and {(a, b): x for a, b, x in rows} == {k: x for k, x in got.items() if k not in both} | both
    monkeypatch.setattr(spatial, "PAIRS_TOLD", 9)
    assert spatial.footpaths(s, 700.0).rdd.getNumPartitions() >= len(near) // 9, "as many tasks as the walks ask for"

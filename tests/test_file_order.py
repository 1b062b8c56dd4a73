"""Rows of files in parts stand in the order of the files, however Spark packs them."""

from __future__ import annotations

from pathlib import Path

import pytest

from wayline.operators import tables
from wayline.sources import timetable_files as tf


@pytest.fixture
def small_blocks(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "2000b"), ("spark.sql.files.openCostInBytes", "1b")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def write(folder, *parts):
    folder.mkdir()
    for i, rows in enumerate(parts):
        (folder / f"part-{i:05d}.csv").write_text("\n".join(rows) + "\n")
    return str(folder)


def test_last_and_first_rows_of_parts(spark, tmp_path, small_blocks):
    """Part files of unlike sizes: large ones are packed first, but the last file's row of an id stays, and the first one's of a call."""
    head = "stop_id,stop_name,stop_lat,stop_lon"
    parts = [[head] + [f"s{i},first {k},51,17" for i in range(n)] for k, n in enumerate((20, 400, 3, 200))] + [[head, "s0,last,51,17", "s0,very last,51,17"]]
    got = {r["stop_id"]: r["stop_name"] for r in tf.stops(tf.read_file(spark, write(tmp_path / "stops", *parts), "stops")).collect()}
    assert got["s0"] == "very last" and got["s1"] == "first 3" and got["s250"] == "first 1" and len(got) == 400
    head = "trip_id,stop_id,stop_sequence,arrival_time,departure_time"
    parts = [[head] + [f"t{i},k{k},1,08:00:00,08:00:00" for i in range(n)] for k, n in enumerate((5, 300, 40))]
    got = {r["trip_id"]: r["stop_id"] for r in tf.stop_times(tf.read_file(spark, write(tmp_path / "times", *parts), "stop_times")).collect()}
    assert got["t4"] == "k0" and got["t5"] == "k1" and got["t39"] == "k1" and len(got) == 300


def test_blocks_of_one_file(spark, tmp_path, small_blocks):
    rows = [f"r{i % 7},name {i},,3" for i in range(900)]
    path = write(tmp_path / "routes", ["﻿route_id,route_short_name,route_long_name,route_type", *rows])
    df = tf.read_file(spark, path, "routes")
    assert df.rdd.getNumPartitions() > 3
    assert {r["route_id"]: r["route_short_name"] for r in tf.routes(df).collect()} == {f"r{i % 7}": f"name {i}" for i in range(893, 900)}


def test_tasks_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Calls and trips are ordered in as many tasks as the files' bytes ask for; a trip that is asked for twice has its calls once, and of a call that repeats the first row stays."""
    monkeypatch.setattr(tables, "BYTES_A_TASK", 500)
    share = lambda path: sum(x.stat().st_size for x in Path(path).iterdir()) // 500
    head = "trip_id,stop_id,stop_sequence,arrival_time,departure_time"
    path = write(tmp_path / "times of day", *[[head] + [f"t{i},k{k},{i % 4},,08:00:{k:02d}" for i in range(400)] for k in range(3)])
    ids = spark.createDataFrame([(f"t{i}",) for i in [*range(0, 400, 2), 0, 2]], "trip_id string")
    for asked, n in ((None, 400), (ids, 200)):
        out = tf.stop_times(tf.read_file(spark, path, "stop_times"), asked)
        assert sorted(out.collect()) == sorted((f"t{i}", i % 4, "k0", 0, 28_800) for i in range(0, 400, 400 // n))
    assert tf.stop_times(tf.read_file(spark, path, "stop_times")).rdd.getNumPartitions() >= share(path) > tables.tasks(spark)
    path = write(tmp_path / "trips", *[["trip_id,route_id,service_id"] + [f"t{i},r{k},s" for i in range(400)] for k in range(3)])
    out = tf.trips(tf.read_file(spark, path, "trips"))
    assert out.rdd.getNumPartitions() >= share(path) > tables.tasks(spark) and {r["route_id"] for r in out.collect()} == {"r2"} and out.count() == 400

from __future__ import annotations

import datetime as dt
import math

import pytest

from wayline.streaming import positions as st

T = dt.datetime(2024, 1, 1, 8, 0, 0)


@pytest.fixture
def stream(spark, tmp_path):
    """A function that writes rows as files, one batch each, and reads them as a stream."""

    def make(schema, *batches):
        path = tmp_path / "in"
        path.mkdir(exist_ok=True)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))

    return make


def drain(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def at(s):
    return T + dt.timedelta(seconds=s)


def test_smoothed(spark, stream, tmp_path):
    df = stream("vehicle string, ts timestamp, delay int", [("a", at(0), 10), ("a", at(15), 20), ("b", at(1), None)], [("a", at(400), 5)])
    rows = {(r["vehicle"], r["ts"]): r["smooth"] for r in drain(spark, st.smoothed(df), "smoothed", tmp_path)}
    assert rows["a", at(0)] == 10 and abs(rows["a", at(15)] - (10 + (1 - math.exp(-1)) * 10)) < 1e-9
    assert rows["b", at(1)] is None and rows["a", at(400)] == 5


def test_stops_passed(spark, stream, tmp_path):
    df = stream("vehicle string, ts timestamp, leg string, stop int", [("a", at(0), "x", 1), ("a", at(5), "x", 1), ("a", at(9), "x", 2), ("a", at(20), "y", 1)])
    assert sorted((r["leg"], r["stop"], r["ts"]) for r in drain(spark, st.stops_passed(df), "passed", tmp_path)) == [("x", 1, at(0)), ("x", 2, at(9)), ("y", 1, at(20))]


def test_transfer_risk(spark, stream, tmp_path):
    df = stream("transfer string, ts timestamp, margin int", [("t", at(0), 300), ("t", at(10), 60), ("t", at(20), 60), ("t", at(31), 50), ("t", at(100), -5)])
    assert [(r["ts"], r["state"]) for r in drain(spark, st.transfer_risk(df), "risk", tmp_path)] == [(at(0), "safe"), (at(31), "risk"), (at(100), "missed")]


def test_windows_drop_late_rows(spark, stream, tmp_path):
    df = stream("vehicle string, ts timestamp, delay int", [("a", at(0), None), ("a", at(10), 60)], [("a", at(4000), 0)], [("a", at(5), 10)], [("a", at(9000), 0)])
    rows = {r["start"]: (r["n"], r["known"], r["mean_delay"]) for r in drain(spark, st.windowed(df), "windows", tmp_path)}
    assert rows[at(0)][1:] in ((1, 60.0), (2, 35.0)) and rows[at(0)][0] in (2, 3)


def test_latest_table(spark, stream, tmp_path):
    df = stream("vehicle string, ts timestamp, delay int", [("a", at(0), 1), ("b", at(0), 2)], [("a", at(9), 3)])
    q = st.latest_into(df, str(tmp_path / "latest"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted((r["vehicle"], r["delay"]) for r in spark.read.parquet(str(tmp_path / "latest")).collect()) == [("a", 3), ("b", 2)]

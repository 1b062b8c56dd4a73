"""Streams of positions: the latest state, late data, smoothing, stops passed, transfers at risk.

Input rows: vehicle string, ts timestamp and what the operator names. State is held per vehicle by Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(positions: DataFrame, width: str = "5 minutes", step: str | None = None, late: str = "120 seconds") -> DataFrame:
    """Counts and mean delay by window; rows later than ``late`` are dropped by the watermark. Null delays are unknown and don't count as 0."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return positions.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.count("delay").alias("known"), F.avg("delay").alias("mean_delay")).select(F.col("window.start").alias("start"), "n", "known", "mean_delay")


def sessions(positions: DataFrame, gap: str = "5 minutes", late: str = "120 seconds") -> DataFrame:
    return positions.withWatermark("ts", late).groupBy("vehicle", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("vehicle", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def smoothed(positions: DataFrame, span: float = 15.0, gap: float = 150.0, late: str = "120 seconds") -> DataFrame:
    """(vehicle, ts, delay, smooth): exponential smoothing in time; a vehicle not seen for ``gap`` seconds begins anew, and unknown delays leave the state as it is."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, s = state.get if state.exists else (-1.0, 0.0)
        rows = pd.concat(list(parts)).sort_values("ts")
        out = []
        for ts, delay in zip(rows["ts"], rows["delay"], strict=True):
            t = ts.timestamp()
            if pd.isna(delay) or t < last:
                out.append(None if last < 0 else s)
                continue
            s = float(delay) if last < 0 or t - last > gap else s + (1 - np.exp(-(t - last) / span)) * (float(delay) - s)
            last = t
            out.append(s)
        state.update((last, s))
        state.setTimeoutDuration(int(gap * 1000))
        yield pd.DataFrame({"vehicle": key[0], "ts": rows["ts"].to_numpy(), "delay": rows["delay"].to_numpy(), "smooth": pd.array(out, "Float64")})

    return positions.select("vehicle", "ts", F.col("delay").cast("double").alias("delay")).groupBy("vehicle").applyInPandasWithState(step, "vehicle string, ts timestamp, delay double, smooth double", "last double, s double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stops_passed(progress: DataFrame) -> DataFrame:
    """(vehicle, leg, stop, ts): the first time that a vehicle is at each stop of its leg; a new leg begins anew. Rows: vehicle, ts, leg, stop (int)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        leg, seen = state.get if state.exists else ("", [])
        seen, out = set(seen), []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples(index=False):
            if r.leg != leg:
                leg, seen = r.leg, set()
            if r.stop not in seen:
                seen.add(int(r.stop))
                out.append((key[0], leg, int(r.stop), r.ts))
        state.update((leg, sorted(seen)))
        yield pd.DataFrame(out, columns=["vehicle", "leg", "stop", "ts"])

    return progress.select("vehicle", "ts", "leg", "stop").groupBy("vehicle").applyInPandasWithState(step, "vehicle string, leg string, stop int, ts timestamp", "leg string, seen array<int>", "append", GroupStateTimeout.NoTimeout)


def transfer_risk(margins: DataFrame, dwell: float = 20.0, gap: float = 30.0) -> DataFrame:
    """(transfer, ts, state): safe, risk or missed by the seconds left; a worse or better state counts once it has lasted ``dwell`` seconds, and a pause of ``gap`` seconds begins anew. Rows: transfer, ts, margin."""

    def name(margin: float) -> str:
        return "missed" if margin < 0 else "risk" if margin < 120 else "safe"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, coming, since, last = state.get if state.exists else ("", "", 0.0, -1.0)
        out = []
        for r in pd.concat(list(parts)).sort_values("ts").itertuples(index=False):
            t, new = r.ts.timestamp(), name(r.margin)
            if last < 0 or t - last > gap:
                now, coming, since = new, new, t
                out.append((key[0], r.ts, now))
            elif new != coming:
                coming, since = new, t
            if coming != now and t - since >= dwell:
                now = coming
                out.append((key[0], r.ts, now))
            last = t
        state.update((now, coming, since, last))
        yield pd.DataFrame(out, columns=["transfer", "ts", "state"])

    return margins.select("transfer", "ts", F.col("margin").cast("double").alias("margin")).groupBy("transfer").applyInPandasWithState(step, "transfer string, ts timestamp, state string", "now string, coming string, since double, last double", "append", GroupStateTimeout.NoTimeout)


def latest_into(positions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Keeps a table of each vehicle's newest row: every batch merges what came into the table and swaps it in whole."""
    from wayline.operators.records import one_of_each
    from wayline.sinks.tables import replace

    def merge(batch: DataFrame, _: int) -> None:
        try:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(path).unionByName(batch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch
        replace(one_of_each(rows, ["vehicle"], [F.col("ts")], first=False), path)

    return positions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

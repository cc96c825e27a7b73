"""Operators that go on with a stream: daily windows, drying cycles, running sums.

Readings are (entity_id, ts, value). State is a few numbers for each entity; watermarks bound what is held for windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_windows(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """(entity_id, day, v_min, v_max, v_mean, n): tumbling days; a day ends when the watermark passes it."""
    w = readings.withWatermark("ts", late).groupBy("entity_id", F.window("ts", "1 day").alias("w"))
    return w.agg(F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.count(F.lit(1)).alias("n")).select("entity_id", F.to_date("w.start").alias("day"), "v_min", "v_max", "v_mean", "n")


def sessions(readings: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(entity_id, started, ended, n): runs of readings without a longer gap."""
    w = readings.withWatermark("ts", late).groupBy("entity_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("entity_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def drying_cycles(readings: DataFrame, wet: float = 0.3, dry: float = -0.1) -> DataFrame:
    """(entity_id, n_cycles, state, last_ts) after each batch that brings an entity rows: wet, dry, wet again.

    Rows of a batch are taken in time order; a row older than the last one seen is left out. ``value`` is the wetness index.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mode, cycles, seen = state.get if state.exists else ("start", 0, float("-inf"))
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, v in zip(rows["ts"], rows["value"]):
            at = ts.timestamp()
            if at <= seen or pd.isna(v):
                continue
            seen = at
            if v >= wet:
                cycles += mode == "dry"
                mode = "wet"
            elif v <= dry and mode == "wet":
                mode = "dry"
        state.update((mode, int(cycles), seen))
        yield pd.DataFrame({"entity_id": [key[0]], "n_cycles": [int(cycles)], "state": [mode], "last_ts": [None if seen == float("-inf") else seen]})

    kind = dict(readings.dtypes)["entity_id"]
    return readings.groupBy("entity_id").applyInPandasWithState(step, f"entity_id {kind}, n_cycles long, state string, last_ts double", "state string, n long, seen double", "update", "NoTimeout")


def running_total(readings: DataFrame, base: float = 10.0) -> DataFrame:
    """(entity_id, total, n) of max(0, value - base) after each batch: a running aggregate in update mode."""
    return readings.groupBy("entity_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("value") - base)).alias("total"), F.count(F.lit(1)).alias("n"))

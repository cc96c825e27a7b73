"""Streams in small batches give what one batch gives."""

import datetime as dt

from pyspark.sql import functions as F

from loamwork.operators import runs
from loamwork.streaming import incremental


def readings(days=30):
    start = dt.datetime(2025, 1, 1)
    return [(e, start + dt.timedelta(days=k, hours=e), float([0.9, -0.5, 0.1, 0.8, -0.9][(k * (e + 1)) % 5])) for e in range(3) for k in range(days)]


def stream(spark, folder, rows, per_file=20):
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], "entity_id int, ts timestamp, value double").coalesce(1).write.mode("append").json(f"{folder}/in")
    return spark.readStream.schema("entity_id int, ts timestamp, value double").option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def run(df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_drying_cycles(spark, tmp_path):
    rows = readings()
    out = run(incremental.drying_cycles(stream(spark, str(tmp_path), rows)), "cycles", "update", str(tmp_path))
    last = {r.entity_id: r.n for r in out.groupBy("entity_id").agg(F.max("n_cycles").alias("n")).collect()}
    batch = spark.createDataFrame([(e, t.date(), v) for e, t, v in rows], "entity_id int, obs_date date, wi double")
    assert last == {r.entity_id: r.n_cycles for r in runs.drying_cycles(batch).collect()} and max(last.values()) > 2


def test_daily_windows_and_late_rows(spark, tmp_path):
    rows = readings()
    out = run(incremental.daily_windows(stream(spark, str(tmp_path), rows)), "days", "append", str(tmp_path))
    got = {(r.entity_id, r.day): (r.v_min, r.n) for r in out.collect()}
    want = {(e, t.date()): (v, 1) for e, t, v in rows}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 3 * 6


def test_running_total(spark, tmp_path):
    rows = [(e, t, v * 40) for e, t, v in readings()]
    out = run(incremental.running_total(stream(spark, str(tmp_path), rows)), "totals", "update", str(tmp_path))
    got = {r.entity_id: r.t for r in out.groupBy("entity_id").agg(F.max("total").alias("t")).collect()}
    for e in range(3):
        assert abs(got[e] - sum(max(0.0, v - 10) for x, _, v in rows if x == e)) < 1e-6


def test_sessions_in_batch(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 0, m), 1.0) for m in (0, 10, 20)] + [(1, dt.datetime(2025, 1, 1, 5), 1.0)], "entity_id int, ts timestamp, value double")
    assert sorted(r.n for r in incremental.sessions(df, "30 minutes").collect()) == [1, 3]

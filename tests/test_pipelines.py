"""The composed pipelines on small synthetic inputs."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from loamwork.plans import pipelines as p
from loamwork.sources import readers

DAY = dt.date(2025, 5, 1)
OBS = "entity_id string, obs_date date, value double"


def curves():
    ndvi, vh, weather = [], [], []
    for farm, start in (("early", 40), ("late", 60)):
        for k in range(0, 210, 12):
            d = DAY + dt.timedelta(k)
            ndvi.append((farm, d, 0.12 + 0.7 * math.exp(-(((k - start - 45) / 30) ** 2))))
            vh.append((farm, d, -15.0 - (5.0 if abs(k - start) < 7 else 0.0)))
        for k in range(210):
            weather.append((farm, DAY + dt.timedelta(k), 22.0, 32.0))
    return ndvi, vh, weather


def frames(spark):
    ndvi, vh, weather = curves()
    return spark.createDataFrame(ndvi, OBS), spark.createDataFrame(vh, OBS), spark.createDataFrame(weather, "entity_id string, obs_date date, tmin double, tmax double")


def test_phenology(spark):
    farms = spark.createDataFrame([("early", None), ("late", DAY + dt.timedelta(100)), ("empty", None)], "entity_id string, given_date date")
    got = {r.entity_id: r for r in p.phenology_batch(*frames(spark), farms, dt.date(2025, 9, 1)).collect()}
    e, l, none = got["early"], got["late"], got["empty"]
    assert not e.provided and abs((e.event_date - (DAY + dt.timedelta(40))).days) <= 24 and e.sowing_date == e.event_date - dt.timedelta(28)
    assert e.gdd == 17.0 * ((dt.date(2025, 9, 1) - e.event_date).days + 1) and e.stage in ("reproductive", "ripening", "maturity") and 0.2 <= e.confidence <= 0.98
    assert e.harvest_date is not None and e.flags == ""
    assert l.provided and "date_mismatch" in l.flags and l.gdd == 17.0 * ((dt.date(2025, 9, 1) - l.event_date).days + 1)
    assert none.stage is None and none.flags == "no_date"
    before = {r.entity_id: r for r in p.phenology_batch(*frames(spark), farms, dt.date(2025, 5, 1)).collect()}
    assert before["late"].stage == "pre_transplant" and before["late"].gdd == 0.0 and before["late"].days < 0
    with pytest.raises(ValueError, match="target_gdd"):
        p.PhenologyConfig(target_gdd=-1).validate()


def test_heterogeneity(spark):
    df = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(25)), ("b", DAY), ("b", DAY), ("c", None)], "farm_id string, event_date date")
    assert {r.farm_id: r.status for r in p.heterogeneity(df).collect()} == {"a": "heterogeneous", "b": "uniform", "c": "insufficient"}


def test_wetness(spark, tmp_path):
    rows = [("awd", DAY + dt.timedelta(6 * k), -8.0 if k % 4 == 2 else -18.0) for k in range(20)] + [("flat", DAY + dt.timedelta(6 * k), -18.0 + (k == 3)) for k in range(20)] + [("few", DAY, 1.0)]
    areas = spark.createDataFrame([("awd", 5000.0), ("flat", 15000.0), ("few", 1.0)], "entity_id string, area double")
    fields, summary = p.wetness_run(spark.createDataFrame(rows, OBS), areas, str(tmp_path))
    assert {r.entity_id for r in fields.collect()} == {"awd", "flat"}
    s = summary.first()
    assert s.paddy_area_ha >= s.awd_area_ha >= 0 and spark.read.json(f"{tmp_path}/json").first().paddy_area_ha == s.paddy_area_ha


def test_soil(spark, tmp_path):
    @readers.register("percent", soc_unit="pct", ph_unit="cacl2")
    def percent(spark):
        return spark.createDataFrame([("a", 0.0, 10.0, 2.0, 6.0, 77.0, 12.0), ("a", 10.0, 30.0, 1.0, 20.0, 77.0, 12.0), ("b", 5.0, 5.0, 1.0, 6.0, 78.0, 13.0)], "profile_id string, upper double, lower double, soc double, ph double, lon double, lat double")

    @readers.register("grams")
    def grams(spark):
        return spark.createDataFrame([("c", 0.0, 20.0, 12.0, 79.0, 14.0)], "profile_id string, upper double, lower double, soc double, lon double, lat double")

    cov = spark.createDataFrame([(77.0, 12.0, 900.0)], "lon double, lat double, elevation double")
    out = p.soil_run(spark, ["percent", "grams"], str(tmp_path), cov).collect()
    by = {(r.profile_id, r.upper): r for r in out}
    assert by["a", 0.0].soc > by["a", 15.0].soc > 9 and by["c", 0.0].soc == 12.0 and by["a", 0.0].elevation == 900.0 and by["c", 5.0].elevation is None
    assert by["a", 0.0].qc_flags == ["range:ph"] and not any(k[0] == "b" for k in by)
    assert spark.read.parquet(f"{tmp_path}/final/parquet").count() == len(out)


def test_documents(spark):
    class Short:
        def detect(self, page):
            return {"label": "cut", "issues": ["cut_off"], "confidence": 0.9} if len(page["text"]) < 3 else {"label": "accepted"}

    pages = spark.createDataFrame([("f", 1, "long text"), ("f", 2, "x"), ("g", 1, "fine")], "file string, page int, text string")
    decided, files = p.document_run(pages, {"short": Short})
    assert {(r.file, r.accepted, tuple(r.issues)) for r in files.collect()} == {("f", False, ("cut_off",)), ("g", True, ())} and decided.count() == 3


def test_identity(spark):
    w = [("p", k, t, x, y, 60, 10, 0.9) for k, (t, x, y) in enumerate([("Name:", 0, 0), ("Anna", 70, 1), ("Rao", 140, 0), ("PAN", 0, 20), ("ABCDE1234F", 70, 20), ("DOB", 0, 40), ("01/02/1990", 70, 40)])]
    words, audit = p.identity_run(spark.createDataFrame(w, "page string, idx int, text string, x int, y int, w int, h int, conf double"), ["page"])
    assert {r.text for r in words.collect() if not r.redact} == {"Anna", "Rao"}
    found = json.loads(audit.first().audit)
    assert {i["label"] for i in found["items"]} == {"PAN", "DOB"} and found["items"][0]["box"]["x"] == 70


def test_small_sources(spark):
    df = spark.createDataFrame([("NDVI_mean", None), ("x", "Sentinel VH dB"), ("q", None)], "v string, a string")
    assert [r[0] for r in df.select(readers.signal_of(F.col("v"), F.col("a"))).collect()] == ["NDVI", "VH", "VALUE"]
    d = spark.createDataFrame([(DAY, DAY + dt.timedelta(365))], "a date, b date").select(readers.periods(F.col("a"), F.col("b")).alias("p")).first().p
    assert len(d) == 12 and (d[0].last - d[0].first).days == 29 and d[1].first == d[0].last + dt.timedelta(1)
    o = spark.createDataFrame([("e", DAY, "NDVI", 0.5)], "entity_id string, obs_date date, signal string, value double")
    assert readers.wide(o, ["NDVI"], ["20250501", "20250513"]).columns == ["entity_id", "NDVI_20250501", "NDVI_20250513"]
    assert readers.stack({"a": o.drop("entity_id"), "b": o.drop("entity_id")}).count() == 2

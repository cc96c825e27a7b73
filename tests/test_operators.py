"""Operators that SQL cannot express, against plain Python; golden values; edge cases."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.functions import geometry, numeric, text
from loamwork.operators import detectors, documents, joins, landcover, models, phenology, raster, runs, sampling, series, soil, stats, votes
from loamwork.sources import readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


# golden values --------------------------------------------------------------------------------------------------------


def test_growing_degrees_and_stage(spark):
    df = spark.createDataFrame([(22.0, 32.0, 900.0), (18.0, 28.0, 5000.0), (5.0, 8.0, -1.0)], "a double, b double, g double")
    got = phenology.classify_stage(df.withColumn("gdd", phenology.growing_degrees(F.col("a"), F.col("b"), 10.0)), F.col("g")).select("gdd", "stage").collect()
    assert [tuple(r) for r in got] == [(17.0, "reproductive"), (13.0, "maturity"), (0.0, "establishment")]


def test_sampling_plan_of_seven_strata(spark):
    # stratum sizes whose published totals are 128 cores: blocks give floors 2n and ceilings 3n
    n, blocks = [32, 60, 35, 5, 11, 31, 11], [22, 8, 6, 6, 6, 4, 2]
    df = spark.createDataFrame([(str(k), 50, b, 10.0, 1.0, 1000.0) for k, b in enumerate(blocks)], "stratum string, n_points long, n_blocks long, mean double, sd double, area double")
    got = {r.stratum: r for r in sampling.plan(df).collect()}
    for k, (want, b) in enumerate(zip(n, blocks)):
        r = got[str(k)]
        assert r.block_floor == 2 * b and r.block_ceiling == 3 * b and r.block_floor <= r.planned_cores <= r.block_ceiling
    assert sum(min(max(a, 2 * b), 3 * b) for a, b in zip(n, blocks)) == 128


def test_cochran_edges(spark):
    df = spark.createDataFrame([(10.0, 5.0, 1000.0), (0.0, 5.0, 10.0), (-1.0, 5.0, 10.0), (10.0, 0.0, 1.0), (None, 1.0, 1.0)], "m double, s double, n double")
    got = [r[0] for r in df.select(sampling.cochran(F.col("m"), F.col("s"), F.col("n"))).collect()]
    n0 = (1.96 * 5 / 1.5) ** 2
    assert got[0] == np.ceil(n0 / (1 + (n0 - 1) / 1000)) and got[1] is None and got[2] is None and got[4] is None


def test_sensor_counts(spark):
    d = [dt.date(2025, 6, 1) + dt.timedelta(12 * k) for k in range(4)]
    a = spark.createDataFrame([("f", d[0], 0.2), ("f", d[1], None), ("f", d[2], 0.4), ("f", d[3], 0.5)], "entity_id string, obs_date date, value double")
    b = spark.createDataFrame([("f", x, -15.0) for x in d], "entity_id string, obs_date date, value double")
    got = series.merge_sensors(a, b).groupBy("tag").count().collect()
    assert {r.tag: r["count"] for r in got} == {"first": 3, "second": 1}


def test_drying_beats_flooding(spark):
    day = dt.date(2025, 6, 1)
    flood = [("flood", day + dt.timedelta(6 * k), -18.0 + 0.05 * (k % 3)) for k in range(20)]
    awd = [("awd", day + dt.timedelta(6 * k), -8.0 if k % 4 == 2 else -18.0) for k in range(20)]
    wi = runs.wetness(spark.createDataFrame(flood[:1] + [("flat", day, 1.0), ("flat", day + dt.timedelta(1), 1.0)] + awd, "entity_id string, obs_date date, value double"))
    got = {r.entity_id: r for r in runs.drying_cycles(wi).collect()}
    assert got["awd"].n_cycles == 5 and got["awd"].likelihood == 1.0 and got["flat"].n_cycles == 0
    assert runs.wetness(wi.drop("wi"), flat=None).where("entity_id = 'flat' and wi is null").count() == 2


def test_land_cover_labels(spark):
    m = spark.createDataFrame([("dynamic_world", "crops", 3), ("esa", "10", 1)], "source string, native string, class_id int")
    df = spark.createDataFrame([("dynamic_world", "crops"), ("esa", "77")], "source string, native string")
    assert sorted(rows(landcover.map_labels(df, m).select("native", "class_id")), key=str) == [("77", None), ("crops", 3)]
    with pytest.raises(Exception, match="unknown source"):
        landcover.map_labels(spark.createDataFrame([("x", "crops")], "source string, native string"), m).collect()


def test_dequantise(spark):
    df = spark.createDataFrame([([127, -127, 0, 64],)], "a array<int>")
    got = df.select(landcover.dequantise(F.col("a"))).first()[0]
    assert np.allclose(got, [(127 / 127.5) ** 2, -((127 / 127.5) ** 2), 0, (64 / 127.5) ** 2])


def test_plantation_runs(spark):
    series_ = {1: [0.7, 0.7, 0.1, 0.9], 2: [0.7, 0.1, 0.7, 0.1], 3: [0.1, 0.8, 0.8, 0.8]}
    df = spark.createDataFrame([(k, dt.date(2018 + y, 1, 1), p) for k, v in series_.items() for y, p in enumerate(v)], "entity_id int, obs_date date, value double")
    assert sorted(rows(runs.longest_run(df, F.col("value") > 0.6))) == [(1, 2), (2, 1), (3, 3)]
    assert sorted(rows(runs.first_run(df, F.col("value") > 0.6, 2))) == [(1, dt.date(2018, 1, 1)), (2, None), (3, dt.date(2019, 1, 1))]


# against plain Python -------------------------------------------------------------------------------------------------


def test_keep_first_is_the_greedy_loop(spark):
    r = random.Random(3)
    pts = [(k, r.uniform(0, 50), r.uniform(0, 50)) for k in range(150)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    near = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and np.hypot(a[1] - b[1], a[2] - b[2]) <= 4}
    pairs = joins.near_pairs(df, 4.0)
    assert {(a, b) for a, b, _ in rows(pairs)} == near
    dropped = set()
    for i, j in sorted(near):
        if i not in dropped:
            dropped.add(j)
    assert {k for k, d in rows(joins.keep_first(df, pairs)) if d} == dropped


def test_harmonised_profile(spark):
    h = [(0.0, 10.0, 30.0), (10.0, 25.0, 18.0), (25.0, 60.0, 6.0)]
    df = spark.createDataFrame([("a", u, l, v) for u, l, v in h] + [("one", 0.0, 20.0, 5.0), ("bad", 5.0, 5.0, 1.0), ("null", None, 2.0, 1.0)], "profile string, upper double, lower double, soc double")
    got = {(p, t): v for p, t, _, v in rows(soil.harmonise(df, "profile", "soc"))}
    knots = np.array([0, 10, 25, 60.0])
    a = np.hstack([np.eye(3), np.zeros((3, 1))])
    d = np.diff(np.eye(4), 2, axis=0)
    c = np.linalg.solve(a.T @ a + 0.1 * d.T @ d, a.T @ np.array([30, 18, 6.0]))
    assert np.isclose(got["a", 0.0], c[0]) and np.isclose(got["a", 15.0], (10 * c[1] + 5 * c[2]) / 15) and ("a", 60.0) not in got and len(knots) == 4
    assert got["one", 0.0] == 5.0 and got["one", 15.0] == 5.0 and ("one", 30.0) not in got and not any(k[0] in ("bad", "null") for k in got)


def test_mahalanobis(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 3))
    v[7] = 40
    data = [(k, v[k].tolist(), 1) for k in range(60)] + [(100 + k, [9.0 * k, 0.0, 1.0], 2) for k in range(5)]
    got = {r[0] for r in rows(landcover.mahalanobis_filter(spark.createDataFrame(data, "id int, e array<double>, label int"), "label", "e").select("id"))}
    c = v - v.mean(0)
    d = np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.pinv(np.cov(v.T, bias=True)), c))
    assert got == {k for k in range(60) if d[k] < 3 * np.median(d)} | {100 + k for k in range(5)} and 7 not in got


def test_box_dedup(spark):
    r = random.Random(1)
    boxes = [{"x": r.uniform(0, 60), "y": r.uniform(0, 60), "w": 20.0, "h": 15.0} for _ in range(40)]

    def iou(a, b):
        w, h = max(0, min(a["x"], b["x"]) + 20 - max(a["x"], b["x"])), max(0, min(a["y"], b["y"]) + 15 - max(a["y"], b["y"]))
        return w * h / (600 - w * h)

    kept = []
    for b in boxes:
        if all(iou(k, b) <= 0.3 for k in kept):
            kept.append(b)
    df = spark.createDataFrame([(boxes,)], "b array<struct<x:double,y:double,w:double,h:double>>")
    assert [x.asDict() for x in df.select(geometry.keep_separate(F.col("b"))).first()[0]] == kept
    u = df.select(geometry.padded(geometry.union_box(F.col("b")), 5, 70, 70).alias("u")).first().u
    assert u.x >= 0 and u.x + u.w <= 70


def test_check_digits(spark):
    base = "23456789012"
    good = next(base + str(d) for d in range(10) if text.verhoeff(base + str(d)))
    changed = [good[:k] + str((int(good[k]) + 1) % 10) + good[k + 1 :] for k in range(12)]
    df = spark.createDataFrame([(x,) for x in [good, *changed, "12a4", ""]], "n string")
    assert [r[0] for r in df.select(text.verhoeff_valid(F.col("n"))).collect()] == [True] + [False] * 14
    assert not any(map(text.verhoeff, changed))


def test_entities(spark):
    base = next("23456789012" + str(d) for d in range(10) if text.verhoeff("23456789012" + str(d)))
    t = f"PAN ABCDE1234F VID 1234 5678 9012 3456 Aadhaar {base[:4]} {base[4:8]} {base[8:]} call 9876543210 mail a.b@c.example.org DOB 01/02/1990 PIN 560001 EPIC ABC1234567 bad 0123 4567 8901"
    got = {(e[0], e[5]) for e in text.find_entities(t)}
    assert {("PAN", True), ("VID", True), ("AADHAAR", True), ("PHONE", True), ("EMAIL", True), ("DOB", False), ("PINCODE", False), ("VOTER_ID", True)} <= got
    assert not any(e[1].startswith("0123") for e in text.find_entities(t))
    for e in text.find_entities(t):
        assert t[e[2] : e[3]] == e[1]
    misread = base.replace("5", "S").replace("0", "O")
    assert any(e[0] == "AADHAAR" and e[1] == misread and e[4] == 0.85 for e in text.find_entities("x " + misread))
    df = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    assert [len(r[0]) for r in df.select(text.entities(F.col("t"))).collect()] == [len(text.find_entities(t)), 0, 0]
    counted = df.select(*(c.alias(n) for n, c in text.entity_counts(F.col("t")).items())).first()
    assert counted.EMAIL == 1 and counted.VID == 1 and counted.PHONE == 1


def test_document_types(spark):
    cases = [("Government Unique  Identification", [], "AADHAAR"), ("INCOME TAX dept", [], "PAN"), ("Republic of India passport", [], "PASSPORT"), ("driving license", [], "DRIVING_LICENCE"), ("nothing", ["PAN"], "PAN"), ("nothing", [], "UNKNOWN")]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, l array<string>")
    assert [r[0] for r in df.select(text.document_type(F.col("t"), F.col("l"))).collect()] == [c for *_, c in cases]


def test_model_responses(spark):
    cases = [("blur", "blur"), ("The page is CUT and blur", "cut"), ("Blurry", "blur"), ("no idea", "accepted"), ("", "accepted"), (None, "accepted")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r[0] for r in df.select(text.first_label(F.col("t"), ["blur", "cut", "document"], "accepted")).collect()] == [b for _, b in cases]


def test_headers():
    known = ["Dry Zone", "Humid Coast", "State"]
    assert text.resolve_header(" dryzone", known) == ("Dry Zone", "exact")
    assert text.resolve_header("Humid Coasst", known) == ("Humid Coast", "fuzzy")
    assert text.resolve_header("something  else", known) == ("Something Else", "fallback")
    assert text.resolve_header("DRY  ZONE", {"Dry Zone": "Dry", "Humid Coast": "Humid"}) == ("Dry", "exact") and text.resolve_header("x", []) == ("X", "fallback")


def test_header_columns(spark):
    df = spark.createDataFrame([(" dryzone",), ("Humid Coasst",), ("something  else",), (None,), ("",)], "h string")
    got = [r[0] and tuple(r[0]) for r in df.select(text.resolve_headers(F.col("h"), ["Dry Zone", "Humid Coast"])).collect()]
    assert got == [("Dry Zone", "exact"), ("Humid Coast", "fuzzy"), ("Something Else", "fallback"), None, ("", "fallback")]


def test_votes_truth_table(spark):
    vote = lambda d, ok, label, issues, sure: (d, ok, label, 1.25 if d == "b" else 1.0, issues, sure)
    cases = [
        ([vote("a", True, "accepted", [], 0.9), vote("b", True, "blur", ["blurry"], 0.9)], (False, "blur")), ([vote("a", True, "blur", ["blurry"], 0.3)], (True, "accepted")),
        ([vote("a", False, "blur", ["blurry"], 0.9), vote("b", True, "accepted", [], 1.0)], (True, "accepted")), ([vote("a", False, "x", [], 0.0)], (False, "error")),
        ([vote("a", True, "cut", ["cut_off", "not_document"], 0.8)], (False, "document")), ([], (False, "error")),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "page int, votes array<struct<detector:string,available:boolean,label:string,importance:double,issues:array<string>,confidence:double>>")
    d = votes.decision(F.col("votes"), 0.6)
    assert [tuple(r) for r in df.orderBy("page").select(d["accepted"], d["label"]).collect()] == [w for _, w in cases]
    t = {(p, l): (n, w) for p, l, n, w in rows(votes.tallies(df, ["page"]))}
    assert t[0, "accepted"] == (1, 1.0) and t[0, "blur"] == (1, 1.25)
    assert dict(rows(votes.winner(votes.tallies(df, ["page"]), ["page"])))[0] == "blur"


def test_names(spark):
    good, bad = ["HM RAHUL SHARMA", "Sanket Bagali", "A Kumar Rao", "काम Ravi Kumar", "रवि कुमार"], ["भारत सरकार", "काम Ravi", "Rahul ४ञ Kumar", "पुरुष RAVI KUMAR", "Government Of", "Rahul 12 March", "RAHUL", "TRTT PQRS", "address line one", "A B C D E F G H I J"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    assert [r[0] for r in df.select(documents.is_name(F.col("t"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_names_shown(spark):
    df = spark.createDataFrame([("HM RAHUL SHARMA,",), ("काम Ravi Kumar",), ("रवि कुमार",), ("Ravi",)], "t string")
    assert [r[0] for r in df.select(documents.name_shown(F.col("t"))).collect()] == ["RAHUL SHARMA", "Ravi Kumar", "रवि कुमार", None]


def test_labels(spark):
    cases = {
        "Name:": ("NAME", None), "5/O:": ("PARENT", None), "5o: Sidramappa Tadalaai": ("PARENT", "Sidramappa Tadalaai"), "S/O Ramappa": (None, None), "D/0: Ramappa, x1": ("PARENT", "Ramappa"), "नाम:": ("NAME", None),
        "नाम: रवि": (None, None), "Name: 12 34": ("NAME", None), "To": (None, None), "so": (None, None), "Surname": ("NAME", None), "": (None, None), "care of": (None, None), "C/o: ": ("PARENT", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    assert {r[0]: tuple(r[1]) for r in df.select("w", documents.resolve_label(F.col("w"))).collect()} == cases


def test_field_values(spark):
    pages = {
        "inline": (["Name: Ravi KUMAR,", "S/O Ramappa x1 Rao"], {"NAME": "Ravi KUMAR", "PARENT": "Ramappa Rao"}),
        "next line": (["Surname", "SPECIMEN", "Given name", "ANNA MARIA"], {"NAME": "SPECIMEN ANNA MARIA"}),
        "label in a value": (["Name", "APPLICANT NAME", "Father", "SOME MAN"], {"NAME": "APPLICANT NAME", "PARENT": "SOME MAN"}),
        "in a row": (["Name", "Surname x", "Name", "Ravi"], {"NAME": "Ravi"}),
        "to alone": (["To", "Lingaraj Neshvi", "To whom"], {"NAME": "Lingaraj Neshvi"}),
        "nothing": (["GOVERNMENT OF INDIA", "12 34", "name"], {}),
        "two scripts": (["नाम", "रवि कुमार"], {"NAME": "रवि कुमार"}),
    }
    words = [(p, k, j, w) for p, (lines, _) in pages.items() for k, line in enumerate(lines) for j, w in enumerate(line.split(" "))]
    words += [("segments", 0, 0, "5o: Sidramappa Tadalaai"), ("segments", 0, 1, "Name"), ("gap", 0, 0, "Name"), ("gap", 2, 0, "Ravi")]
    got = {}
    for p, label, value in rows(documents.field_values(spark.createDataFrame(words, "page string, line int, pos int, text string"), ["page"])):
        got.setdefault(p, {})[label] = value
    assert got == {p: want for p, (_, want) in pages.items() if want} | {"segments": {"PARENT": "Sidramappa Tadalaai"}}


def test_lines_labels_and_audit(spark):
    w = [("p", k, t, x, y, 30, 10, 0.9) for k, (t, x, y) in enumerate([("Name:", 0, 0), ("Anna", 40, 1), ("Rao", 80, 2), ("Address", 0, 20), ("Main", 0, 40), ("Road", 40, 41), ("DOB", 0, 60), ("01/02/1990", 50, 60)])]
    words = spark.createDataFrame(w, "page string, idx int, text string, x int, y int, w int, h int, conf double")
    lined = documents.lines_of(words, ["page"])
    assert [r.line for r in lined.orderBy("idx").collect()] == [0, 0, 0, 1, 2, 2, 3, 3]
    got = {(l, v) for _, l, v in rows(documents.label_values(lined, ["page"], {"name": "name", "address": "address", "dob": "dob"}, "^(name|dob)"))}
    assert got == {("name", "Anna Rao"), ("address", "Main Road"), ("dob", "01/02/1990")}
    kept = words.where("text in ('Anna', 'Rao')")
    red = {r.text: r.redact for r in documents.redaction(words, kept, ["page"]).collect()}
    assert red["Anna"] is False and red["Main"] is True
    assert all(r.redact for r in documents.redaction(words.withColumn("conf", F.lit(0.1)), kept, ["page"]).collect())
    spans = words.withColumns({"w_start": F.col("idx") * 10, "w_stop": F.col("idx") * 10 + 4})
    e = spark.createDataFrame([("p", "DOB", 62, 75, 0.7), ("p", "PIN", 0, 5, 0.4)], "page string, label string, start int, stop int, score double")
    items = documents.audit(spans, e, ["page"])
    assert rows(items.select("label", "box.x", "box.w")) == [("DOB", 0, 80)]
    audit = json.loads(sinks.audit_document(items, ["page"]).first().audit)
    assert audit["n_items"] == 1 and audit["reliable"] is True


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (3, 4, "d")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 20.0, 1), (1, 5, 50.0, 2), (1, 5, 51.0, 1), (2, 10, 1.0, 1)], "k int, t int, v double, no int")
    assert sorted(rows(joins.as_of(left, right, ["k"], "t", ["v"], tie=["no"]).select("name", "v"))) == [("a", 50.0), ("b", None), ("c", None), ("d", None)]


def test_stratified_and_splits(spark):
    df = spark.createDataFrame([(k, "hot" if k % 10 else "rare") for k in range(300)], "id long, label string")
    a, b = (sorted(rows(sampling.stratified(x, "label", "id", 18, 42).select("id", "label"))) for x in (df, df.repartition(7)))
    assert a == b and sum(l == "hot" for _, l in a) == 18 and sum(l == "rare" for _, l in a) == 18
    parts = df.select((F.col("id") % 20).alias("g"), sampling.split(F.col("id") % 20, [0.7, 0.3], 1).alias("p")).distinct()
    assert parts.count() == 20 and {r.p for r in parts.collect()} == {0, 1}


# numbers and rasters --------------------------------------------------------------------------------------------------


def test_speckle_filter(spark):
    rng = np.random.default_rng(42)
    image = rng.normal(1.0, 0.2, (40, 50))
    out = raster.lee(image, 7, 25.0)
    assert out.std() < 0.4 * image.std() and abs(out.mean() - 1) < 0.02 and out.shape == image.shape
    pixels = spark.createDataFrame([("s", r, c, float(image[r, c])) for r in range(40) for c in range(50)], "scene string, row int, col int, value double")
    got = {(r.row, r.col): r.filtered for r in raster.speckle_filter(pixels, 7, 25.0, tile=20).collect()}
    assert len(got) == 2000 and all(np.isclose(got[r, c], out[r, c]) for r in range(40) for c in range(50))


def test_simplify():
    line = [(x / 10, float(np.sin(x / 10))) for x in range(100)]
    assert raster.simplify(line, 10) == [line[0], line[-1]] and raster.simplify(line, 0) == line
    assert len(raster.simplify_to(line, 0.01, 12)) <= 12


def test_collinearity(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(y), float(2 * x + 1), float(x + y + 0.05 * z)) for x, y, z in zip(a, b, rng.normal(size=200))], "a double, b double, twice double, both double")
    assert models.drop_collinear(df, ["a", "b", "twice"]) == ["a", "b"]
    v = models.vif(df, ["a", "b", "both"])
    x = np.stack([a, b, np.array([r.both for r in df.collect()])], 1)
    assert np.allclose(list(v.values()), np.diag(np.linalg.inv(np.corrcoef(x.T))), rtol=1e-6)
    left = models.drop_by_vif(df, ["a", "b", "twice", "both"])
    assert len(left) == 2 and all(x <= 5 for x in models.vif(df, left).values())


def test_models(spark):
    rng = np.random.default_rng(2)
    data = [(k, float(a), float(b), float(3 * a + 0.1 * e)) for k, (a, b, e) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(data, "id int, a double, b double, y double")
    p = models.fit_and_predict(df, ["a", "b"], "y", "ridge", F.col("id"))
    e = stats.errors(p.where("part = 1"), "y", "prediction").first()
    assert e.r2 > 0.97 and models.lasso_selection(df, ["a", "b"], "y", 0.5) == ["a"]
    assert models.cross_validated(df, ["a", "b"], "y", "linear", F.col("id"), 3).count() == 300
    assert rows(models.mutual_information(df, ["b", "a"], "y"))[0][0] == "a"
    s = models.stacked(df, ["a", "b"], "y", ["linear", "forest"], "id", 2)
    assert stats.errors(s.where("part = 1"), "y", "prediction").first().r2 > 0.9
    cover = models.classify_cover(*[df.select("id", F.array("a", "b").alias("v"), (F.col("a") > 0).cast("double").alias("label"))] * 2, "v", "label", 2)
    assert cover.where((F.col("class_id") == F.col("label")) & (F.col("confidence") >= 0.5)).count() > 285


def test_geometry(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    df = spark.createDataFrame([(square, 1.0, 1.0), (square, 5.0, 1.0), (square, 0.0, 2.0), ([{"x": 1.0, "y": 2.0}], 1.0, 2.0)], "r array<struct<x:double,y:double>>, x double, y double")
    assert [r[0] for r in df.select(geometry.contains(F.col("r"), F.col("x"), F.col("y"))).collect()] == [True, False, True, False]
    c = df.select(geometry.centroid(F.col("r")).alias("c"), geometry.signed_area(F.col("r"))).collect()
    assert tuple(c[0].c) == (2.0, 2.0) and c[0][1] == 16.0 and tuple(c[3].c) == (1.0, 2.0)
    tiles = df.select(geometry.tile_names(F.lit(76.0), F.lit(-2.0), F.lit(79.0), F.lit(1.0))).first()[0]
    assert tiles == ["S03E075", "S03E078", "N00E075", "N00E078"]


def test_numeric(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert df.select(numeric.weighted({"a": 1.0, "b": 3.0})).first()[0] == 2.5
    f = numeric.shrinkage_features(F.lit(8.0), F.lit(2.0), F.lit(2.0), F.lit(2.0))
    assert abs(df.select(f["fill"]).first()[0] - 1) < 1e-6


# sources and sinks ----------------------------------------------------------------------------------------------------


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("farm_id,2025-06-01,2025-06-13\n7,0.45,x\n8,-9999,0.5\n")
    raw = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert readers.detect_layout(readers.header(spark, str(tmp_path / "a.csv"))) == "iso"
    got = sorted(rows(readers.to_observations(raw, "farm_id")), key=str)
    assert got == sorted([("7", dt.date(2025, 6, 1), "NDVI", 0.45), ("7", dt.date(2025, 6, 13), "NDVI", None), ("8", dt.date(2025, 6, 1), "NDVI", None), ("8", dt.date(2025, 6, 13), "NDVI", 0.5)], key=str)
    (tmp_path / "l.tsv").write_text("profile\ttop\n1\t0\n1\t5\n2\t0\n")
    (tmp_path / "p.tsv").write_text("profile\tcountry\n1\tIN\n1\tXX\n")
    joined = readers.profiles_with_layers(readers.read_table(spark, str(tmp_path / "l.tsv"), sep="\t"), readers.read_table(spark, str(tmp_path / "p.tsv"), sep="\t"), "profile")
    assert joined.count() == 3 and joined.where("country is null").count() == 1
    long = spark.createDataFrame([("e", "2025-01-02", "NDVI", 0.1), ("f", "2025-01-02", "VALUE", 0.2)], "entity_id string, obs_date string, signal string, value double")
    assert sorted(r.entity_id for r in readers.curve(long, "NDVI").collect()) == ["e", "f"]


def test_structured_sources(spark):
    geo = {"type": "FeatureCollection", "features": [{"properties": {"farm_id": "7"}, "geometry": {"type": "Polygon", "coordinates": [[[77.0, 12.0], [77.5, 12.0], [77.5, 12.25], [77.0, 12.0]]]}}]}
    f = readers.geojson_features(spark.createDataFrame([(json.dumps(geo),)], "value string")).first()
    assert (f.kind, f.min_lon, f.min_lat, f.max_lon, f.max_lat, f.properties["farm_id"], len(f.points)) == ("Polygon", 77.0, 12.0, 77.5, 12.25, "7", 4)
    days = {"daily": {"time": ["2025-06-01", "2025-06-02"], "temperature_2m_min": [22.0, 21.0], "temperature_2m_max": [32.0, 31.0]}}
    w = readers.weather_days(spark.createDataFrame([(1, json.dumps(days))], "k int, value string"), ["k"])
    assert rows(w.orderBy("day").select("tmin", "tmax", "tmean")) == [(22.0, 32.0, 27.0), (21.0, 31.0, 26.0)]
    tsv = "level\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t2\t3\t4\t96.5\tHello\n5\t1\t2\t3\t4\t-1\tx\n5\t1\t2\t3\t4\t50\t \n5\t1\n"
    o = readers.ocr_words(spark.createDataFrame([("p", tsv)], "page string, value string"), ["page"])
    assert rows(o.select("text", "x", "y", "w", "h", "conf")) == [("Hello", 1, 2, 3, 4, 0.965)]
    x = spark.createDataFrame([("<a><v> 1.5 2 3e1 </v></a>",)], "x string")
    assert x.select(readers.xml_vector(F.col("x"), "v")).first()[0] == [1.5, 2.0, 30.0]
    files = spark.createDataFrame([("/d/blur/a.png", 1), ("/d/blur/a.png", 1), ("/d/other/b.png", 2), ("/d/ok/run-c.png", 9)], "path string, modificationTime long")
    assert sorted(rows(readers.labelled_files(files, {"blur": "blur", "ok": "accepted"}))) == [("/d/blur/a.png", "blur"), ("/d/ok/run-c.png", "accepted")]
    assert readers.newest(files, "run").first()[0] == "/d/ok/run-c.png"
    m = spark.createDataFrame([(dt.date(2025, 1, 30), dt.date(2025, 3, 2)), (dt.date(2025, 3, 2), dt.date(2025, 1, 1))], "a date, b date")
    parts = [r[0] for r in m.select(readers.month_parts(F.col("a"), F.col("b"))).collect()]
    assert [tuple(p) for p in parts[0]] == [(dt.date(2025, 1, 30), dt.date(2025, 1, 31)), (dt.date(2025, 2, 1), dt.date(2025, 2, 28)), (dt.date(2025, 3, 1), dt.date(2025, 3, 2))] and parts[1] == []


def test_source_registry(spark):
    @readers.register("good", soc_unit="pct")
    def good(spark):
        return spark.createDataFrame([("1", "12.5"), ("2", "bad")], "profile_id string, soc string")

    @readers.register("broken")
    def broken(spark):
        raise OSError("no file")

    df = readers.collect_sources(spark, ["good", "broken"], soil.HORIZON)
    assert df.columns == soil.HORIZON.names and sorted(r.soc or -1 for r in df.collect()) == [-1, 12.5]
    assert readers.REGISTRY["good"][1]["soc_unit"] == "pct"
    with pytest.raises(RuntimeError):
        readers.collect_sources(spark, ["broken"], soil.HORIZON)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], 2.0), (2, [], None)], "entity_id int, flags array<string>, v double")
    sinks.export(df, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/parquet")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "x/csv")).columns == df.columns
    assert sinks.checkpointed(df, str(tmp_path / "c")).count() == 2
    sinks.entity_series(df.drop("flags"), df.drop("flags"), str(tmp_path / "s"))
    assert (tmp_path / "s/series/entity_id=1").is_dir() and spark.read.json(str(tmp_path / "s/results")).count() == 2
    assert sinks.one_row(df.where("entity_id = 1"), str(tmp_path / "o"))["v"] == 2.0
    with pytest.raises(ValueError):
        sinks.one_row(df, str(tmp_path / "o"))
    b = spark.createDataFrame([(bytearray(b"II*\x00rest"),), (bytearray(b"PK"),)], "content binary")
    assert [r[0] for r in b.select(sinks.is_tiff(F.col("content"))).collect()] == [True, False]
    nested = spark.createDataFrame([("f", [("p1", True)])], "file string, pages array<struct<page:string,ok:boolean>>")
    assert [r[0] for r in sinks.json_rows(nested, "decisions").collect()] == ['{"file":"f","page":"p1","ok":true}']
    assert sinks.json_rows(nested, "array").first()[0] == '[{"page":"p1","ok":true}]'


# plug-ins -------------------------------------------------------------------------------------------------------------


def plug_ins():
    """Made here so that they travel to the workers by value."""

    class Length:
        def detect(self, page):
            if page["text"] is None:
                raise ValueError("no text")
            short = len(page["text"]) < 3
            return {"label": "cut" if short else "accepted", "issues": ["cut_off"] if short else [], "confidence": 0.9}

    def missing():
        raise ImportError("no such model")

    return {"length": Length, "model": missing}


def test_detectors(spark):
    pages = spark.createDataFrame([(1, "abc"), (2, "a"), (3, None)], "page int, text string")
    out = detectors.vote(pages, plug_ins(), {"length": 1.25})
    d = votes.decision(F.col("votes"), 0.5)
    assert rows(out.orderBy("page").select("page", d["accepted"], d["label"])) == [(1, True, "accepted"), (2, False, "cut"), (3, False, "error")]
    v = out.where("page = 3").first().votes
    assert [x.available for x in v] == [False, False] and "no text" in v[0].error and "no such model" in v[1].error
    assert detectors.available(["a", "b"], lambda n: n == "b", "z") == (["b"], ["a is not available"])
    assert detectors.available(["a"], lambda n: False, "z")[0] == ["z"]


def test_per_entity_errors(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, 4.0), (2, 0.0)], "id int, v double")
    out = detectors.per_entity(df, lambda r: {"id": r["id"], "inverse": 1 / r["v"]}, T.StructType([T.StructField("id", T.DoubleType()), T.StructField("inverse", T.DoubleType())]))
    got = {r.error is None: r for r in out.collect()}
    assert got[True].inverse == 0.25 and "ZeroDivisionError" in got[False].error


# edges ----------------------------------------------------------------------------------------------------------------


def test_series_edges(spark):
    day = lambda k: dt.date(2025, 1, 1) + dt.timedelta(k)
    data = [("none", day(k), None) for k in range(3)] + [("one", day(0), 5.0)] + [("gap", day(k), v) for k, v in enumerate([None, 1.0, None, None, 4.0, None])]
    df = spark.createDataFrame(data, "entity_id string, obs_date date, value double")
    got = {}
    for r in series.interpolate(df).orderBy("obs_date").collect():
        got.setdefault(r.entity_id, []).append(r.filled)
    assert got == {"none": [None] * 3, "one": [5.0], "gap": [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]}
    empty = df.limit(0)
    for f in (lambda d: series.interpolate(d), lambda d: series.despike(d), lambda d: series.trapezoid(d), lambda d: series.pick_peak(d, 1.0), lambda d: series.greenup(d, 1.0), lambda d: runs.wetness(d), lambda d: runs.longest_run(d, F.col("value") > 1), lambda d: runs.otsu(d, ["entity_id"])):
        assert f(empty).count() == 0


def test_savgol_is_a_quadratic_fit(spark):
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0]
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1 + k), x) for k, x in enumerate(v)], "entity_id string, obs_date date, value double")
    got = [r[0] for r in df.select(series.savgol(F.col("value")).alias("s"), "obs_date").orderBy("obs_date").collect()]
    padded = [v[0]] * 3 + v + [v[-1]] * 3
    want = [np.polyval(np.polyfit(range(-3, 4), padded[k : k + 7], 2), 0) for k in range(len(v))]
    assert np.allclose(got, want)


def test_exact_quantiles_of_many_rows(spark, monkeypatch):
    r = random.Random(9)
    for values in ([r.gauss(0, 1) for _ in range(3000)], [1.0] * 2500 + [2.0] * 3 + [9.0], [float(k % 7) for k in range(2000)], [5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        p = [0.0, 0.02, 0.25, 0.5, 0.77, 0.999, 1.0]
        monkeypatch.setattr(stats, "ONE_TASK", 100)
        assert np.allclose(stats.exact_quantiles(df, "v", p), np.quantile(values, p))
        monkeypatch.undo()
    assert stats.exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_p_values(spark):
    for t, f, p in ((2.0, 10, 0.07338803), (0.0, 5, 1.0), (-3.5, 28, 0.001572), (12.706, 1, 0.05), (1.96, 1e6, 0.049996)):
        assert abs(stats.two_sided(t, f) - p) < 2e-5
    assert stats.two_sided(None, 3) is None and stats.two_sided(1.0, 0) is None
    df = spark.createDataFrame([(float(k), float(k + (k * 7) % 5), float((k * 37) % 11)) for k in range(30)], "y double, a double, b double")
    got = stats.correlation_screen(df, "y", ["b", "a"]).collect()
    assert [r.feature for r in got] == ["a", "b"] and got[0].significant and got[0].p < 1e-6 and not got[1].significant

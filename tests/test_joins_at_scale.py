"""Joins of ranges and distances, quantiles of large groups, kernels in tiles: no nested loops, dense cells, long chains, against brute force."""

import random

import numpy as np
import pytest

from loamwork.operators import joins, raster, stats

INF = float("inf")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,small", [(40, 10_000), (20_000, 10_000), (40, 0)])
def test_range_join(spark, monkeypatch, n, small):
    monkeypatch.setattr(joins, "SMALL", small)
    r = random.Random(n)
    values = [(k, x) for k, x in enumerate([r.uniform(-50, 1050) for _ in range(300)] + [None, INF, -INF, float("nan"), 0.0, 1000.0])]
    step = 1000 / n
    ranges = [(f"r{k}", k * step, (k + 1.5) * step) for k in range(n)] + [("low", -INF, 0.0), ("high", 1000.0, INF), ("empty", 5.0, 5.0), ("back", 9.0, 3.0), ("none", None, 4.0)]
    left = spark.createDataFrame(values, "k int, x double")
    out = joins.range_join(left, spark.createDataFrame(ranges, "name string, a double, b double"), "x", "a", "b")
    assert out.columns == ["k", "x", "name", "a", "b"]
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = sorted((k, m) for k, x in values for m, a, b in ranges if None not in (x, a, b) and a <= x < b)
    assert sorted((q.k, q.name) for q in out.collect()) == want


@pytest.mark.parametrize("keys,bucket,small", [([], None, 10_000), (["g"], None, 0), (["g"], 7.5, 10_000), ([], None, 0)])
def test_overlap_join(spark, monkeypatch, keys, bucket, small):
    monkeypatch.setattr(joins, "SMALL", small)
    r = random.Random(3)
    side = lambda n, longest: [(k, k % 3, a, a + r.choice([0.0, 1.0, longest * r.random()])) for k in range(n) for a in [r.uniform(0, 100)]]
    left, right = side(120, 60), [*side(90, 9), (200, 1, -INF, 3.0), (201, 2, 50.0, INF), (202, 0, 5.0, 1.0), (203, 0, None, 1.0)]
    l = spark.createDataFrame(left, "i int, g int, a double, b double")
    rows = spark.createDataFrame(right, "j int, g int, c double, d double")
    out = joins.overlap_join(l, rows if keys else rows.drop("g"), keys, ("a", "b"), ("c", "d"), bucket)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = sorted((i, j, round(min(b, d) - max(a, c), 9)) for i, g, a, b in left for j, h, c, d in right if None not in (c, d) and c <= d and a < d and c < b and (g == h or not keys))
    assert sorted((q.i, q.j, round(q.overlap, 9)) for q in out.collect()) == want


@pytest.mark.parametrize("dense", [2_000, 10])
def test_near_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(joins, "DENSE", dense)
    r = random.Random(1)
    points = [(k, r.uniform(0, 40), r.uniform(0, 40)) for k in range(250)] + [(300 + k, 5 + r.random(), 5 + r.random()) for k in range(120)] + [(7, 0.1, 0.1)]
    got = joins.near_pairs(spark.createDataFrame(points, "id long, x double, y double"), 2.0).collect()
    want = sorted((min(i, j), max(i, j)) for n, (i, a, b) in enumerate(points) for j, c, d in points[:n] if i != j and ((a - c) ** 2 + (b - d) ** 2) ** 0.5 <= 2.0)
    assert sorted((q.id_a, q.id_b) for q in got) == want


def greedy(ids, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    dropped = {}
    for i in sorted(ids):
        dropped[i] = any(dropped[a] is False for a in near.get(i, []))
    return dropped


@pytest.mark.parametrize("n,shuffled", [(150, False), (5_000, False), (600, True)])
def test_keep_first_along_a_line(spark, n, shuffled):
    ids = list(range(n))
    if shuffled:
        random.Random(2).shuffle(ids)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])]
    points = spark.createDataFrame([(i,) for i in [*ids, n + 5]], "id long")
    got = {q.id: q.dropped for q in joins.keep_first(points, spark.createDataFrame(pairs, "id_a long, id_b long").repartition(5)).collect()}
    assert got == greedy([*ids, n + 5], pairs)


def test_keep_first_of_a_crowd(spark):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(200), 2))) for _ in range(1500)})
    points = spark.createDataFrame([(i,) for i in range(200)], "id int")
    got = {q.id: q.dropped for q in joins.keep_first(points, spark.createDataFrame(pairs, "id_a int, id_b int")).collect()}
    assert got == greedy(range(200), pairs)
    assert joins.keep_first(points.limit(0), spark.createDataFrame([], "id_a int, id_b int")).count() == 0


@pytest.mark.parametrize("hot,rounds", [(10_000, 1_000), (0, 20), (10_000, 20)])
def test_quantiles_of_large_groups(spark, monkeypatch, hot, rounds):
    r = random.Random(6)
    values = {"skewed": [r.paretovariate(0.5) for _ in range(3000)], "ties": [float(r.randrange(4)) for _ in range(2500)], "one": [5.0] * 1500, None: [r.gauss(0, 1) for _ in range(1200)], "small": [3.0, 1.0, 2.0], "none": []}
    rows = [(k, x) for k, xs in values.items() for x in [*xs, None]]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    monkeypatch.setattr(stats, "ONE_TASK", 1_000)
    monkeypatch.setattr(stats, "HOT_GROUPS", hot)
    monkeypatch.setattr(stats, "ROUND", rounds)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {q.k: q._q for q in stats.group_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(values) and got["none"] is None
    for k, xs in values.items():
        if xs:
            assert got[k] == pytest.approx(np.quantile(xs, shares).tolist(), rel=1e-12)
    zones = {z.k: z for z in stats.zonal(df, ["k"], "v").collect()}
    assert zones["none"].n == 0 and zones["none"].median is None and zones[None].n == 1200 and zones["ties"].median == np.median(values["ties"])


@pytest.mark.parametrize("radius,tile", [(1, 256), (2, 5), (3, 4)])
def test_focal_median_in_tiles(spark, radius, tile):
    r = random.Random(radius)
    grid = {(a, b): None if r.random() < 0.2 else float(r.randrange(50)) for a in range(13) for b in range(9) if r.random() < 0.9}
    pixels = spark.createDataFrame([("s", a, b, v) for (a, b), v in grid.items()], "scene string, row int, col int, value double")
    got = {(p.row, p.col): p.focal for p in raster.focal_median(pixels, radius, tile).collect()}
    for (a, b), v in grid.items():
        near = [x for (c, d), x in grid.items() if abs(a - c) <= radius and abs(b - d) <= radius and x is not None]
        assert got[a, b] == (None if v is None else float(np.median(near)))
    assert len(got) == len(grid)

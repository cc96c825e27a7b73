"""Linear models from moments, trends and boosted classes, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import models, stats


def frame(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal([100, 5, 0, 0.5], [20, 1, 3, 0.1], (n, 4))
    y = 3 * x[:, 0] - 40 * x[:, 1] + rng.normal(0, 5, n)
    return x, y, spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y double")


def test_lasso_strength_by_folds(spark):
    x, y, df = frame(spark)
    columns = ["a", "b", "c", "d"]
    strength, weights = models.lasso_path(df, columns, "y")
    z = (x - x.mean(0)) / x.std(0)
    gradient = z.T @ (y - y.mean() - z @ weights) / len(y)
    for w, g in zip(weights, gradient):  # the optimum's conditions at the chosen strength
        assert g == pytest.approx(np.sign(w) * strength, abs=1e-6) if w else abs(g) <= strength + 1e-6
    assert {"a", "b"} <= set(models.lasso_selection(df, columns, "y")) and models.lasso_selection(df, columns, "y", strength=20.0) == ["a", "b"]
    noise = df.withColumn("y", F.rand(3))
    assert len(models.lasso_path(noise, columns, "y")[1]) == 4
    gaps = df.withColumn("a", F.when(F.col("c") > 0, F.col("a")))
    assert "b" in models.lasso_selection(gaps, columns, "y")


def test_errors_by_fold(spark):
    x, y, df = frame(spark, 200)
    m = models.Moments(df, ["a", "b", "c", "d"], "y", 4)
    w = np.array([2.0, -30.0, 0.5, 1.0])
    whole = sum(m.error(k, w, 1.5) for k in range(len(m.parts)))
    assert whole == pytest.approx((((y - y.mean()) - (x - x.mean(0)) @ w - 1.5) ** 2).sum(), rel=1e-9)
    assert sum(p[0] for p in m.parts) == 200 and len(m.parts) == 4


def test_bayesian_ridge(spark):
    x, y, df = frame(spark, 300)
    prediction, weights, noise, prior = models.bayesian_ridge(df, ["a", "b", "c", "d"], "y")
    z, t = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(z.T @ z + prior / noise * np.eye(4), z.T @ t)
    assert list(weights.values()) == pytest.approx(w.tolist(), rel=1e-6)
    assert 1 / noise == pytest.approx(25, rel=0.2)
    got = [r[0] for r in df.select(prediction).collect()]
    assert got == pytest.approx((y.mean() + z @ w).tolist(), rel=1e-6)


def test_lowess(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 200)
    y = np.sin(x) + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)], "x double, y double")
    got = {r["at"]: r["trend"] for r in stats.lowess(df, "x", "y", [0.0, 3.3, 9.9], 0.25).collect()}
    for a, v in got.items():
        d = np.abs(x - a)
        w = (1 - np.minimum(d / np.sort(d)[49], 1) ** 3) ** 3
        line = np.polyfit(x, y, 1, w=np.sqrt(w))
        assert v == pytest.approx(np.polyval(line, a), abs=1e-8)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert [r.trend for r in stats.lowess(same, "x", "y", [1.0], 1.0).collect()] == [3.0]
    assert [r.trend for r in stats.lowess(same.limit(0), "x", "y", [1.0]).collect()] == [None]


def test_normality(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v), float(e)) for v, e in zip(rng.normal(size=3000), rng.exponential(size=3000))], "n double, e double")
    assert stats.normality(df, "n").first().p > 0.01 and stats.normality(df, "e").first().p < 1e-9


def test_boosted_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(k % 3 * 3, 1, 4)], k % 3) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = models.boost_cover(df.where("id < 180"), df, "v", "label", rounds=3, depth=2).where("id >= 180").collect()
    assert np.mean([g.class_id == g.label for g in got]) > 0.9 and all(0 < g.confidence <= 1 for g in got)

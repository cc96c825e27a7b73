"""Model-side operators: collinearity, mutual information, scaling, splits, regressors, classifiers, selections."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators.sampling import split


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix in one pass: a number for each pair of columns comes to the driver."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = df.agg(*(F.corr(columns[i], columns[j]) for i, j in pairs)).first() if pairs else ()
    out = np.eye(len(columns))
    for (i, j), r in zip(pairs, row):
        out[i, j] = out[j, i] = 0.0 if r is None else r
    return out


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix; infinite where it is singular."""
    r = correlation_matrix(df, columns)
    try:
        return dict(zip(columns, np.diag(np.linalg.inv(r)).tolist()))
    except np.linalg.LinAlgError:
        return dict.fromkeys(columns, float("inf"))


def drop_by_vif(df: DataFrame, columns: list[str], most: float = 5.0) -> list[str]:
    """Columns left after the one with the largest inflation is dropped until all lie under most. One pass over df."""
    r, left = correlation_matrix(df, columns), list(range(len(columns)))
    while len(left) > 1:
        sub = r[np.ix_(left, left)]
        inflation = np.diag(np.linalg.pinv(sub)) if np.linalg.matrix_rank(sub) == len(left) else _singular(sub)
        worst = int(np.argmax(inflation))
        if inflation[worst] <= most:
            break
        del left[worst]
    return [columns[k] for k in left]


def _singular(r: np.ndarray) -> np.ndarray:
    """Infinite for the columns that others explain wholly, 1 for the rest."""
    out = np.ones(len(r))
    for k in range(len(r)):
        rest = np.delete(np.arange(len(r)), k)
        b, *_ = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, k], rcond=None)
        out[k] = np.inf if 1 - b @ r[rest, k] < 1e-9 else 1 / (1 - b @ r[rest, k])
    return out


def drop_collinear(df: DataFrame, columns: list[str], most: float = 0.98) -> list[str]:
    """Columns without those that correlate beyond most with one before them."""
    r, kept = np.abs(correlation_matrix(df, columns)), []
    for k in range(len(columns)):
        if all(r[k, j] <= most for j in kept):
            kept.append(k)
    return [columns[k] for k in kept]


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 16) -> DataFrame:
    """(feature, mi) in nats between equal-width bins of each column and of the target, largest first."""
    ends = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_e_{c}") for c in [*columns, target]))
    wide = df.join(F.broadcast(ends))
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"_e_{c}.lo"), F.col(f"_e_{c}.hi") - F.col(f"_e_{c}.lo")) * bins), F.lit(bins - 1)), F.lit(0))
    rows = wide.select(place(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), place(c).alias("x")) for c in columns))).alias("f")).select("y", "f.*")
    xy = rows.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))  # bins^2 rows for each feature
    x = xy.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    y = xy.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = xy.groupBy("feature").agg(F.sum("n").alias("t"))
    joined = xy.join(x, ["feature", "x"]).join(y, ["feature", "y"]).join(total, "feature")
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return joined.groupBy("feature").agg(F.sum(part).alias("mi")).orderBy(F.col("mi").desc(), "feature")


def scaling(columns: list[str], robust: bool = False) -> Pipeline:
    """Median imputation and scaling, to be fitted inside folds."""
    filled = [f"_i_{c}" for c in columns]
    scaler = RobustScaler(inputCol="_raw", outputCol="features", withCentering=True) if robust else StandardScaler(inputCol="_raw", outputCol="features", withMean=True)
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw"), scaler])


def regressor(kind: str, **options):
    """linear, ridge, lasso, elastic, forest or boosted."""
    if kind in ("linear", "ridge", "lasso", "elastic"):
        mix = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0, "elastic": 0.5}[kind]
        return LinearRegression(labelCol="label", elasticNetParam=mix, regParam=options.pop("strength", 0.0 if kind == "linear" else 0.1), **options)
    if kind == "forest":
        return RandomForestRegressor(labelCol="label", seed=options.pop("seed", 1), **options)
    if kind == "boosted":
        return GBTRegressor(labelCol="label", seed=options.pop("seed", 1), **options)
    raise ValueError(f"unknown kind {kind}")


def fit_and_predict(df: DataFrame, columns: list[str], target: str, kind: str, group: Column, test: float = 0.2, **options) -> DataFrame:
    """Rows with part (0 train, 1 test) and prediction of a model fitted on part 0; scaling is fitted there too."""
    parts = df.withColumn("label", F.col(target).cast("double")).withColumn("part", split(group, [1 - test, test]))
    model = Pipeline(stages=[scaling(columns), regressor(kind, **options)]).fit(parts.where("part = 0"))
    return model.transform(parts).drop("_raw", "features", *(f"_i_{c}" for c in columns))


def cross_validated(df: DataFrame, columns: list[str], target: str, kind: str, key: Column, folds: int = 5, **options) -> DataFrame:
    """Out-of-fold predictions of every row; folds by hashes of the key, so groups stay together."""
    held = df.withColumn("label", F.col(target).cast("double")).withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = None
    for k in range(folds):
        model = Pipeline(stages=[scaling(columns), regressor(kind, **options)]).fit(held.where(F.col("fold") != k))
        part = model.transform(held.where(F.col("fold") == k)).drop("_raw", "features", *(f"_i_{c}" for c in columns))
        out = part if out is None else out.unionByName(part)
    return out


def stacked(df: DataFrame, columns: list[str], target: str, kinds: list[str], key: str, folds: int = 4) -> DataFrame:
    """Ridge over the out-of-fold predictions of several kinds."""
    out = None
    for kind in kinds:
        part = cross_validated(df, columns, target, kind, F.col(key), folds).select(key, F.col("prediction").alias(f"_p_{kind}"))
        out = part if out is None else out.join(part, key)
    both = df.join(out, key)
    return fit_and_predict(both, [f"_p_{k}" for k in kinds], target, "ridge", F.col(key))


class Moments:
    """Counts, sums and products of filled columns and a target by fold: all that linear models need, from two passes over df.

    Columns are filled with their (approximate) median and shifted to their mean, which keeps the sums well conditioned.
    """

    def __init__(self, df: DataFrame, columns: list[str], target: str, folds: int = 1):
        known = df.where(F.col(target).isNotNull())
        first = known.agg(*(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000) for c in columns), *(F.avg(c) for c in [*columns, target])).first()
        p = len(columns)
        self.columns, self.fill = columns, [0.0 if m is None else float(m) for m in first[:p]]
        self.shift = [0.0 if m is None else float(m) for m in first[p:]]
        z = [F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a) for c, m, a in zip(columns, self.fill, self.shift)] + [F.col(target).cast("double") - F.lit(self.shift[-1])]
        pairs = [(i, j) for i in range(p + 1) for j in range(i + 1)]
        fold = F.pmod(F.xxhash64(*columns, target), F.lit(folds)).alias("fold")
        rows = known.groupBy(fold).agg(F.count(F.lit(1)), *(F.sum(x) for x in z), *(F.sum(z[i] * z[j]) for i, j in pairs)).collect()  # a row for each fold
        self.parts = []
        for row in rows:
            products = np.zeros((p + 1, p + 1))
            for (i, j), v in zip(pairs, row[p + 3 :]):
                products[i, j] = products[j, i] = v
            self.parts.append((row[1], np.array(row[2 : p + 3], float), products))

    def without(self, left_out: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, means and covariances (population) of all folds but one."""
        some = [x for k, x in enumerate(self.parts) if k != left_out]
        n = sum(x[0] for x in some)
        mean = sum(x[1] for x in some) / n
        return n, mean, sum(x[2] for x in some) / n - np.outer(mean, mean)

    def error(self, fold: int, weights: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a linear model of the shifted columns on one fold."""
        n, total, products = self.parts[fold]
        w = np.append(-weights, 1.0)
        return float(w @ products @ w - 2 * intercept * (w @ total) + n * intercept**2)

    def predict(self, weights: np.ndarray, intercept: float) -> Column:
        """The model as an expression of df's columns."""
        terms = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a)) * F.lit(float(w)) for c, m, a, w in zip(self.columns, self.fill, self.shift, weights)]
        return sum(terms, F.lit(float(intercept) + self.shift[-1]))


def _soft_descent(covariance: np.ndarray, with_target: np.ndarray, strength: float, start: np.ndarray) -> np.ndarray:
    """Weights that minimise half the mean squared error plus strength times the sum of their sizes, for columns of variance 1."""
    w = start.copy()
    for _ in range(10_000):
        before = w.copy()
        for k in range(len(w)):
            rest = with_target[k] - covariance[k] @ w + w[k] * covariance[k, k]
            w[k] = np.sign(rest) * max(abs(rest) - strength, 0.0) / covariance[k, k] if covariance[k, k] > 0 else 0.0
        if abs(w - before).max() <= 1e-10 * max(1.0, abs(w).max()):
            break
    return w


def lasso_path(df: DataFrame, columns: list[str], target: str, folds: int = 5, strengths: int = 30, depth: float = 1e-3) -> tuple[float, np.ndarray]:
    """(strength, weights) of an L1 fit on scaled columns; the strength with the least error over folds, from the one that leaves no column down to depth of it.

    Folds, path and fits come from one pass of moments, however large df is.
    """
    m = Moments(df, columns, target, folds)

    def scaled(part):
        _, mean, cov = part
        sd = np.sqrt(np.diag(cov)[:-1])
        sd[sd == 0] = 1.0
        return mean, cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd, sd

    _, gram, xy, _ = scaled(m.without())
    path = max(abs(xy).max(), 1e-12) * np.geomspace(1, depth, strengths)
    errors = np.zeros(strengths)
    for fold in range(len(m.parts) if len(m.parts) > 1 else 0):
        mean, g, c, sd = scaled(m.without(fold))
        w = np.zeros(len(columns))
        for k, strength in enumerate(path):
            w = _soft_descent(g, c, strength, w)
            errors[k] += m.error(fold, w / sd, mean[-1] - mean[:-1] @ (w / sd))
    best = float(path[int(np.argmin(errors))])
    return best, _soft_descent(gram, xy, best, np.zeros(len(columns)))


def lasso_selection(df: DataFrame, columns: list[str], target: str, strength: float | None = None, least: float = 1e-5, folds: int = 5) -> list[str]:
    """Columns with a coefficient after an L1 fit on scaled columns, its strength chosen over folds unless given; all of them if none is left."""
    if strength is None:
        weights = lasso_path(df, columns, target, folds)[1]
    else:
        weights = Pipeline(stages=[scaling(columns), regressor("lasso", strength=strength)]).fit(df.withColumn("label", F.col(target).cast("double"))).stages[-1].coefficients
    return [c for c, w in zip(columns, weights) if abs(w) > least] or list(columns)


def bayesian_ridge(df: DataFrame, columns: list[str], target: str) -> tuple[Column, dict[str, float], float, float]:
    """(prediction, weights, precision of the noise, precision of the weights) that maximise the evidence; from one pass of moments."""
    m = Moments(df, columns, target)
    n, mean, cov = m.without()
    values, vectors = np.linalg.eigh(cov[:-1, :-1] * n)
    values, xy, yy = np.maximum(values, 0), cov[:-1, -1] * n, cov[-1, -1] * n
    noise, prior = 1 / max(yy / n, 1e-12), 1.0
    for _ in range(300):
        w = vectors @ ((vectors.T @ xy) / (values + prior / noise))
        used = (noise * values / (prior + noise * values)).sum()
        left = max(yy - 2 * w @ xy + w @ (cov[:-1, :-1] * n) @ w, 1e-12)
        new = used / max(w @ w, 1e-12), max(n - used, 1e-12) / left
        done = abs(new[0] - prior) <= 1e-9 * prior and abs(new[1] - noise) <= 1e-9 * noise
        prior, noise = max(new[0], 1e-12), new[1]
        if done:
            break
    return m.predict(w, mean[-1] - mean[:-1] @ w), dict(zip(columns, w.tolist())), noise, prior


def classify_cover(train: DataFrame, rows: DataFrame, vector: str, label: str, classes: int, trees: int = 20, seed: int = 1) -> DataFrame:
    """rows with class_id and probability (array) of a weighted forest over an array of numbers."""
    from pyspark.ml.functions import array_to_vector

    weights = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, kinds = train.count(), weights.count()
    weighted = train.join(F.broadcast(weights), label).withColumn("weight", F.lit(total) / (kinds * F.col("_n")))
    vectors = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, seed=seed).fit(vectors(weighted).withColumn(label, F.col(label).cast("double")))
    out = model.transform(vectors(rows))
    p = vector_to_array("probability")
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("class_id"), F.array_max(p).alias("confidence"), F.slice(p, 1, classes).alias("probability"))


def boost_cover(train: DataFrame, rows: DataFrame, vector: str, label: str, rounds: int = 20, depth: int = 4, seed: int = 1) -> DataFrame:
    """rows with class_id and confidence of boosted trees, one model for each class against the rest, classes weighted alike."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    weights = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, kinds = train.count(), weights.count()
    weighted = train.join(F.broadcast(weights), label).withColumn("weight", F.lit(total) / (kinds * F.col("_n")))  # a row for each class
    vectors = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    model = OneVsRest(classifier=boosted, labelCol=label, weightCol="weight", parallelism=4).fit(vectors(weighted).withColumn(label, F.col(label).cast("double")))
    out = model.transform(vectors(rows))
    chance = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total_chance = F.aggregate(chance, F.lit(0.0), lambda a, x: a + x)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("class_id"), (F.array_max(chance) / total_chance).alias("confidence"))

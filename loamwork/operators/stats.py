"""Grouped statistics: fences, bands, bins, modes, fractions, metrics, summaries."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows that one task may hold to take an exact quantile, and parts into which more are cut at a time.
ONE_TASK, PARTS = 1_000_000, 64
#: Large groups that are broadcast, after counting them, and the part of a group that is ordered for a quantile.
HOT_GROUPS, ROUND = 10_000, 1_000


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation of a whole column, whatever its size.

    Up to ONE_TASK rows the aggregate does it. Beyond, counts between approximate cuts tell which stretch holds the
    wanted ranks, and only that stretch is looked at further; a few numbers come to the driver each time.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = v.count()
    if n <= ONE_TASK:
        return list(v.agg(F.percentile("v", F.array(*map(F.lit, probabilities)))).first()[0] or [None] * len(probabilities))
    out = []
    for p in probabilities:
        at = (n - 1) * p
        low = _of_rank(v, n, int(at))
        high = low if at == int(at) else _of_rank(v, n, int(at) + 1)
        out.append(low + (high - low) * (at - int(at)))
    return out


def _of_rank(v: DataFrame, n: int, rank: int) -> float:
    """The value with ``rank`` smaller ones before it in order."""
    while n > ONE_TASK:
        lo, hi, cuts = v.agg(F.min("v"), F.max("v"), F.percentile_approx("v", F.array(*(F.lit(k / PARTS) for k in range(1, PARTS))), 10_000)).first()
        edges = sorted({c for c in cuts if lo < c <= hi})
        if lo == hi or not edges:
            return lo if lo == hi else _split(v, lo, hi, rank)
        part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("v")))
        counts = dict(v.groupBy(part.alias("k")).count().collect())
        for k in range(len(edges) + 1):
            if rank < counts.get(k, 0):
                break
            rank -= counts.get(k, 0)
        if k > 0:
            v = v.where(F.col("v") >= edges[k - 1])
        if k < len(edges):
            v = v.where(F.col("v") < edges[k])
        n = counts[k]
    return v.agg(F.percentile("v", F.lit(rank / max(1, n - 1)))).first()[0]


def _split(v: DataFrame, lo: float, hi: float, rank: int) -> float:
    """Of a stretch whose cuts all equal its smallest value: that value, or go on above it."""
    at_low = v.where(F.col("v") == lo).count()
    above = v.where(F.col("v") > lo)
    return lo if rank < at_low else _of_rank(above, above.count(), rank - at_low)


def area_summary(classes: DataFrame, area: Column) -> DataFrame:
    """One row of hectares by class and the share of the first; half-even rounding to 4 and 2 places."""
    total = lambda when: F.coalesce(F.sum(F.when(when, area)), F.lit(0.0))
    awd, cont = total(F.col("is_awd")), total(F.col("continuous"))
    paddy = total(F.col("is_awd") | F.col("continuous"))
    sums = classes.agg(awd.alias("a"), cont.alias("c"), paddy.alias("p"))
    return sums.select(
        F.bround(F.col("a") / 1e4, 4).alias("awd_area_ha"), F.bround(F.col("c") / 1e4, 4).alias("continuous_area_ha"), F.bround(F.col("p") / 1e4, 4).alias("paddy_area_ha"),
        F.when(F.col("p") > 0, F.bround(F.col("a") / F.col("p") * 100, 2)).otherwise(0.0).alias("pct_awd"),
    )


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null to null; right's keys have a leading underscore."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def group_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys and _q: exact quantiles of each group's known values as an array (linear interpolation), null without any.

    Groups up to ONE_TASK rows go through Spark's aggregate, which holds a group's distinct values in one task. Of larger ones
    a sketch tells, for each share, bounds around its rank with about 1 / ROUND of the rows between; these alone are
    ordered, and the rows below are counted in the same pass. So no task holds a large group, whatever its distribution.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v"))
    plain = lambda rows: rows.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_q"))
    hot = v.groupBy(*keys).agg(F.count("_v").alias("_n")).where(F.col("_n") > ONE_TASK).select(*(F.col(k).alias(f"_{k}") for k in keys), "_n")
    few = hot.limit(HOT_GROUPS + 1).count()
    if not few:
        return plain(v)
    side = F.broadcast(hot) if few <= HOT_GROUPS else hot
    rest = plain(v.join(side, _same(v, hot, keys), "left_anti"))
    inside = v.join(side, _same(v, hot, keys)).where(F.col("_v").isNotNull()).drop(*(f"_{k}" for k in keys))
    around = lambda d: F.array(*(F.lit(min(1.0, max(0.0, q + d))) for q in shares))
    bounds = inside.groupBy(*keys).agg(F.percentile_approx("_v", around(-1 / ROUND), 10 * ROUND).alias("_lo"), F.percentile_approx("_v", around(1 / ROUND), 10 * ROUND).alias("_hi"))
    bounds = bounds.select(*(F.col(k).alias(f"_{k}") for k in keys), "_lo", "_hi")
    seen = inside.join(F.broadcast(bounds) if few <= HOT_GROUPS else bounds, _same(inside, bounds, keys)).drop(*(f"_{k}" for k in keys))
    # a share's sketch may give the smallest or largest value only nearly: all rows are below no bound or above none then
    low = lambda i: F.lit(float("-inf")) if shares[i] <= 1 / ROUND else F.col("_lo")[i]
    high = lambda i: F.lit(float("inf")) if shares[i] >= 1 - 1 / ROUND else F.col("_hi")[i]
    # one pass tells the rows below (_v null) and those between, as a second look might get other bounds: a sketch depends on the order of its parts
    place = lambda i: F.when(F.col("_v") < low(i), F.struct(F.lit(i).alias("_i"), F.lit(None).cast("double").alias("_v"))).when(F.col("_v") <= high(i), F.struct(F.lit(i).alias("_i"), F.col("_v")))
    placed = seen.select(*keys, "_n", F.inline(F.array_compact(F.array(*map(place, range(len(shares)))))))
    counted = placed.groupBy(*keys, "_n", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    stop = F.col("_upto")
    ranked = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())))
    rank = (F.col("_n") - 1) * F.get(F.array(*map(F.lit, shares)), F.col("_i"))
    at = lambda r: F.max(F.when((stop - F.col("_c") <= r) & (r < stop), F.col("_v")))
    found = ranked.groupBy(*keys, "_i").agg(at(F.floor(rank)).alias("_a"), at(F.ceil(rank)).alias("_b"), F.first(rank - F.floor(rank)).alias("_f"))
    found = found.select(*keys, "_i", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_x"))
    return rest.unionByName(found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_q")))


def _with_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """df with _q of its group; rows with a null key are in no group."""
    return df.join(group_quantiles(df, keys, value, shares), keys)


def zonal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, p10, p90 (linear interpolation) and n of the non-null values."""
    q = group_quantiles(df, keys, value, [0.5, 0.1, 0.9]).select(*(F.col(k).alias(f"_{k}") for k in keys), "_q")
    sums = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return sums.join(q, _same(sums, q, keys)).select(*keys, "mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p10"), F.col("_q")[2].alias("p90"), "n")


def fences(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """Adds outside: whether value lies beyond k interquartile ranges of its group's quartiles; never where the range is 0."""
    spread = F.col("_q")[1] - F.col("_q")[0]
    out = (spread > 0) & ((F.col(value) < F.col("_q")[0] - k * spread) | (F.col(value) > F.col("_q")[1] + k * spread))
    return _with_quantiles(df, keys, value, [0.25, 0.75]).withColumn("outside", F.coalesce(out, F.lit(False))).drop("_q")


def inside_all_fences(df: DataFrame, columns: list[str], k: float) -> DataFrame:
    """Rows that lie inside the fences of every column; the quartiles enter the filter as numbers."""
    ok = F.lit(True)
    for c in columns:
        lo, hi = exact_quantiles(df, c, [0.25, 0.75])
        ok = ok & (F.col(c).between(lo - k * (hi - lo), hi + k * (hi - lo)) if lo is not None else F.lit(False))
    return df.where(ok)


def band(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows between two quantiles of their group, both inclusive."""
    return _with_quantiles(df, keys, value, [low, high]).where(F.col(value).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def quantile_bins(df: DataFrame, keys: list[str], value: str, n: int = 4) -> DataFrame:
    """Adds bin 0..n-1 by right-closed quantile edges, the lowest value included; null where edges repeat."""
    shares = [i / n for i in range(n + 1)]
    if keys:
        joined = _with_quantiles(df, keys, value, shares).withColumnRenamed("_q", "_e")
    else:
        joined = df.withColumn("_e", F.array(*(F.lit(q).cast("double") for q in exact_quantiles(df, value, shares))))
    whole = F.size(F.array_distinct("_e")) == n + 1
    place = F.size(F.filter(F.slice("_e", 2, n - 1), lambda e: e < F.col(value)))
    return joined.withColumn("bin", F.when(whole & F.col(value).isNotNull(), place)).drop("_e")


def equal_bins(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """Adds bin 0..n-1 of equal width, right-closed, the lowest edge moved down by a thousandth of the range."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.greatest(F.ceil((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / n)) - 1, F.lit(0))
    return df.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(n - 1))).cast("int")).drop("_lo", "_hi")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode, n): the most frequent value, the smallest on ties. A hot key is counted by value first."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("mode"), (-F.col("b.k")).alias("n"))


def fractions(df: DataFrame, keys: list[str], value: str, places: int = 6) -> DataFrame:
    """(keys, value, fraction) of each value that occurs."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, value, F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), places).alias("fraction"))


def binary_metrics(df: DataFrame, truth: Column, said: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy; a ratio without cases is null."""
    c = df.groupBy(*(keys or [])).agg(*(F.count_if(t & s).alias(n) for n, t, s in (("tp", truth, said), ("fp", ~truth, said), ("tn", ~truth, ~said), ("fn", truth, ~said))))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    r = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select(*(keys or []), "tp", "fp", "tn", "fn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), r(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def class_metrics(df: DataFrame, truth: str, said: str, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, label, precision, recall, f1, support) for each of a fixed list of labels; ratios without cases are 0."""
    keys = keys or []
    rows = df.select(*keys, truth, said, F.explode(F.array(*map(F.lit, labels))).alias("label"))  # a fixed handful of labels
    t, s = F.col(truth) == F.col("label"), F.col(said) == F.col("label")
    c = rows.groupBy(*keys, "label").agg(F.count_if(t & s).alias("tp"), F.count_if(t).alias("support"), F.count_if(s).alias("n_said"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return c.select(*keys, "label", r(F.col("tp"), F.col("n_said")).alias("precision"), r(F.col("tp"), F.col("support")).alias("recall"), r(2 * F.col("tp"), F.col("support") + F.col("n_said")).alias("f1"), "support")


def confusion(df: DataFrame, truth: str, said: str, labels: list[str]) -> DataFrame:
    """(truth, said, n) for every pair of a fixed list of labels, 0 where none occurs."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} string, {said} string")
    counted = df.groupBy(truth, said).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counted, [truth, said], "left").select(truth, said, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts with one column for each of the values, 0 where none occurs."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def missing_report(df: DataFrame) -> DataFrame:
    """(column, pct): share of nulls of each column in percent, from one pass."""
    one = df.agg(*(F.round(F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0)), 6).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column", "pct")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (classes * n of the class)."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row for each class
    return counted.select(label, "n", F.round(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), 6).alias("weight"))


def errors(df: DataFrame, truth: str, said: str, keys: list[str] | None = None) -> DataFrame:
    """rmse, mae, r2 and mape (percent) in one pass."""
    e = F.col(truth) - F.col(said)
    a = df.groupBy(*(keys or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth))).alias("r2"), (F.avg(F.abs(F.try_divide(e, F.col(truth)))) * 100).alias("mape"))
    return a


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(feature, r, t): Pearson's r of each column with target, largest absolute value first, t with n - 2 degrees; null under 3 rows."""
    one = df.agg(*(F.corr(c, target).alias(c) for c in columns), *(F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias(f"{c}_n") for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"), F.col(f"{c}_n").alias("n")) for c in columns))).alias("x")).select("x.*")
    return rows.where("n >= 3").withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).orderBy(F.abs("r").desc_nulls_last(), "feature")


def clipped_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n) of values clipped to [low, high]; the last bin holds the upper end too."""
    v = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def two_sided(t: float | None, freedom: float | None) -> float | None:
    """Chance of a Student t at least this far from 0."""
    if t is None or freedom is None or freedom <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([two_sided(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(t, freedom)], dtype="float64")


def correlation_screen(df: DataFrame, target: str, columns: list[str], level: float = 0.05) -> DataFrame:
    """correlations() with p and significant, significant features first, then by absolute r."""
    c = correlations(df, target, columns).withColumn("p", p_value("t", F.col("n") - 2))
    c = c.withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))
    return c.orderBy(F.col("significant").desc(), F.abs("r").desc_nulls_last(), "feature")


def normality(df: DataFrame, value: str) -> DataFrame:
    """One row: n, skewness and excess kurtosis of the known values, the statistic of Jarque and Bera, and its p-value."""
    m = df.agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    m = m.withColumn("statistic", F.col("n") / 6 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4))
    return m.withColumn("p", F.exp(-F.col("statistic") / 2))


def lowess(df: DataFrame, x: str, y: str, at: list[float], share: float = 0.3) -> DataFrame:
    """(at, trend): at each place a line fitted to the nearest share of the rows, with tricube weights (no robustness turns).

    Rows are reduced to the distance of the last of these neighbours, and then to six sums, for each place.
    """
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    n = points.count()
    if not n:
        return df.sparkSession.createDataFrame([(float(a), None) for a in at], "at double, trend double")
    places = F.explode(F.array(*(F.lit(float(a)) for a in at)))
    near = points.withColumn("at", places).withColumn("d", F.abs(F.col("x") - F.col("at")))
    k = max(2, min(n, int(share * n + 1e-10)))
    width = group_quantiles(near, ["at"], "d", [(k - 1) / max(1, n - 1)]).select(F.col("at").alias("_at"), F.col("_q")[0].alias("h"))
    both = near.join(F.broadcast(width), F.col("at") == F.col("_at"))  # a row for each place
    w = F.when(F.col("h") > 0, F.pow(1 - F.pow(F.least(F.col("d") / F.col("h"), F.lit(1.0)), 3), 3)).otherwise((F.col("d") == 0).cast("double"))
    u = F.col("x") - F.col("at")
    sums = both.groupBy("at").agg(*(F.sum(v).alias(n) for n, v in {"w": w, "u": w * u, "uu": w * u * u, "v": w * F.col("y"), "uv": w * u * F.col("y")}.items()))
    spread = F.col("w") * F.col("uu") - F.col("u") * F.col("u")
    line = (F.col("uu") * F.col("v") - F.col("u") * F.col("uv")) / spread
    flat = F.col("v") / F.col("w")
    return sums.select("at", F.when(F.col("w") > 0, F.when(spread > 1e-12 * F.col("w") * F.col("uu"), line).otherwise(flat)).alias("trend"))


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with scaled_<c>: each column less its median, by its interquartile range; unknown values take the median, a range of 0 is 1."""
    for c in columns:
        low, middle, high = exact_quantiles(df, c, [0.25, 0.5, 0.75])
        spread = (high - low if low is not None else 0.0) or 1.0
        df = df.withColumn(f"scaled_{c}", (F.coalesce(F.col(c).cast("double"), F.lit(middle)) - F.lit(middle)) / F.lit(spread))
    return df

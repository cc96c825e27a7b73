"""Soil profiles: units, quality control, depth slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.functions.cleaning import in_range, range_flags

#: Standard depth slices (cm), conversion factors, plausible ranges.
SLICES = [(0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200)]
ORGANIC_MATTER, CACL2_SHIFT, PARTICLE_DENSITY = 1.724, 0.6, 2.65
BOUNDS = {"soc": (0.0, 800.0), "bulk_density": (0.05, 2.0), "coarse": (0.0, 100.0), "ph": (2.5, 11.0), "clay": (0.0, 100.0), "silt": (0.0, 100.0), "sand": (0.0, 100.0), "cec": (0.0, 200.0), "nitrogen": (0.0, 50.0), "upper": (0.0, 300.0), "lower": (0.0, 300.0)}
#: The columns of a horizon table.
HORIZON = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "profile_id", "horizon_id", "country", "observation_date")]
    + [T.StructField(c, T.DoubleType()) for c in ("lon", "lat", "upper", "lower", "soc", "bulk_density", "coarse", "ph", "clay", "silt", "sand", "cec", "nitrogen")]
    + [T.StructField(c, T.StringType()) for c in ("texture", "land_use", "method", "remarks")]
)


def soc_g_per_kg(value: Column, unit: Column) -> Column:
    """Organic carbon in g/kg from percent, organic matter percent, mg/kg or g/kg; null for an unknown unit."""
    return F.when(unit == "g_per_kg", value).when(unit == "pct", value * 10).when(unit == "som_pct", value * 10 / ORGANIC_MATTER).when(unit == "mg_per_kg", value / 1000)


def bulk_density(value: Column) -> Column:
    return in_range(value, *BOUNDS["bulk_density"])


def ph_in_water(value: Column, method: Column) -> Column:
    return F.when(method == "cacl2", value + CACL2_SHIFT).otherwise(value)


def coarse_volume(mass_pct: Column, density: Column) -> Column:
    """Coarse fragments by volume from percent by mass, of the fine earth's bulk density."""
    return mass_pct * density / PARTICLE_DENSITY


def carbon_stock(soc: Column, density: Column, upper: Column, lower: Column, coarse: Column) -> Column:
    """t/ha = g/kg * g/cm3 * cm * (1 - coarse / 100) * 0.1; unknown fragments count as 0, more than 99 as 99."""
    part = F.least(F.greatest(F.coalesce(coarse, F.lit(0.0)), F.lit(0.0)), F.lit(99.0))
    return soc * density * (lower - upper) * (1 - part / 100) * 0.1


def texture(df: DataFrame) -> DataFrame:
    """clay, silt and sand rescaled to a sum of 100 where that is positive, and texture_flag outside 95 to 105."""
    total = F.col("clay") + F.col("silt") + F.col("sand")
    off = F.when((total < 95) | (total > 105), "texture_sum")
    scaled = {c: F.when((F.col("_t") > 0) & (F.col("_t") != 100), F.col(c) * 100 / F.col("_t")).otherwise(F.col(c)) for c in ("clay", "silt", "sand")}
    return df.withColumn("_t", total).withColumns({**scaled, "texture_flag": off}).drop("_t")


def valid_horizons(df: DataFrame) -> DataFrame:
    """Rows with both bounds and lower below upper."""
    return df.where(F.col("upper").isNotNull() & F.col("lower").isNotNull() & (F.col("lower") > F.col("upper")))


def quality_control(df: DataFrame, drop: bool = False) -> DataFrame:
    """Values out of their bounds become null, with the flag range:column in qc_flags; flagged rows go if drop."""
    bounds = {c: b for c, b in BOUNDS.items() if c in df.columns}
    flagged = df.withColumn("qc_flags", range_flags(bounds))
    clean = flagged.withColumns({c: in_range(F.col(c), *b) for c, b in bounds.items()})
    return clean.where(F.size("qc_flags") == 0) if drop else clean


def slice_means(df: DataFrame, keys: list[str], value: str, slices: list[tuple[int, int]] = SLICES) -> DataFrame:
    """(keys, top, bottom, value, covered): means of horizons weighted by their overlap with each slice.

    The slices of a horizon follow from its own bounds, so nothing is joined.
    """
    grid = F.array(*(F.struct(F.lit(float(a)).alias("top"), F.lit(float(b)).alias("bottom")) for a, b in slices))
    parts = df.where(F.col(value).isNotNull()).withColumn("s", F.explode(F.filter(grid, lambda s: (s["top"] < F.col("lower")) & (F.col("upper") < s["bottom"]))))
    overlap = F.least("lower", "s.bottom") - F.greatest("upper", "s.top")
    g = parts.withColumn("w", overlap).groupBy(*keys, F.col("s.top").alias("top"), F.col("s.bottom").alias("bottom"))
    return g.agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value), F.sum("w").alias("covered"))


def fit_profile(upper: np.ndarray, lower: np.ndarray, values: np.ndarray, penalty: float = 0.1) -> tuple[np.ndarray, np.ndarray] | None:
    """Knots and one level for each interval between them, smoothed by second differences; None under two horizons.

    Each horizon's mean is the overlap-weighted mean of the levels; one more level past the last knot enters the
    penalty alone.
    """
    if len(values) < 2:
        return None
    knots = np.unique(np.concatenate([upper, lower]))
    shares = np.clip(np.minimum(knots[1:], lower[:, None]) - np.maximum(knots[:-1], upper[:, None]), 0, None) / (lower - upper)[:, None]
    design = np.hstack([shares, np.zeros((len(values), 1))])
    roughness = np.diff(np.eye(len(knots)), 2, axis=0)
    try:
        return knots, np.linalg.solve(design.T @ design + penalty * roughness.T @ roughness, design.T @ values)
    except np.linalg.LinAlgError:
        return None


def mean_over(knots: np.ndarray, levels: np.ndarray, top: float, bottom: float) -> float | None:
    weight = np.clip(np.minimum(knots[1:], bottom) - np.maximum(knots[:-1], top), 0, None)
    return float(weight @ levels[: len(weight)] / weight.sum()) if weight.sum() > 0 else None


def harmonise(df: DataFrame, key: str, value: str, slices: list[tuple[int, int]] = SLICES, penalty: float = 0.1) -> DataFrame:
    """(key, top, bottom, value): a penalised curve through each profile's horizons, averaged over the slices.

    A profile's horizons come together as an array (some dozens), so a task works on a stream of rows, not on groups.
    Profiles of one horizon, or without a solution, take weighted means.
    """
    kind = dict(df.dtypes)[key]
    rows = valid_horizons(df).where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("upper", "lower", F.col(value).alias("v")))).alias("h"))

    def fit(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for name, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, l, v = (np.array([x[c] for x in h]) for c in ("upper", "lower", "v"))
                made = fit_profile(u, l, v, penalty)
                for top, bottom in slices:
                    if made:
                        mean = mean_over(*made, top, bottom)
                    else:
                        w = np.clip(np.minimum(l, bottom) - np.maximum(u, top), 0, None)
                        mean = float(w @ v / w.sum()) if w.sum() > 0 else None
                    if mean is not None:
                        out.append((name, float(top), float(bottom), mean))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, batch.schema.field(0).type) for k, c in enumerate(zip(*out))], [key, "top", "bottom", value])

    return rows.mapInArrow(fit, f"{key} {kind}, top double, bottom double, {value} double")


def attach(df: DataFrame, lookup: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Left join of covariates on exact coordinates (and depth); the lookup has one row for each point."""
    return df.join(lookup.select(*on, *columns).dropDuplicates(on), on, "left")


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: rows, profiles, countries, flagged rows, and min, max, mean and deviation of value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("profile_id").alias("n_profiles"), F.count_distinct("country").alias("n_countries"), F.count_if(F.size("qc_flags") > 0).alias("n_flagged"),
        *(F.round(f(value), 4).alias(n) for n, f in (("lowest", F.min), ("highest", F.max), ("mean", F.avg), ("sd", F.stddev_samp))),
    )

"""Numeric transforms: decibels, stretches, weights, vectors, engineered features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest linear power, offset of gamma nought from squared numbers (dB).
LEAST_POWER, GAMMA_OFFSET = 1e-6, -83.0


def to_db(linear: Column) -> Column:
    return 10 * F.log10(F.greatest(linear, F.lit(LEAST_POWER)))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10)


def beta_nought(number: Column, gain: Column) -> Column:
    """DN^2 / LUT^2, null where the gain is 0."""
    return F.try_divide(number * number, gain * gain)


def gamma_nought(number: Column, mask: Column) -> Column:
    """10 log10(DN^2) - 83 where the mask is 1 and the number positive."""
    return F.when((mask == 1) & (number > 0), 10 * F.log10(number * number) + GAMMA_OFFSET)


def stretch(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds stretched: column from two quantiles to 0..1, clamped."""
    from loamwork.operators.stats import exact_quantiles

    a, b = (F.lit(x).cast("double") for x in exact_quantiles(df, column, [low, high]))
    return df.withColumn("stretched", F.least(F.greatest(F.try_divide(F.col(column) - a, b - a), F.lit(0.0)), F.lit(1.0)))


def coalition(models: DataFrame, error: str) -> DataFrame:
    """Adds weight: the models' inverse errors, normalised."""
    every = Window.partitionBy(F.lit(1))  # one row for each model
    return models.withColumn("weight", (1 / F.col(error)) / F.sum(1 / F.col(error)).over(every))


def weighted(predictions: dict[str, float]) -> Column:
    """Weighted mean of prediction columns."""
    total = sum(predictions.values())
    parts = [F.col(c) * (w / total) for c, w in predictions.items()]
    return sum(parts[1:], parts[0])


def ramp(value: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between."""
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def shrinkage_features(volume: Column, height: Column, width: Column, depth: Column, eps: float = 1e-9) -> dict[str, Column]:
    """Shape ratios of a body by its three extents."""
    box = height * width * depth
    return {
        "fill": volume / (box + eps), "flatness": F.least(height, width, depth) / (F.greatest(height, width, depth) + eps), "elongation": height / (width + eps),
        "roundness": F.cbrt(volume) / (F.greatest(height, width, depth) + eps), "surface_ratio": 2 * (height * width + width * depth + depth * height) / (volume + eps),
    }

"""Volumes from shapes in pictures: engineered features, shrinkage, a leaderboard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def engineered(df: DataFrame) -> DataFrame:
    """All features of kiln_major, kiln_minor, char_major, char_minor, distance (pixels), scale (pixels per mm), formula (volume).

    The formula's global minimum comes from one aggregate, sent as one row, so that its logarithm is defined.
    """
    c = F.col
    mm = df.join(F.broadcast(df.agg(F.min("formula").alias("_lo"))))
    mm = mm.withColumns({f"{n}_mm": c(n) / c("scale") for n in ("char_major", "char_minor", "kiln_major", "kiln_minor", "distance")})
    first = {
        "char_ratio": c("char_major_mm") / (c("char_minor_mm") + EPS), "kiln_ratio": c("kiln_major_mm") / (c("kiln_minor_mm") + EPS),
        "char_area": math.pi / 4 * c("char_major_mm") * c("char_minor_mm"), "kiln_area": math.pi / 4 * c("kiln_major_mm") * c("kiln_minor_mm"),
        "fill_major": c("char_major") / (c("kiln_major") + EPS), "fill_minor": c("char_minor") / (c("kiln_minor") + EPS),
        "spheroid": math.pi / 6 * c("char_major_mm") * F.pow("char_minor_mm", F.lit(2)), "distance_norm": c("distance_mm") / (c("kiln_major_mm") + EPS),
        "distance_sq": F.pow("distance_mm", F.lit(2)), "log_distance": F.log1p("distance"), "log_distance_mm": F.log1p("distance_mm"),
        "log_formula": F.log(c("formula") - c("_lo") + 1), "formula_sq": F.pow("formula", F.lit(2)),
    }
    second = {
        "area_ratio": c("char_area") / (c("kiln_area") + EPS), "log_distance_norm": F.log1p("distance_norm"), "sqrt_distance_norm": F.sqrt("distance_norm"), "spheroid_x_distance": c("spheroid") * c("distance_norm"),
        "fill_x_distance": c("fill_major") * c("distance_norm"), "fill_x_ratio": c("fill_minor") * c("char_ratio"), "formula_less_spheroid": c("formula") - c("spheroid"),
    }
    return mm.withColumns(first).withColumns(second).withColumn("area_x_distance", c("area_ratio") * c("distance_norm")).drop("_lo")


def shrinkage() -> dict[str, Column]:
    """Sphericities, and relative shrinkage along both axes and on average."""
    c = F.col
    lost = lambda a: (c(f"kiln_{a}") - c(f"char_{a}")) / (c(f"kiln_{a}") + EPS)
    return {
        "kiln_sphericity": c("kiln_major") / (c("kiln_minor") + EPS), "char_sphericity": c("char_major") / (c("char_minor") + EPS),
        "shrinkage_major": lost("major"), "shrinkage_minor": lost("minor"), "shrinkage_mean": (lost("major") + lost("minor")) / 2,
    }


def leaderboard(models: DataFrame, target: float, overfit: float = 0.65, underfit: float = 70.0) -> DataFrame:
    """(model, place, status, on_target) from train, test and cross-validated errors; one row for each model."""
    status = F.when(F.try_divide("train", "test") < overfit, "overfit").when(F.col("cv") > underfit, "underfit").otherwise("ok")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("test", "model")).cast("long")
    return models.select("model", place.alias("place"), status.alias("status"), (F.col("test") <= target).alias("on_target"))

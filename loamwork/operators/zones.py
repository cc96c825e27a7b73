"""Zones that blocks touch: lists, counts, labels, filters, codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import shared_label


def touching(df: DataFrame, columns: list[str]) -> DataFrame:
    """zones (array of the columns above 0, in order), n_zones, is_shared and label of every row."""
    zones = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in columns)))
    df = df.withColumn("zones", zones)
    return df.withColumns({"n_zones": F.size("zones"), "is_shared": F.size("zones") >= 2, "label": shared_label(F.col("zones"))})


def cascade(df: DataFrame, chosen: dict[str, list], zone: str | None = None) -> DataFrame:
    """Rows that pass each filter in turn (an empty one passes all); the zone may be any that a block touches, or Shared."""
    for column, values in chosen.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    if zone == "Shared":
        return df.where("n_zones >= 2")
    return df if zone is None else df.where(F.array_contains("zones", zone))


def codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): 0, 1, ... of the distinct values in order."""
    place = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(column)) - 1  # one row for each category
    return df.select(column).distinct().withColumn("code", place)

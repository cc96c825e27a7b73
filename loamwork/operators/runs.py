"""Runs and state machines: wetness cycles, islands of true, first confirmed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wetness(df: DataFrame, flat: float | None = 0.0) -> DataFrame:
    """Adds wi = 1 - 2 (v - min) / (max - min) per entity; a flat series gets ``flat`` (zero, or null with None)."""
    w = Window.partitionBy("entity_id")
    low, high = F.min("value").over(w), F.max("value").over(w)
    even = F.lit(flat).cast("double")
    return df.withColumn("wi", F.when(F.col("value").isNull(), F.lit(None)).when(high == low, even).otherwise(1 - 2 * (F.col("value") - low) / (high - low)))


def drying_cycles(df: DataFrame, wet: float = 0.3, dry: float = -0.1, reference: int = 5) -> DataFrame:
    """(entity_id, n_cycles, cycle_dates, likelihood): wet, then dry, then wet again, in a fold over the sorted series.

    cycle_dates holds (dry_date, wet_date) of each cycle; likelihood is n / reference, 1 at most. Null wi are skipped.
    """
    series = df.where(F.col("wi").isNotNull()).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("obs_date", "wi"))).alias("s"))
    empty = F.struct(F.lit("start").alias("state"), F.lit(None).cast("date").alias("dried"), F.array().cast("array<struct<dry_date:date,wet_date:date>>").alias("cycles"))

    def step(acc: Column, x: Column) -> Column:
        is_wet, is_dry = x["wi"] >= wet, x["wi"] <= dry
        closes = is_wet & (acc["state"] == "dry")
        starts = is_dry & (acc["state"] == "wet")
        return F.struct(
            F.when(is_wet, "wet").when(starts, "dry").otherwise(acc["state"]).alias("state"),
            F.when(starts, x["obs_date"]).otherwise(acc["dried"]).alias("dried"),
            F.when(closes, F.concat(acc["cycles"], F.array(F.struct(acc["dried"].alias("dry_date"), x["obs_date"].alias("wet_date"))))).otherwise(acc["cycles"]).alias("cycles"),
        )

    folded = series.select("entity_id", F.aggregate("s", empty, step)["cycles"].alias("cycle_dates"))
    n = F.size("cycle_dates")
    return folded.select("entity_id", n.cast("long").alias("n_cycles"), "cycle_dates", F.least(n / F.lit(float(reference)), F.lit(1.0)).alias("likelihood"))


def adjacent_cycles(df: DataFrame, wet: float = 0.3, dry: float = -0.1, reference: int = 5, chance: float = 0.4) -> DataFrame:
    """(entity_id, n_cycles, likelihood, ever_flooded, is_awd, continuous): dry at one observation and wet at the next."""
    after = F.lead("wi").over(Window.partitionBy("entity_id").orderBy("obs_date"))
    hit = df.withColumn("_hit", F.coalesce((F.col("wi") <= dry) & (after >= wet), F.lit(False)))
    per = hit.groupBy("entity_id").agg(F.count_if("_hit").alias("n_cycles"), F.coalesce(F.max("wi") >= wet, F.lit(False)).alias("ever_flooded"))
    likelihood = F.least(F.col("n_cycles") / F.lit(float(reference)), F.lit(1.0))
    per = per.withColumn("likelihood", likelihood).withColumn("is_awd", (likelihood >= chance) & F.col("ever_flooded"))
    return per.withColumn("continuous", F.col("ever_flooded") & ~F.col("is_awd"))


def longest_run(df: DataFrame, flag: Column) -> DataFrame:
    """(entity_id, longest): rows of the longest run of true in date order; entities without one have 0."""
    return _islands(df, flag).groupBy("entity_id").agg(F.max("len").alias("longest"))


def first_run(df: DataFrame, flag: Column, least: int) -> DataFrame:
    """(entity_id, run_start): start of the first run of at least ``least`` true rows, null if there is none."""
    return _islands(df, flag).groupBy("entity_id").agg(F.min(F.when(F.col("len") >= least, F.col("start"))).alias("run_start"))


def _islands(df: DataFrame, flag: Column) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("obs_date")
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy("entity_id", "_f").orderBy("obs_date")))
    runs = marked.groupBy("entity_id", "_f", "_g").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("start"))
    return runs.select("entity_id", F.when(F.col("_f"), F.col("n")).otherwise(0).alias("len"), F.when(F.col("_f"), F.col("start")).alias("start"))


def otsu(df: DataFrame, keys: list[str], value: str = "value", bins: int = 256) -> DataFrame:
    """(keys, threshold): the bin centre that makes the variance between the two sides largest, the first on ties."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.where(F.col(value).isNotNull()).join(ends, keys).where("hi > lo").withColumn("b", F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("long"))
    counted = placed.groupBy(*keys, "lo", "hi", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.col("lo") + (F.col("b") + 0.5) * width)
    up, all_rows = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    sums = counted.select(*keys, "b", "c", F.sum("n").over(up).alias("w1"), F.sum(F.col("n") * F.col("b")).over(up).alias("s1"), F.sum("n").over(all_rows).alias("w"), F.sum(F.col("n") * F.col("b")).over(all_rows).alias("s"))
    m1, m2 = F.col("s1") / F.col("w1"), F.try_divide(F.col("s") - F.col("s1"), F.col("w") - F.col("w1"))
    between = F.round(F.col("w1") * (F.col("w") - F.col("w1")) * F.pow(m1 - m2, 2) / F.pow(F.col("w"), 2), 6)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("v").desc_nulls_last(), "b"))
    return sums.withColumn("v", between).withColumn("_r", best).where("_r = 1").select(*keys, F.col("c").alias("threshold"))

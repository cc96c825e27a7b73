"""Phenology decisions: dates from curves, growing degrees, stages and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import series

#: Growth stages as half-open ranges of summed degrees, and stage pairs that count as agreeing.
STAGES = [("establishment", 0.0, 80.0), ("vegetative", 80.0, 520.0), ("panicle_initiation", 520.0, 640.0), ("reproductive", 640.0, 1063.0), ("ripening", 1063.0, 1176.0), ("maturity", 1176.0, 1650.0)]
ADJACENT = [("establishment", "vegetative"), ("vegetative", "establishment"), ("reproductive", "vegetative"), ("ripening", "reproductive"), ("maturity", "ripening")]


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGES, "name string, gdd_min double, gdd_max double")


def growing_degrees(t_min: Column, t_max: Column, base: float) -> Column:
    return F.greatest(F.lit(0.0), (t_min + t_max) / 2 - base)


def features(df: DataFrame) -> DataFrame:
    """baseline (20th percentile), amplitude, mean and n of each entity's values."""
    g = df.groupBy("entity_id").agg(F.percentile("value", F.lit(0.2)).alias("baseline"), F.max("value").alias("_hi"), F.avg("value").alias("mean"), F.count("value").alias("n"))
    return g.select("entity_id", "baseline", (F.col("_hi") - F.col("baseline")).alias("amplitude"), "mean", "n")


def in_peak_window(df: DataFrame, seasons: DataFrame, end: tuple[int, int]) -> DataFrame:
    """Rows between the season's start and the earlier of its end and the peak window's end (next year for winter seasons)."""
    cross = F.when(F.year("season_end") > F.year("season_start"), 1).otherwise(0)
    last = F.least(F.col("season_end"), F.make_date(F.year("season_start") + cross, F.lit(end[0]), F.lit(end[1])))
    return df.join(seasons, "entity_id").where(F.col("obs_date").between(F.col("season_start"), last))


def choose_greenup(candidates: DataFrame, peaks: DataFrame, start: Column, end: Column, days: int) -> DataFrame:
    """(entity_id, greenup_date): the first candidate in season and ``days`` before the peak, else in season, else the first."""
    both = candidates.join(peaks.select("entity_id", "peak_date"), "entity_id")
    inside = F.col("obs_date").between(start, end)
    early = inside & (F.datediff("peak_date", "obs_date") >= days)
    first = lambda when: F.min(F.when(when, F.col("obs_date")))
    return both.groupBy("entity_id").agg(F.coalesce(first(early), first(inside), F.min("obs_date")).alias("greenup_date"))


def estimate_greenup(df: DataFrame, absolute: float, gate: float, high: float, least: int = 4) -> DataFrame:
    """(entity_id, greenup_date, confidence): no date under ``least`` values or an amplitude below gate."""
    f = features(df).join(series.greenup(df, absolute), "entity_id", "left")
    low = (F.col("n") < least) | (F.col("amplitude") < gate)
    return f.select("entity_id", F.when(~low, F.col("greenup_date")).alias("greenup_date"), F.when(low, "low").when(F.col("amplitude") < high, "medium").otherwise("high").alias("confidence"))


def fuse_dates(a: Column, a_confidence: Column, b: Column, b_confidence: Column, within: int = 14, fused: float = 0.85) -> list[Column]:
    """event_date and confidence of two estimates: the earlier date if they are close, else the surer one (b on ties)."""
    near = F.abs(F.datediff(a, b)) <= within
    date = F.when(a.isNull(), b).when(b.isNull(), a).when(near, F.least(a, b)).when(a_confidence > b_confidence, a).otherwise(b)
    sure = F.when(a.isNull() & b.isNull(), None).when(a.isNull(), b_confidence).when(b.isNull(), a_confidence).when(near, F.lit(fused)).otherwise(F.greatest(a_confidence, b_confidence))
    return [date.alias("event_date"), sure.alias("confidence")]


def resolve_date(given: Column, estimated: Column, mismatch_days: int, nursery: int) -> list[Column]:
    """event_date (the given one first), sowing_date before it, provided, and mismatch beyond the allowed days."""
    date = F.coalesce(given, estimated)
    off = F.coalesce(F.abs(F.datediff(given, estimated)) > mismatch_days, F.lit(False))
    return [date.alias("event_date"), F.date_sub(date, nursery).alias("sowing_date"), given.isNotNull().alias("provided"), off.alias("mismatch")]


def classify_stage(df: DataFrame, gdd: Column) -> DataFrame:
    """Adds stage and margin to the nearest bound; above all ranges the last stage, below the first."""
    stage, margin = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, (name, low, high) in reversed(list(enumerate(STAGES))):
        holds = (gdd < high) if k == 0 else (gdd >= low) if k == len(STAGES) - 1 else (gdd >= low) & (gdd < high)
        stage = F.when(holds, F.lit(name)).otherwise(stage)
        margin = F.when(holds, F.least(F.abs(gdd - low), F.abs(high - gdd))).otherwise(margin)
    return df.withColumns({"stage": stage, "margin": margin})


def stage_hint(days: Column, value: Column, level: float) -> Column:
    """Stage by days after transplanting and the curve's level, in this order."""
    return F.when(days < 15, "establishment").when((days < 55) & (value.isNull() | (value < level)), "vegetative").when((days < 85) & (value >= level), "reproductive").when(days < 120, "ripening").otherwise("maturity")


#: Weights of margin, agreement and data, degrees of a full margin, the worth of a disagreement, and the bounds.
CONFIDENCE_WEIGHTS, FULL_MARGIN, DISAGREEMENT, CONFIDENCE_BOUNDS = (0.55, 0.25, 0.20), 80, 0.45, (0.2, 0.98)


def stage_confidence(stage: Column, hint: Column, margin: Column, data: Column) -> tuple[Column, Column]:
    """Whether stage and hint agree, and a confidence from margin, agreement and data quality, within 0.2 and 0.98."""
    agrees = stage == hint
    for a, b in ADJACENT:
        agrees = agrees | ((stage == a) & (hint == b))
    by_margin, by_agreement, by_data = CONFIDENCE_WEIGHTS
    score = by_margin * F.least(F.lit(1.0), margin / FULL_MARGIN) + by_agreement * F.when(agrees, 1.0).otherwise(DISAGREEMENT) + by_data * data
    low, high = CONFIDENCE_BOUNDS
    return agrees, F.least(F.greatest(score, F.lit(low)), F.lit(high))


def stage_branches(no_gdd: Column, before: Column, trusted: Column) -> tuple[Column, Column, Column]:
    """stage, confidence and gdd: the hint without degrees, pre_transplant before the date, else the full rule. Needs columns stage, hint, margin, total."""
    _, full = stage_confidence(F.col("stage"), F.col("hint"), F.col("margin"), F.lit(0.7))
    stage = F.when(no_gdd, F.col("hint")).when(before, "pre_transplant").otherwise(F.col("stage"))
    confidence = F.when(no_gdd, 0.6).when(before, F.when(trusted, 0.8).otherwise(0.65)).otherwise(full)
    return stage, confidence, F.when(no_gdd, None).when(before, 0.0).otherwise(F.col("total"))

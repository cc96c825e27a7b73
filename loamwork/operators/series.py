"""Ordered operators over observations(entity_id, obs_date, value): one exchange by entity serves a chain of them.

Positions are row numbers in date order; dates are unique within an entity. Nulls are missing observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS, ORDER = ["entity_id"], "obs_date"


def _w(keys=None, order=ORDER):
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def whole(keys=None):
    return Window.partitionBy(*(keys or KEYS))


def rolling_median(value: Column, radius: int = 2) -> Column:
    """Median of up to 2 * radius + 1 centred rows, of one at least."""
    return F.percentile(value, F.lit(0.5)).over(_w().rowsBetween(-radius, radius))


def despike(df: DataFrame, floor: float = 0.22, factor: float = 4.0, radius: int = 2) -> DataFrame:
    """Adds value_clean: null where the distance to the rolling median exceeds max(floor, factor * rolling median of distances)."""
    df = df.withColumn("_off", F.abs(F.col("value") - rolling_median(F.col("value"), radius)))
    spike = F.col("_off") > F.greatest(F.lit(floor), factor * rolling_median(F.col("_off"), radius))
    return df.withColumn("value_clean", F.when(~F.coalesce(spike, F.lit(False)), F.col("value"))).drop("_off")


def valid_range(value: Column, low: float, high: float, cap: float | None = None) -> Column:
    """Null outside [low, high]; then raised to cap if given."""
    inside = F.when(value.between(low, high), value)
    return inside if cap is None else F.when(inside.isNotNull(), F.greatest(inside, F.lit(cap)))


def interpolate(df: DataFrame, column: str = "value", name: str = "filled") -> DataFrame:
    """Linear by position between known neighbours; the ends take the nearest known value; all-null series stay null."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("v")))
    df = df.withColumn("_pos", F.row_number().over(_w()))
    before = F.last(known, ignorenulls=True).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(_w().rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_a": before, "_b": after})
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_pos") - a["p"]) / (b["p"] - a["p"])
    filled = F.when(F.col(column).isNotNull(), F.col(column)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)
    return df.withColumn(name, filled).drop("_pos", "_a", "_b")


def fill_median(column: Column) -> Column:
    return F.coalesce(column, F.percentile(column, F.lit(0.5)).over(whole()))


#: Least-squares quadratic smoothing weights, and their divisors, for 5 and 7 points.
STENCILS = {5: ([-3, 12, 17, 12, -3], 35), 7: ([-2, 3, 6, 7, 6, 3, -2], 21)}


def savgol(column: Column) -> Column:
    """Quadratic smoothing over 7 rows (5 where the series has 5 or 6, none below), the edge rows repeated outwards."""
    n = F.count(F.lit(1)).over(whole())
    first, last = (f(column).over(_w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))

    def at(k: int) -> Column:
        return column if k == 0 else F.coalesce(F.lag(column, -k).over(_w()), first) if k < 0 else F.coalesce(F.lead(column, k).over(_w()), last)

    def smooth(width: int) -> Column:
        weights, divisor = STENCILS[width]
        terms = [w * at(k - width // 2) for k, w in enumerate(weights)]
        return sum(terms[1:], terms[0]) / divisor

    return F.when(n >= 7, smooth(7)).when(n >= 5, smooth(5)).otherwise(column)


def gradient(value: Column, day: Column) -> Column:
    """Slope per day: second order for uneven spacing inside, one-sided at the ends; null for single rows."""
    w = _w()
    v0, v2, d0, d2 = F.lag(value).over(w), F.lead(value).over(w), F.lag(day).over(w), F.lead(day).over(w)
    h, k = day - d0, d2 - day
    inner = (h * h * v2 + (k * k - h * h) * value - k * k * v0) / (h * k * (h + k))
    return F.when(d0.isNull(), (v2 - value) / k).when(d2.isNull(), (value - v0) / h).otherwise(inner)


def trapezoid(df: DataFrame, column: str = "value") -> DataFrame:
    """(entity_id, integral): area under the curve over days."""
    w = _w()
    strip = F.datediff(F.lead(ORDER).over(w), F.col(ORDER)) * (F.col(column) + F.lead(column).over(w)) / 2
    return df.withColumn("_s", strip).groupBy(*KEYS).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("integral"))


def merge_sensors(a: DataFrame, b: DataFrame) -> DataFrame:
    """One curve from two, on the union of dates: a's value where there is one, else b's, gaps filled; tag says which."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), [*KEYS, ORDER], "full_outer")
    both = both.withColumn("merged", F.coalesce("a", "b")).withColumn("tag", F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("missing"))
    return interpolate(both, "merged", "filled")


def running_total(df: DataFrame, amount: Column, start: Column | None = None, name: str = "total") -> DataFrame:
    """Adds the sum of amount from the start date (inclusive) on, in date order."""
    counted = amount if start is None else F.when(F.col(ORDER) >= start, amount).otherwise(0.0)
    return df.withColumn(name, F.sum(counted).over(_w().rowsBetween(Window.unboundedPreceding, 0)))


def reach_target(df: DataFrame, target: float, amount: str = "amount", total: str = "total", recent: int = 14) -> DataFrame:
    """(entity_id, reached): when total reaches target.

    With no row below target, or with a recent mean of no growth, the last date; else the last date plus
    ceil(gap / mean amount of the last ``recent`` rows) days, the last date at most.
    """
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col(ORDER).desc()))
    last = df.withColumn("_r", rank).groupBy(*KEYS).agg(
        F.max(ORDER).alias("last"), F.max(F.when(F.col("_r") == 1, F.col(total))).alias("at"), F.avg(F.when(F.col("_r") <= recent, F.col(amount))).alias("mean"), F.count_if(F.col(total) < target).alias("below"),
    )
    days = F.ceil((target - F.col("at")) / F.col("mean")).cast("int")
    return last.select(*KEYS, F.when((F.col("below") == 0) | (F.col("mean") <= 0), F.col("last")).otherwise(F.least(F.date_add("last", days), F.col("last"))).alias("reached"))


def season_year(df: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(entity_id, season_start, season_end, n_obs): of the candidate years the one with most observations, the first on ties.

    A season whose end comes before its start in the calendar runs into the next year.
    """
    years = df.groupBy(*KEYS).agg(F.min(F.year(ORDER)).alias("lo"), F.max(F.year(ORDER)).alias("hi"))
    years = years.withColumn("y", F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)))
    cross = int(end < start)
    seasons = years.select(*KEYS, "y", F.make_date("y", F.lit(start[0]), F.lit(start[1])).alias("season_start"), F.make_date(F.col("y") + cross, F.lit(end[0]), F.lit(end[1])).alias("season_end"))
    counted = seasons.join(df.select(*KEYS, ORDER), KEYS).groupBy(*KEYS, "y", "season_start", "season_end").agg(F.count_if(F.col(ORDER).between(F.col("season_start"), F.col("season_end"))).alias("n_obs"))
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("n_obs").desc(), "y"))
    return counted.withColumn("_r", best).where("_r = 1").select(*KEYS, "season_start", "season_end", "n_obs")


def pick_peak(df: DataFrame, dip: float) -> DataFrame:
    """(entity_id, peak_date, peak_value, method) of rows in the search window.

    The first highest value counts if an earlier value lies below dip; else the first highest local peak with a dip
    before it; else the first local peak after the start; else the highest anyway.
    """
    w = _w()
    low = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1)) < dip
    local = (F.col("value") > F.lag("value").over(w)) & (F.col("value") >= F.lead("value").over(w))
    rows = df.where(F.col("value").isNotNull()).select(*KEYS, ORDER, "value", F.coalesce(low, F.lit(False)).alias("low"), F.coalesce(local, F.lit(False)).alias("local"))
    at = lambda when, *first: F.min(F.when(when, F.struct(*first, F.col(ORDER).alias("d"), F.col("value").alias("v"), F.col("low").alias("low"))))
    down = (-F.col("value")).alias("k")
    found = rows.groupBy(*KEYS).agg(at(F.lit(True), down).alias("top"), at(F.col("local") & F.col("low"), down).alias("dipped"), at(F.col("local")).alias("any"))
    method = F.when(F.col("top.low"), "global").when(F.col("dipped").isNotNull(), "local_after_dip").when(F.col("any").isNotNull(), "first_local").otherwise("global_without_dip")
    pick = lambda f: F.when(F.col("top.low"), F.col(f"top.{f}")).when(F.col("dipped").isNotNull(), F.col(f"dipped.{f}")).when(F.col("any").isNotNull(), F.col(f"any.{f}")).otherwise(F.col(f"top.{f}"))
    return found.select(*KEYS, pick("d").alias("peak_date"), pick("v").alias("peak_value"), method.alias("method"))


def greenup(df: DataFrame, absolute: float, share: float = 0.25) -> DataFrame:
    """(entity_id, greenup_date): first value from the lowest one on that reaches ``absolute``, else lowest + share * range."""
    low = df.groupBy(*KEYS).agg(F.min(F.struct("value", ORDER)).alias("low"), F.max("value").alias("high"))
    later = df.join(low, KEYS).where(F.col(ORDER) >= F.col("low")[ORDER])
    part = F.col("low.value") + share * (F.col("high") - F.col("low.value"))
    found = later.groupBy(*KEYS).agg(F.min(F.when(F.col("value") >= absolute, F.col(ORDER))).alias("a"), F.min(F.when(F.col("value") >= part, F.col(ORDER))).alias("b"))
    return found.select(*KEYS, F.coalesce("a", "b").alias("greenup_date"))


def first_minimum(df: DataFrame, days: int, least: int = 3) -> DataFrame:
    """(entity_id, min_date, min_value): the first lowest value of the first ``days`` days; null under ``least`` values."""
    start = F.min(ORDER).over(whole())
    early = df.withColumn("_s", start).where((F.datediff(ORDER, "_s") <= days) & F.col("value").isNotNull())
    found = early.groupBy(*KEYS).agg(F.min(F.struct("value", ORDER)).alias("m"), F.count(F.lit(1)).alias("n"))
    ok = F.col("n") >= least
    return found.select(*KEYS, F.when(ok, F.col("m")[ORDER]).alias("min_date"), F.when(ok, F.col("m.value")).alias("min_value"))

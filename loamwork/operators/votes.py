"""Detector votes: tallies, decisions, replays, roll-ups, sweeps.

A vote is a struct(detector, available, label, importance, issues, confidence); votes of a page are an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order in which labels win ties and issues name a page.
TIES = ["document", "blur", "cut", "accepted"]
ISSUES = [("not_document", "document"), ("blurry", "blur"), ("cut_off", "cut"), ("not_clear", "cut")]


def tallies(votes: DataFrame, page: list[str]) -> DataFrame:
    """(page, label, n, weight) of available votes; weight is the sum of importance, rounded to 4 places."""
    each = votes.select(*page, F.explode("votes").alias("v")).where("v.available")
    return each.groupBy(*page, F.col("v.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v.importance"), 4).alias("weight"))


def winner(tally: DataFrame, page: list[str]) -> DataFrame:
    """(page, winner): the label of the largest weight, by the fixed order on ties."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, TIES)), F.col("label")), F.lit(99))
    best = tally.groupBy(*page).agg(F.min(F.struct((-F.col("weight")).alias("w"), place.alias("p"), F.col("label").alias("l"))).alias("b"))
    return best.select(*page, F.col("b.l").alias("winner"))


def decision(votes: Column, least_confidence: Column | float) -> dict[str, Column]:
    """accepted, reason and issues of a page: any available vote with an issue and enough confidence rejects it."""
    strong = F.filter(votes, lambda v: v["available"] & (F.size(v["issues"]) > 0) & (v["confidence"] >= least_confidence))
    issues = F.array_sort(F.array_distinct(F.flatten(F.transform(strong, lambda v: v["issues"]))))
    usable = F.exists(votes, lambda v: v["available"])
    return {"accepted": usable & (F.size(strong) == 0), "n_strong": F.size(strong), "issues": issues, "label": F.when(~usable, "error").otherwise(issue_label(issues))}


def issue_label(issues: Column) -> Column:
    """The label of the first issue in the fixed order; accepted without any."""
    label = F.lit("accepted")
    for issue, name in reversed(ISSUES):
        label = F.when(F.array_contains(issues, issue), name).otherwise(label)
    return label


def replay(votes: DataFrame, thresholds: DataFrame, page: list[str]) -> DataFrame:
    """Decisions of stored votes under each row of thresholds(threshold): a handful, sent to all tasks."""
    both = votes.join(F.broadcast(thresholds))
    d = decision(F.col("votes"), F.col("threshold"))
    return both.select(*page, "threshold", *(c.alias(n) for n, c in d.items()))


def file_verdict(pages: DataFrame, file: list[str]) -> DataFrame:
    """(file, accepted, issues): all pages accepted, and the sorted union of their issues."""
    issues = F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues"))))
    return pages.groupBy(*file).agg(F.bool_and("accepted").alias("accepted"), issues.alias("issues"))


def wide(votes: DataFrame, page: list[str], detectors: list[str]) -> DataFrame:
    """<detector>_label and <detector>_confidence columns for a fixed list of detectors."""
    each = votes.select(*page, F.explode("votes").alias("v")).select(*page, F.col("v.detector").alias("detector"), F.col("v.label").alias("label"), F.col("v.confidence").alias("confidence"))
    return each.groupBy(*page).pivot("detector", detectors).agg(F.first("label").alias("label"), F.first("confidence").alias("confidence"))


def sweep(df: DataFrame, truth: Column, score: str, thresholds: list) -> DataFrame:
    """(threshold, f1, best) of saying yes above each threshold; one pass over the rows, no row is repeated."""
    said = lambda t: F.col(score) > t
    one = df.agg(F.count_if(truth).alias("s"), *(F.struct(F.count_if(truth & said(t)).alias("tp"), F.count_if(said(t)).alias("n")).alias(f"_{k}") for k, t in enumerate(thresholds)))
    rows = one.select("s", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"_{k}.tp").alias("tp"), F.col(f"_{k}.n").alias("n")) for k, t in enumerate(thresholds)))).alias("x")).select("s", "x.*")
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("s") + F.col("n")), F.lit(0.0)), 6)
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("f1").desc(), "threshold")) == 1
    return rows.select("threshold", f1.alias("f1")).withColumn("best", best)

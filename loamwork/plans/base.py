"""Inputs shared by the registered queries: the driver's tables in the library's canonical shapes, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations: entity_id, obs_date, value (mean of cents, so that every engine gets the same double), v_min, v_max, n."""
    cents = F.round(F.col("value") * 100).cast("long")
    grouped = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date"))
    return grouped.agg((F.sum(cents) / (F.count(F.lit(1)) * F.lit(100.0))).alias("value"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.count(F.lit(1)).alias("n"))


DAILY = """daily AS (
  SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100.0 AS DOUBLE)) AS value,
         min(value) AS v_min, max(value) AS v_max, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily with a gap wherever day and entity sum to a multiple of 5."""
    gap = (F.dayofmonth("obs_date") + F.col("entity_id")) % 5 == 0
    return daily(spark, sf_dir).select("entity_id", "obs_date", F.when(~gap, F.col("value")).alias("value"))


GAPPY = DAILY + """, gappy AS (
  SELECT entity_id, obs_date, CASE WHEN (day(obs_date) + entity_id) % 5 <> 0 THEN value END AS value FROM daily)"""

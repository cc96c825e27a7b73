"""Sinks: tables in two formats, series by entity, single documents, checkpoints, audits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of TIFF files, both byte orders.
TIFF = [b"II*\x00", b"MM\x00*"]


def _flat(df: DataFrame) -> DataFrame:
    """df with arrays, structs and maps as JSON text."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def export(df: DataFrame, folder: str) -> None:
    """Parquet and CSV of the same rows; arrays and structs are JSON in the CSV."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    _flat(df).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read back: later steps start from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entity_series(results: DataFrame, series: DataFrame, folder: str, key: str = "entity_id") -> None:
    """Results as JSON lines, and series as CSV in a folder for each entity."""
    results.write.mode("overwrite").json(f"{folder}/results")
    series.write.mode("overwrite").partitionBy(key).option("header", True).csv(f"{folder}/series")


def one_row(df: DataFrame, folder: str) -> dict:
    """A one-row table as JSON and CSV, one file each; the row is returned."""
    one = df.limit(2).coalesce(1)
    rows = one.collect()
    if len(rows) != 1:
        raise ValueError("a single row is needed")
    one.write.mode("overwrite").json(f"{folder}/json")
    _flat(one).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    return rows[0].asDict()


def is_tiff(content: Column) -> Column:
    """Whether bytes start as a TIFF file does."""
    return F.substring(content, 1, 4).isin(*(F.lit(bytearray(m)) for m in TIFF))


def json_rows(df: DataFrame, mode: str = "lines", nested: str = "pages") -> DataFrame:
    """JSON text of the rows: lines (one each), decisions (one for each element of the nested array), or array (of each row's elements)."""
    if mode == "lines":
        return df.select(F.to_json(F.struct("*")).alias("value"))
    if mode == "decisions":
        rest = [c for c in df.columns if c != nested]
        return df.select(*rest, F.explode(nested).alias("_p")).select(*rest, "_p.*").select(F.to_json(F.struct("*")).alias("value"))
    return df.select(F.to_json(F.col(nested)).alias("value"))


def audit_document(items: DataFrame, page: list[str], warnings: Column | None = None) -> DataFrame:
    """(page, audit): items of a page as one JSON document with n_items, reliable and warnings."""
    warn = F.array().cast("array<string>") if warnings is None else warnings
    each = items.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("start", "label", "score", "box"))).alias("items"))
    return each.select(*page, F.to_json(F.struct("items", F.size("items").alias("n_items"), warn.alias("warnings"), (F.size(warn) == 0).alias("reliable"))).alias("audit"))


def save_model(model, path: str, card: dict) -> None:
    """A fitted pipeline and, beside it, its card as JSON."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(card, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load_model(path: str) -> tuple:
    """(fitted pipeline, card) as ``save_model`` left them."""
    from pyspark.ml import PipelineModel

    card = SparkSession.getActiveSession().read.text(f"{path}/card").first()
    return PipelineModel.load(f"{path}/model"), json.loads(card[0])

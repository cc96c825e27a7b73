"""The corpus pipeline: quality classifier, line dedup, near copies, secret scans, packing.

Each stage is a function (spark, docs, sf_dir) of all that the stage before it kept; run() writes each stage's rows as
Parquet in the shared folder and reads them again. All stages but the last return the columns of documents. Where
text changes, n_chars follows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.jaccard import one_of_each
from loamwork.llm.linededup import dedup_lines
from loamwork.llm.nbsvm import classify
from loamwork.llm.q10_packing import pack_documents
from loamwork.llm.secrets import redact
from loamwork.llm.shared import collect_garbage, drop_since, mark, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the text's code points."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _own(docs: DataFrame) -> list[str]:
    """Names for the columns of docs that clash with no other, whatever theirs are."""
    return [f"_c{k}" for k in range(len(docs.columns))]


def _rested(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, begun with the heap given back that the stage before it grew."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


@_rested
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    names = _own(docs)
    found = classify(docs, table(spark, sf_dir, "labels")).toDF(*names, "held_out", "score", "predicted")
    return found.where("predicted = 1").select(*names).toDF(*docs.columns)


@_rested
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents hold, except in the last of them; every document stays."""
    names = _own(docs)
    return _counted(dedup_lines(docs).toDF(*names, "n_lines", "n_dropped").select(*names).toDF(*docs.columns))


@_rested
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group linked at 0.8 of five-word shingles."""
    return one_of_each(docs, width=5, num=8, den=10)


@_rested
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return _counted(redact(docs))


@_rested
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_copies), ("secret scans", secret_scan), ("packing", packing)]

#: A classifier, a forest and a tokenizer are not expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's scratch tables, and its input, go when its rows have been written."""
    docs = table(spark, sf_dir, "documents")
    place = mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, place, docs)
    return docs

"""Detectors as plug-ins: one protocol, loaded once a worker, whose failures are unavailable votes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOTE = T.StructType([
    T.StructField("detector", T.StringType()), T.StructField("available", T.BooleanType()), T.StructField("label", T.StringType()), T.StructField("importance", T.DoubleType()),
    T.StructField("issues", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType()),
])


class Detector(Protocol):
    def detect(self, page: dict) -> dict:
        """label, issues and confidence of one page (a row as a dict)."""


#: Factories by name; a factory is called once in each worker process, at its first page.
FACTORIES: dict[str, Callable[[], Detector]] = {}


def available(names: list[str], probe: Callable[[str], bool], default: str) -> tuple[list[str], list[str]]:
    """(names that answer the probe, warnings about the rest); the default alone if none does."""
    good = [n for n in names if probe(n)]
    return good or [default], [f"{n} is not available" for n in names if n not in good]


def vote(pages: DataFrame, factories: dict[str, Callable[[], Detector]], importance: dict[str, float] | None = None) -> DataFrame:
    """pages with votes: an array with one vote of each detector. A detector that fails on a page, or to load, is unavailable there."""
    weights = importance or {}
    schema = T.StructType([*pages.schema.fields, T.StructField("votes", T.ArrayType(VOTE))])

    def run(batches):
        import pyarrow as pa

        loaded: dict = {}
        for batch in batches:
            votes = []
            for row in batch.to_pylist():
                mine = []
                for name, factory in factories.items():
                    base = {"detector": name, "importance": float(weights.get(name, 1.0)), "available": False, "label": None, "issues": [], "confidence": None, "error": None}
                    try:
                        if name not in loaded:
                            loaded[name] = factory()
                        said = loaded[name].detect(row)
                        base |= {"available": True, "label": said["label"], "issues": list(said.get("issues", [])), "confidence": float(said.get("confidence", 1.0))}
                    except Exception as e:  # the plug-in's own failure
                        base["error"] = f"{type(e).__name__}: {e}"
                    mine.append(base)
                votes.append(mine)
            kind = pa.list_(pa.struct([("detector", pa.string()), ("available", pa.bool_()), ("label", pa.string()), ("importance", pa.float64()), ("issues", pa.list_(pa.string())), ("confidence", pa.float64()), ("error", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, kind)], [*batch.schema.names, "votes"])

    return pages.mapInArrow(run, schema)


def per_entity(df: DataFrame, function: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    """One result row for each row; where function fails, its fields are null and error says why."""
    out = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    got = function(row)
                    rows.append([*(got.get(n) for n in names), None])
                except Exception as e:  # one entity's failure is its own row
                    rows.append([*(None for _ in names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return df.mapInPandas(run, out)

"""Land cover: label harmonisation, embeddings, source agreement, outliers, verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.operators.stats import group_quantiles, mode

#: Classes 0 to 6, and the native labels of three public land-cover products.
CLASSES = ["water", "trees", "grass", "crops", "shrub", "built", "bare"]
#: Rows up to which a vocabulary of labels is broadcast, after counting it.
VOCABULARY = 10_000


def map_labels(df: DataFrame, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """Adds class_id from mapping(source, native, class_id); an unmapped label is null, an unknown source an error if strict."""
    few = mapping.limit(VOCABULARY + 1).count() <= VOCABULARY
    joined = df.join(F.broadcast(mapping) if few else mapping, ["source", "native"], "left")
    if not strict:
        return joined
    known = F.array(*(F.lit(r.source) for r in mapping.select("source").distinct().collect()))
    check = F.when(F.array_contains(known, F.col("source")), F.col("class_id")).otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.col("source"))).cast("int"))
    return joined.withColumn("class_id", check)


def dequantise(values: Column) -> Column:
    """Array of (v / 127.5)^2 with v's sign, from signed bytes."""
    return F.transform(values, lambda v: F.signum(v.cast("double")) * F.pow(v.cast("double") / 127.5, 2))


def agreeing(df: DataFrame, cell: list[str], source: str, label: str) -> DataFrame:
    """Rows of cells with one source, or whose sources give one class."""
    per = df.groupBy(*cell).agg(F.count_distinct(source).alias("_s"), F.count_distinct(label).alias("_c"))
    return df.join(per, cell).where("_s = 1 or _c = 1").drop("_s", "_c")


def verdict(pixels: DataFrame, keys: list[str], fraction: float = 0.30, confidence: float = 0.50) -> DataFrame:
    """fraction of planted pixels, confidence (mean p of planted pixels times the fraction), and whether both exceed their bounds."""
    g = pixels.groupBy(*keys).agg((F.count_if("planted") / F.count(F.lit(1))).alias("fraction"), F.avg(F.when(F.col("planted"), F.col("p"))).alias("_m"))
    conf = F.coalesce(F.col("_m") * F.col("fraction"), F.lit(0.0))
    return g.select(*keys, "fraction", conf.alias("confidence"), ((F.col("fraction") > fraction) & (conf > confidence)).alias("is_plantation"))


def mahalanobis_filter(df: DataFrame, label: str, vector: str, factor: float = 3.0, least: int = 10) -> DataFrame:
    """Rows whose distance from their class's mean is under factor times the class's median distance; small classes pass.

    Means and covariances are sums, gathered by class from partial sums of each task; the driver gets one matrix a
    class, and distances are taken in one more pass.
    """
    schema = f"{label} string, sums array<double>"

    def moments(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            v = np.array(batch.column(1).to_pylist(), float)
            for name in set(names):
                x = v[[k for k, n in enumerate(names) if n == name]]
                s = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                held[name] = held[name] + s if name in held else s
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h.tolist() for h in held.values()], pa.list_(pa.float64()))], [label, "sums"])

    parts = df.select(F.col(label).cast("string"), F.col(vector).cast("array<double>")).mapInArrow(moments, schema)
    models = {}
    sums: dict = {}
    for r in parts.toLocalIterator():  # one row for each class and task
        s = np.array(r.sums)
        sums[r[0]] = sums[r[0]] + s if r[0] in sums else s
    for name, s in sums.items():
        p = int((-1 + (1 + 4 * (len(s) - 1)) ** 0.5) / 2)
        mean = s[1 : p + 1] / s[0]
        cov = s[p + 1 :].reshape(p, p) / s[0] - np.outer(mean, mean)
        models[name] = (int(s[0]), mean, np.linalg.pinv((cov + cov.T) / 2))
    out_schema = T.StructType([*df.schema.fields, T.StructField("_d", T.DoubleType())])

    def distances(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(vector)
            names = np.array([str(x) if x is not None else None for x in batch.column(batch.schema.get_field_index(label)).to_pylist()], object)
            vectors, d = batch.column(at).to_pylist(), np.zeros(batch.num_rows)
            for name in set(names):
                n, mean, inv = models[name]
                mine = np.flatnonzero([x == name for x in names])
                if n >= least:
                    off = np.array([vectors[k] for k in mine], float) - mean
                    d[mine] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", off, inv, off), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, "_d"])

    found = df.mapInArrow(distances, out_schema)
    sizes = found.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    middle = group_quantiles(found, [label], "_d", [0.5]).join(sizes, label).select(label, F.col("_q")[0].alias("_m"), "_n")  # a row for each class of models
    return found.join(F.broadcast(middle), label).where((F.col("_n") < least) | (F.col("_d") < factor * F.col("_m"))).drop("_d", "_m", "_n")


def composite(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return mode(df, keys, label)


def share_of_class(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Map of class to its share for each key; classes that don't occur are left out."""
    n = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("f", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))
    return share.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), "f")))).alias("fractions"))

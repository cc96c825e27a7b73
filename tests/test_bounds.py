"""Values that lie on a decision's bound, against the SQL."""

from random import SystemRandom

from oracle import compare
from pyspark.sql import functions as F

from loamwork.operators import stats
from loamwork.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_pages_at_the_bound_of_content(spark, tmp_path):
    """Confidences that round to 0.4125, and those next to it."""
    places = [(5666451, 0.02, 0.04), (6887880, 0.02, 0.05), (7529583, 0.03, 0.02), (8109308, 0.02, 0.06), (8751012, 0.03, 0.03)]
    rows = [(cents, k, 1, 5.0, cents / 100, discount, tax) for k, (first, discount, tax) in enumerate(places) for cents in range(first - 8, first + 14)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    frame.toPandas().to_parquet(f"{tmp_path}/lineitem.parquet")
    assert compare(spark, QUERIES["document_page"], SQL["document_page"], str(tmp_path)) == []
    at = QUERIES["document_page"](spark, str(tmp_path)).where("confidence = 0.4125")
    assert at.count() == 28 and at.where("is_document").count() == 28


def test_group_quantiles_do_not_depend_on_how_often_sketches_are_made(spark, monkeypatch):
    """A sketch that comes out otherwise each time it is made, as on a cluster, where its parts arrive in any order."""
    monkeypatch.setattr(stats, "ONE_TASK", 1_000)
    monkeypatch.setattr(stats, "ROUND", 10)
    sketch = F.percentile_approx
    moved = F.udf(lambda q: [x + SystemRandom().uniform(-300, 300) for x in q], "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(sketch(*a)))
    frame = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).cast("double").alias("v"))
    got = {r["k"]: list(r["_q"]) for r in stats.group_quantiles(frame, ["k"], "v", [0.25, 0.75]).collect()}
    assert got == {k: [2499.75, 7499.25] for k in (0, 1)}

"""Models, rasters and redaction. KRN-01, 02, 07..13, 15, 18; STR-10..13, 17, 18; SRC-26, 27."""

from pyspark.sql import functions as F

from loamwork.operators import documents, models, raster
from loamwork.plans.base import table
from loamwork.plans.registry import query

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, "l_extendedprice")


_MI = "x AS (SELECT least(floor((l_quantity - 1) / (49 / 16::DOUBLE)), 15) AS q, least(floor((l_linenumber - 1) / (6 / 16::DOUBLE)), 15) AS n, least(floor((l_extendedprice - lo) / (hi - lo) * 16), 15) AS y FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem))"
_MI1 = "SELECT '{f}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (SELECT {c} AS a, y, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2))"


@query("model_mutual_information", f"WITH {_MI} SELECT feature, round(mi, 6) AS mi FROM ({_MI1.format(f='l_quantity', c='q')} UNION ALL {_MI1.format(f='l_linenumber', c='n')})")
def model_mutual_information(spark, sf_dir):
    return models.mutual_information(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], "l_extendedprice").select("feature", F.round("mi", 6).alias("mi"))


@query("model_vif", "WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM r) SELECT 'l_quantity' AS feature, round((1 - c * c) / d, 6) AS vif FROM d UNION ALL SELECT 'l_discount', round((1 - b * b) / d, 6) FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / d, 6) FROM d")
def model_vif(spark, sf_dir):
    v = models.vif(table(spark, sf_dir, "lineitem"), _FEATURES)
    return spark.createDataFrame([(k, round(x, 6)) for k, x in v.items()], "feature string, vif double")


@query("model_vif_drop")
def model_vif_drop(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax"))
    return spark.createDataFrame([(c,) for c in models.drop_by_vif(l, [*_FEATURES, "twice"])], "feature string")


@query("model_ridge")
def model_ridge(spark, sf_dir):
    return models.fit_and_predict(_lines(spark, sf_dir), _FEATURES, "l_extendedprice", "ridge", F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "part", "prediction")


@query("model_cross_validated")
def model_cross_validated(spark, sf_dir):
    return models.cross_validated(_lines(spark, sf_dir), _FEATURES, "l_extendedprice", "linear", F.col("l_orderkey"), 3).select("l_orderkey", "l_linenumber", "fold", "prediction")


@query("model_lasso_selection")
def model_lasso_selection(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in models.lasso_selection(_lines(spark, sf_dir), _FEATURES, "l_extendedprice")], "feature string")


@query("model_bayesian_ridge")
def model_bayesian_ridge(spark, sf_dir):
    """Predictions of the weights with the most evidence; checked against a plain numpy version in tests."""
    lines = _lines(spark, sf_dir)
    prediction, *_ = models.bayesian_ridge(lines, _FEATURES, "l_extendedprice")
    return lines.select("l_orderkey", "l_linenumber", F.round(prediction, 4).alias("prediction"))


@query("sink_model", "SELECT l_returnflag, count(*) AS n, count(*) AS n_same, 'quantity, discount and tax' AS card FROM lineitem GROUP BY 1")
def sink_model(spark, sf_dir):
    """A model written and read back: rows whose prediction is the same as before, and its card."""
    from pyspark.ml import Pipeline

    from loamwork.sources import sinks
    from loamwork.sources.scratch import path

    lines = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_extendedprice"))
    model, at = Pipeline(stages=[models.scaling(_FEATURES), models.regressor("ridge")]).fit(lines), path(spark, "model")
    sinks.save_model(model, at, {"columns": "quantity, discount and tax"})
    again, card = sinks.load_model(at)
    drop = ["_raw", "features", *(f"_i_{c}" for c in _FEATURES)]
    both = again.transform(model.transform(lines).drop(*drop).withColumnRenamed("prediction", "before"))
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("prediction")).alias("n_same"), F.lit(card["columns"]).alias("card"))


@query("model_land_cover_boosted")
def model_land_cover_boosted(spark, sf_dir):
    """Classes by boosted trees, one against the rest; checked for accuracy in tests."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("double"))
    return models.boost_cover(e.where("vec_id % 4 <> 0"), e, "embedding", "label", rounds=2, depth=3).select("vec_id", "class_id", "confidence")


@query("model_land_cover")
def model_land_cover(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("double"))
    return models.classify_cover(e.where("vec_id % 4 <> 0"), e, "embedding", "label", 10, trees=10).select("vec_id", "class_id", "confidence")


_PIX = "px AS (SELECT (l_suppkey % 4)::BIGINT AS scene, l_orderkey % 40 AS r, l_partkey % 40 AS c, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("scene"), (F.col("l_orderkey") % 40).alias("row"), (F.col("l_partkey") % 40).alias("col")).agg(F.max("l_extendedprice").alias("value"))


@query("raster_focal_median", f"WITH {_PIX} SELECT a.scene, a.r AS \"row\", a.c AS col, round(median(b.v), 4) AS focal FROM px a JOIN px b ON a.scene = b.scene AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL")
def raster_focal_median(spark, sf_dir):
    return raster.focal_median(_pixels(spark, sf_dir)).select("scene", "row", "col", F.round("focal", 4).alias("focal"))


@query("raster_sharpness", f"WITH {_PIX}, n AS (SELECT scene, v, lag(v) OVER x AS l, lead(v) OVER x AS r, lag(v) OVER y AS u, lead(v) OVER y AS d FROM px WINDOW x AS (PARTITION BY scene, r ORDER BY c), y AS (PARTITION BY scene, c ORDER BY r)) SELECT scene, round(avg(pow(r - l, 2) + pow(d - u, 2)) / 1e6, 4) AS tenengrad, round(var_pop(l + r + u + d - 4 * v) / 1e6, 4) AS laplacian_var FROM n WHERE l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND d IS NOT NULL GROUP BY 1")
def raster_sharpness(spark, sf_dir):
    s = raster.sharpness(_pixels(spark, sf_dir))
    return s.select("scene", F.round(F.col("tenengrad") / 1e6, 4).alias("tenengrad"), F.round(F.col("laplacian_var") / 1e6, 4).alias("laplacian_var"))


@query("raster_speckle_filter")
def raster_speckle_filter(spark, sf_dir):
    return raster.speckle_filter(_pixels(spark, sf_dir), 5, tile=16)


def _words(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("k", "text"))
    return c.select("page", (F.col("turn") * 1000 + F.col("k")).cast("int").alias("idx"), "text", (F.col("k") % 10 * 40).alias("x"), (F.col("turn") * 200 + F.floor(F.col("k") / 10) * 20).cast("int").alias("y"), F.lit(38).alias("w"), F.lit(12).alias("h"), (0.5 + F.length("text") / 40).alias("conf"))


@query("words_lines", "WITH w AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM conversations), l AS (SELECT DISTINCT conv_id, turn * 200 + (k // 10) * 20 AS y FROM w) SELECT conv_id AS page, count(*) AS n_lines FROM l GROUP BY 1")
def words_lines(spark, sf_dir):
    l = documents.lines_of(_words(spark, sf_dir), ["page"])
    return l.groupBy("page").agg((F.max("line") + 1).cast("long").alias("n_lines"))


@query(
    "words_redaction",
    """WITH w AS (SELECT conv_id AS page, regexp_replace(unnest(string_split(text, ' ')), '[,.;:!?]+$', '') AS x FROM conversations),
    k AS (SELECT page, len(list_filter(list_transform(string_split_regex(trim(x), '\\s+'), lambda v: regexp_replace(v, '[,.;:!?]+$', '')), lambda v: regexp_matches(v, '^([A-Z][A-Z\\-''’]+|[A-Z][a-z][a-z\\-''’]*|[A-Z]|[ऀ-ॿ]+)$') AND NOT regexp_matches(v, '^[A-Za-z]{2}$')
      AND NOT (regexp_matches(v, '^[A-Za-z]{3,}$') AND NOT regexp_matches(v, '[AEIOUaeiou]')))) > 0 AS kept FROM (SELECT page, x FROM w))
    SELECT page, CASE WHEN bool_or(kept) THEN count(*) FILTER (WHERE NOT kept) ELSE count(*) END AS n_redacted, count(*) AS n FROM k GROUP BY 1""",
)
def words_redaction(spark, sf_dir):
    """Words kept: those that can be a name's; all others are redacted."""
    w = _words(spark, sf_dir)
    kept = w.where(F.size(documents.name_tokens(F.col("text"))) > 0)
    return documents.redaction(w, kept, ["page"]).groupBy("page").agg(F.count_if("redact").alias("n_redacted"), F.count(F.lit(1)).alias("n"))


@query("words_audit")
def words_audit(spark, sf_dir):
    """Entities of the joined text as boxes around their words."""
    from loamwork.functions import text

    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    spans = c.select("page", F.split("text", " ").alias("ws")).select("page", "ws", documents.word_spans(F.col("ws")).alias("s"))
    w = spans.select("page", F.posexplode("s").alias("idx", "p")).select("page", "idx", F.col("p.start").alias("w_start"), F.col("p.stop").alias("w_stop"), (F.col("idx") % 10 * 40).alias("x"), (F.floor(F.col("idx") / 10) * 20).cast("int").alias("y"), F.lit(38).alias("w"), F.lit(12).alias("h"))
    e = c.select("page", F.explode(text.entities(F.col("text"))).alias("e")).select("page", "e.label", "e.start", "e.stop", "e.score")
    return documents.audit(w, e, ["page"]).select("page", "label", "start", "score", "box.*")

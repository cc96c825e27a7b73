"""Grouped statistics and sampling. AGG-01..23, 27..30, 34, 36, 37; MTH-07, 08, 15, 17; SRT-01..07; SET-01..07; PRJ-16, 17, 22."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamwork.operators import sampling, stats
from loamwork.plans.base import table
from loamwork.plans.registry import query


@query("agg_count_sorted", "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def agg_count_sorted(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n")).orderBy("n_regionkey", F.col("n").desc(), "n_name")


@query("agg_stratum_stats", "SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS sd, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def agg_stratum_stats(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.count("c_acctbal").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("agg_zonal", "SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY 1")
def agg_zonal(spark, sf_dir):
    z = stats.zonal(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return z.select("l_suppkey", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p10", "p90")), "n")


_Q = "SELECT {k}, quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM {t} GROUP BY {k}"


@query("agg_iqr_fences", f"WITH q AS ({_Q.format(k='o_orderpriority', v='o_totalprice', t='orders')}) SELECT o_orderkey, (b - a) > 0 AND (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) AS outside FROM orders JOIN q USING (o_orderpriority)")
def agg_iqr_fences(spark, sf_dir):
    return stats.fences(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 0.5).select("o_orderkey", "outside")


@query("agg_iqr_filter", "WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.75]) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, q WHERE l_quantity BETWEEN a[1] - 0.4 * (a[2] - a[1]) AND a[2] + 0.4 * (a[2] - a[1]) AND l_extendedprice BETWEEN b[1] - 0.4 * (b[2] - b[1]) AND b[2] + 0.4 * (b[2] - b[1])")
def agg_iqr_filter(spark, sf_dir):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return stats.inside_all_fences(table(spark, sf_dir, "lineitem").select(*cols), cols[2:], 0.4)


@query("agg_quantile_band", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN a AND b GROUP BY 1")
def agg_quantile_band(spark, sf_dir):
    b = stats.band(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return b.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


_BIN = "CASE WHEN len(list_distinct(e)) = 5 THEN (({v} > e[2])::INTEGER + ({v} > e[3])::INTEGER + ({v} > e[4])::INTEGER) END AS bin"


@query("agg_quantile_bins_group", f"WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS e FROM customer GROUP BY 1) SELECT c_custkey, {_BIN.format(v='c_acctbal')} FROM customer JOIN q USING (c_mktsegment)")
def agg_quantile_bins_group(spark, sf_dir):
    return stats.quantile_bins(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", "bin")


@query("agg_quantile_bins_all", f"WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) AS e FROM orders) SELECT o_orderkey, {_BIN.format(v='o_totalprice')} FROM orders, q")
def agg_quantile_bins_all(spark, sf_dir):
    return stats.quantile_bins(table(spark, sf_dir, "orders"), [], "o_totalprice").select("o_orderkey", "bin")


@query("agg_equal_bins", "WITH q AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) SELECT o_orderkey, least(greatest(ceil((o_totalprice - a) / ((b - a) / 5)) - 1, 0), 4)::INTEGER AS bin FROM orders, q")
def agg_equal_bins(spark, sf_dir):
    return stats.equal_bins(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bin")


@query("agg_count_if_columns", "SELECT 'l_discount' AS area, count(*) FILTER (WHERE l_discount > 0) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (WHERE l_tax > 0) FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity > 0) FROM lineitem")
def agg_count_if_columns(spark, sf_dir):
    cols = ["l_discount", "l_tax", "l_quantity"]
    return table(spark, sf_dir, "lineitem").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in cols)).unpivot([], cols, "area", "n")


@query("agg_crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def agg_crosstab(spark, sf_dir):
    return stats.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("agg_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "event_type")


@query("agg_pivot_metrics", "SELECT c_mktsegment, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_pivot_metrics(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("agg_distinct_sources", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT l_returnflag) = 1 AS one_class FROM lineitem GROUP BY 1")
def agg_distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_sources"), (F.count_distinct("l_returnflag") == 1).alias("one_class"))


@query("agg_mode_tiebreak", "SELECT user_id, event_type AS mode, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def agg_mode_tiebreak(spark, sf_dir):
    return stats.mode(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("agg_mode_annual", "SELECT k, y, o_orderpriority AS mode, n FROM (SELECT o_custkey % 20 AS k, year(o_orderdate)::INTEGER AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY k, y ORDER BY n DESC, o_orderpriority) = 1")
def agg_mode_annual(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), F.year("o_orderdate").alias("y"), "o_orderpriority")
    return stats.mode(o, ["k", "y"], "o_orderpriority")


@query("agg_class_fractions", "SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS fraction FROM events GROUP BY 1, 2")
def agg_class_fractions(spark, sf_dir):
    return stats.fractions(table(spark, sf_dir, "events"), ["user_id"], "event_type")


_PRED = "p AS (SELECT l.doc_id, d.lang, l.quality, l.toxic, d.n_chars > 1200 AS said, CASE WHEN l.quality = 0 THEN 'blur' WHEN l.toxic = 1 THEN 'cut' ELSE 'accepted' END AS truth, CASE WHEN d.n_chars < 700 THEN 'blur' WHEN d.n_chars < 1000 THEN 'cut' ELSE 'accepted' END AS pred FROM labels l JOIN documents d USING (doc_id))"
_LABELS = ["accepted", "blur", "cut", "document"]


def _pred(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    n = F.col("n_chars")
    truth = F.when(F.col("quality") == 0, "blur").when(F.col("toxic") == 1, "cut").otherwise("accepted")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", "quality", "toxic", (n > 1200).alias("said"), truth.alias("truth"), F.when(n < 700, "blur").when(n < 1000, "cut").otherwise("accepted").alias("pred"))


@query(
    "agg_binary_metrics",
    f"""WITH {_PRED}, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND said) AS tp, count(*) FILTER (WHERE quality <> 1 AND said) AS fp, count(*) FILTER (WHERE quality <> 1 AND NOT said) AS tn, count(*) FILTER (WHERE quality = 1 AND NOT said) AS fn FROM p)
    SELECT tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy FROM c""",
)
def agg_binary_metrics(spark, sf_dir):
    return stats.binary_metrics(_pred(spark, sf_dir), F.col("quality") == 1, F.col("said"))


_CLS = f"""{_PRED}, lab(label) AS (VALUES ('accepted'), ('blur'), ('cut'), ('document')),
  m AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE pred = label) AS s FROM p, lab GROUP BY 1),
  mm AS (SELECT label, round(coalesce(tp / nullif(s, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(s + support, 0), 0), 6) AS f1, support FROM m)"""


@query("agg_class_metrics", f"WITH {_CLS} SELECT * FROM mm")
def agg_class_metrics(spark, sf_dir):
    return stats.class_metrics(_pred(spark, sf_dir), "truth", "pred", _LABELS)


@query("agg_macro_f1", f"WITH {_CLS} SELECT round(avg(f1), 5) AS macro_f1 FROM mm")
def agg_macro_f1(spark, sf_dir):
    return stats.class_metrics(_pred(spark, sf_dir), "truth", "pred", _LABELS).agg(F.round(F.avg("f1"), 5).alias("macro_f1"))


@query("agg_confusion", f"WITH {_PRED}, lab(label) AS (VALUES ('accepted'), ('blur'), ('cut'), ('document')) SELECT a.label AS truth, b.label AS pred, count(p.doc_id) AS n FROM lab a CROSS JOIN lab b LEFT JOIN p ON p.truth = a.label AND p.pred = b.label GROUP BY 1, 2")
def agg_confusion(spark, sf_dir):
    return stats.confusion(_pred(spark, sf_dir), "truth", "pred", _LABELS)


@query("agg_group_accuracy", f"WITH {_PRED} SELECT lang, count(*) AS n, round(avg((truth = pred)::INTEGER), 6) AS accuracy, round(count(*) FILTER (WHERE truth = 'blur' AND pred = 'blur') / nullif(count(*) FILTER (WHERE truth = 'blur'), 0), 6) AS blur_recall FROM p GROUP BY 1")
def agg_group_accuracy(spark, sf_dir):
    hit = (F.col("truth") == F.col("pred")).cast("int")
    blur = F.try_divide(F.count_if((F.col("truth") == "blur") & (F.col("pred") == "blur")), F.count_if(F.col("truth") == "blur"))
    return _pred(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(blur, 6).alias("blur_recall"))


@query("agg_threshold_sweep", "WITH t(threshold) AS (VALUES (500), (900), (1300), (2000)), c AS (SELECT threshold, count(*) FILTER (WHERE quality = 1 AND n_chars > threshold) AS tp, count(*) FILTER (WHERE quality = 1) AS s, count(*) FILTER (WHERE n_chars > threshold) AS n FROM labels JOIN documents USING (doc_id), t GROUP BY 1) SELECT threshold, round(coalesce(2 * tp / nullif(s + n, 0), 0), 6) AS f1, row_number() OVER (ORDER BY round(coalesce(2 * tp / nullif(s + n, 0), 0), 6) DESC, threshold) = 1 AS best FROM c")
def agg_threshold_sweep(spark, sf_dir):
    from loamwork.operators.votes import sweep

    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return sweep(both, F.col("quality") == 1, "n_chars", [500, 900, 1300, 2000])


@query("agg_median_ranked", "SELECT event_type, round(median(value), 6) AS median_value, rank() OVER (ORDER BY median(value), event_type) AS place FROM events GROUP BY 1")
def agg_median_ranked(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_value"))
    return m.withColumn("place", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("median_value", "event_type")).cast("long"))


_ERR = "SELECT l_returnflag, round(sqrt(avg(pow(l_extendedprice - l_quantity * 2000, 2))), 3) AS rmse, round(avg(abs(l_extendedprice - l_quantity * 2000)), 3) AS mae, round(1 - sum(pow(l_extendedprice - l_quantity * 2000, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(avg(abs((l_extendedprice - l_quantity * 2000) / l_extendedprice)) * 100, 4) AS mape FROM lineitem GROUP BY 1"


@query("agg_regression_errors", _ERR)
def agg_regression_errors(spark, sf_dir):
    e = stats.errors(table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 2000), "l_extendedprice", "guess", ["l_returnflag"])
    return e.select("l_returnflag", *(F.round(c, k).alias(c) for c, k in (("rmse", 3), ("mae", 3), ("r2", 6), ("mape", 4))))


@query("agg_binned_errors", "SELECT least(floor(l_quantity / 10), 4)::INTEGER AS bin, round(avg(l_extendedprice - l_quantity * 2000), 3) AS mean_error, round(stddev_samp(l_extendedprice - l_quantity * 2000), 3) AS sd_error, count(*) AS n FROM lineitem GROUP BY 1")
def agg_binned_errors(spark, sf_dir):
    e = F.col("l_extendedprice") - F.col("l_quantity") * 2000
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("bin")).agg(F.round(F.avg(e), 3).alias("mean_error"), F.round(F.stddev_samp(e), 3).alias("sd_error"), F.count(F.lit(1)).alias("n"))


_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax"))


@query("agg_correlations", f"SELECT feature, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM ({_CORR})")
def agg_correlations(spark, sf_dir):
    return stats.correlations(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("feature", F.round("r", 8).alias("r"), F.round("t", 4).alias("t"))


@query("agg_correlation_screen")
def agg_correlation_screen(spark, sf_dir):
    """The same with p-values; DuckDB has no Student t, so tests compare with known values."""
    return stats.correlation_screen(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("agg_flag_counts", "WITH f AS (SELECT concat_ws(',', CASE WHEN l_quantity > 45 THEN 'range:quantity' END, CASE WHEN l_discount > 0.08 THEN 'range:discount' END, CASE WHEN l_tax > 0.07 THEN 'range:tax' END) AS qc FROM lineitem) SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(qc, ',')) AS flag FROM f WHERE qc <> '') GROUP BY 1")
def agg_flag_counts(spark, sf_dir):
    from loamwork.functions.cleaning import joined_flags, range_flags

    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    qc = l.select(joined_flags(range_flags({"quantity": (0, 45), "discount": (0, 0.08), "tax": (0, 0.07)})).alias("qc")).where("qc <> ''")
    return qc.select(F.explode(F.split("qc", ",")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("agg_class_weights", "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def agg_class_weights(spark, sf_dir):
    return stats.class_weights(table(spark, sf_dir, "embeddings"), "label")


@query("agg_clipped_histogram", "SELECT l_returnflag, least(floor((least(greatest(l_extendedprice / 1000, 0), 80) - 0) / (80 / 40::DOUBLE)), 39)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_clipped_histogram(spark, sf_dir):
    return stats.clipped_histogram(table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") / 1000), ["l_returnflag"], "v", 0.0, 80.0, 40)


@query("agg_daily_collapse", "SELECT user_id, CAST(ts AS DATE) AS d, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def agg_daily_collapse(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg_median_filter", "WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1) SELECT e.user_id, count(*) AS n FROM events e JOIN m USING (user_id) WHERE value >= 2 AND value <= 3 * m GROUP BY 1")
def agg_median_filter(spark, sf_dir):
    """Values within three medians of their group, and above a least height."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return e.join(m, "user_id").where((F.col("value") >= 2) & (F.col("value") <= 3 * F.col("m"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_heterogeneity", "WITH d AS (SELECT user_id % 30 AS farm, user_id, min(CAST(ts AS DATE)) FILTER (WHERE value >= 100) AS sow FROM events GROUP BY 1, 2), s AS (SELECT farm, count(sow) AS n, min(sow) AS first_date, max(sow) AS last_date, quantile_cont(date_diff('day', DATE '1970-01-01', sow), 0.5) AS mid FROM d GROUP BY 1) SELECT farm, n, first_date, last_date, mid AS median_day, CASE WHEN n < 2 THEN 'insufficient' WHEN date_diff('day', first_date, last_date) >= 20 THEN 'heterogeneous' ELSE 'uniform' END AS status FROM s")
def agg_heterogeneity(spark, sf_dir):
    sow = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 30).alias("farm"), "user_id").agg(F.min(F.when(F.col("value") >= 100, F.to_date("ts"))).alias("sow"))
    s = sow.groupBy("farm").agg(F.count("sow").alias("n"), F.min("sow").alias("first_date"), F.max("sow").alias("last_date"), F.percentile(F.unix_date("sow"), F.lit(0.5)).alias("median_day"))
    return s.withColumn("status", F.when(F.col("n") < 2, "insufficient").when(F.datediff("last_date", "first_date") >= 20, "heterogeneous").otherwise("uniform"))


_PLAN = """st AS (SELECT c_nationkey AS stratum, count(c_acctbal) AS n_points, avg(c_acctbal) AS mean, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE stddev_samp(c_acctbal) END AS sd FROM customer GROUP BY 1),
  ar AS (SELECT c_nationkey AS stratum, count(*) * 0.7::DOUBLE AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  bl AS (SELECT s_nationkey AS stratum, count(*) AS n_blocks FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1),
  j AS (SELECT st.*, area, coalesce(n_blocks, 1) AS n_blocks FROM st LEFT JOIN ar USING (stratum) LEFT JOIN bl USING (stratum)),
  pl AS (SELECT avg(sd) FILTER (WHERE n_points >= 10 AND sd IS NOT NULL) AS pool, max(sd) AS mx FROM j),
  u AS (SELECT j.*, CASE WHEN n_points >= 10 AND sd IS NOT NULL THEN sd ELSE coalesce(pool, mx) END AS su, CASE WHEN n_points >= 10 AND sd IS NOT NULL THEN 'own' WHEN pool IS NOT NULL THEN 'pooled' ELSE 'max' END AS std_source, greatest(area / 0.5, 1.0) AS pop FROM j, pl),
  n AS (SELECT *, CASE WHEN mean > 0 AND pop > 0 THEN ceil(pow(1.96 * su / (0.15 * mean), 2) / (1 + (pow(1.96 * su / (0.15 * mean), 2) - 1) / pop)) END AS n_raw FROM u),
  b AS (SELECT *, ceil(round(n_raw * 1.2, 9)) AS nb FROM n)"""


@query(
    "sampling_plan",
    f"WITH {_PLAN} SELECT stratum, n_points, n_blocks, std_source, n_raw::DOUBLE AS n_raw, nb::DOUBLE AS n_buffered, least(greatest(coalesce(nb, 2 * n_blocks), 2 * n_blocks), 3 * n_blocks)::BIGINT AS planned_cores, std_source <> 'own' AS is_std_imputed, coalesce(nb > 3 * n_blocks, false) AS is_at_ceiling FROM b",
)
def sampling_plan(spark, sf_dir):
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    strata = c.groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count("c_acctbal").alias("n_points"), F.avg("c_acctbal").alias("mean"), F.when(F.count(F.lit(1)) % 3 != 0, F.stddev_samp("c_acctbal")).alias("sd"))
    area = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("stratum")).agg((F.count(F.lit(1)) * 0.7).alias("area"))
    blocks = s.where(F.col("s_nationkey") % 4 != 0).groupBy(F.col("s_nationkey").alias("stratum")).agg(F.count(F.lit(1)).alias("n_blocks"))
    p = sampling.plan(strata.join(area, "stratum", "left").join(blocks, "stratum", "left"))
    return p.select("stratum", "n_points", "n_blocks", "std_source", "n_raw", "n_buffered", "planned_cores", "is_std_imputed", "is_at_ceiling")


@query("sampling_cochran", "WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN m > 0 THEN ceil(pow(1.96 * s / (0.15 * m), 2) / (1 + (pow(1.96 * s / (0.15 * m), 2) - 1) / n))::DOUBLE END AS n_cochran FROM s")
def sampling_cochran(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return s.select("l_suppkey", sampling.cochran(F.col("m"), F.col("s"), F.col("n")).alias("n_cochran"))


@query("sampling_stratified_counts", "SELECT event_type, least(count(*), 100) AS n FROM events GROUP BY 1")
def sampling_stratified_counts(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "events"), "event_type", "event_id", 100, 42).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sampling_class_pixels")
def sampling_class_pixels(spark, sf_dir):
    """The draw itself: 30 vectors of each class without replacement."""
    return sampling.stratified(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 30, 7)


@query(
    "sampling_group_split",
    "SELECT c_nationkey, CASE WHEN ('0x' || substr(md5('3:' || c_nationkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.85 THEN 0 ELSE 1 END::INTEGER AS part, count(*) AS n FROM customer GROUP BY ALL",
)
def sampling_group_split(spark, sf_dir):
    """Parts 85 / 15 by groups (cells), so that no group is in both."""
    part = sampling.split(F.col("c_nationkey"), [0.85, 0.15], 3)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("sort_multi_key", "SELECT row_number() OVER (ORDER BY l_returnflag, n DESC NULLS LAST, l_suppkey) AS place, l_returnflag, l_suppkey, n FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def sort_multi_key(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("l_returnflag"), F.desc_nulls_last("n"), "l_suppkey")
    return n.withColumn("place", F.row_number().over(w).cast("long"))


@query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("sort_top1_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def sort_top1_group(spark, sf_dir):
    """The largest of each group by an aggregate, so hot groups are reduced before the exchange."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct((-F.col("o_totalprice")).alias("k"), "o_orderkey")).alias("b"))
    return best.select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"), (-F.col("b.k")).alias("o_totalprice"))


@query("sort_tail", "SELECT user_id, round(avg(value), 6) AS mean_last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 14 GROUP BY 1")
def sort_tail(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return table(spark, sf_dir, "events").withColumn("r", r).where("r <= 14").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_last"))


@query("sort_chunks", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 100)::BIGINT AS chunk FROM orders")
def sort_chunks(spark, sf_dir):
    return sampling.chunks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("set_union_all", "SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def set_union_all(spark, sf_dir):
    from loamwork.sources.readers import union_sources

    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return union_sources([c, s])


@query("set_distinct_points", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_distinct_points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("set_date_union", "SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def set_date_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).union(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate"))).distinct()


@query("set_members", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_order FROM customer")
def set_members(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_order", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_order", F.lit(False)))


@query("set_first_wins", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def set_first_wins(spark, sf_dir):
    from loamwork.operators.joins import first_of_each

    return first_of_each(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("set_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def set_duplicates(spark, sf_dir):
    from loamwork.operators.joins import duplicates

    return duplicates(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("set_source_agreement", "WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey % 3) AS s, count(DISTINCT l_returnflag) AS c FROM lineitem GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_returnflag FROM lineitem l JOIN c USING (l_orderkey) WHERE s = 1 OR c = 1")
def set_source_agreement(spark, sf_dir):
    from loamwork.operators.landcover import agreeing

    l = table(spark, sf_dir, "lineitem").withColumn("src", F.col("l_suppkey") % 3)
    return agreeing(l, ["l_orderkey"], "src", "l_returnflag").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")


@query("project_missing_report", "SELECT 'a' AS \"column\", round(avg(CASE WHEN l_quantity > 40 THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct FROM lineitem UNION ALL SELECT 'b', round(avg(CASE WHEN l_tax < 0.02 THEN 100.0::DOUBLE ELSE 0 END), 6) FROM lineitem UNION ALL SELECT 'l_orderkey', 0.0::DOUBLE")
def project_missing_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return stats.missing_report(l.select(F.when(F.col("l_quantity") <= 40, 1).alias("a"), F.when(F.col("l_tax") >= 0.02, 1).alias("b"), "l_orderkey"))


@query("project_drop_nulls", "SELECT count(*) AS n, round(sum(x), 2) AS s FROM (SELECT CASE WHEN l_quantity > 10 THEN l_quantity END AS x, CASE WHEN l_tax > 0 THEN l_tax END AS y FROM lineitem) WHERE x IS NOT NULL AND y IS NOT NULL")
def project_drop_nulls(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("x"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("y"))
    return l.na.drop(subset=["x", "y"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("s"))


@query("project_unpivot", "UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME feature VALUE v")
def project_unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "feature", "v")


@query("math_stretch", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest((l_extendedprice - a) / (b - a), 0), 1), 6) AS v FROM lineitem, q")
def math_stretch(spark, sf_dir):
    from loamwork.functions.numeric import stretch

    return stretch(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.round("stretched", 6).alias("v"))


@query("math_coalition_weights", f"WITH e AS ({_ERR}), w AS (SELECT l_returnflag, (1 / rmse) / sum(1 / rmse) OVER () AS w FROM e) SELECT l_returnflag, round(w, 6) AS weight FROM w")
def math_coalition_weights(spark, sf_dir):
    from loamwork.functions.numeric import coalition

    e = stats.errors(table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 2000), "l_extendedprice", "guess", ["l_returnflag"])
    return coalition(e.select("l_returnflag", F.round("rmse", 3).alias("rmse")), "rmse").select("l_returnflag", F.round("weight", 6).alias("weight"))


@query(
    "agg_normality",
    """WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders), c AS (SELECT count(o_totalprice) AS n, avg(pow(o_totalprice - mu, 2)) AS m2, avg(pow(o_totalprice - mu, 3)) AS m3, avg(pow(o_totalprice - mu, 4)) AS m4 FROM orders, m),
    s AS (SELECT n, m3 / pow(m2, 1.5::DOUBLE) AS skewness, m4 / pow(m2, 2) - 3 AS kurtosis FROM c) SELECT n, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(n / 6.0::DOUBLE * (pow(skewness, 2) + pow(kurtosis, 2) / 4), 2) AS statistic, round(exp(-n / 12.0::DOUBLE * (pow(skewness, 2) + pow(kurtosis, 2) / 4)), 6) AS p FROM s""",
)
def agg_normality(spark, sf_dir):
    r = lambda c, k: F.round(c, k).alias(c)
    return stats.normality(table(spark, sf_dir, "orders"), "o_totalprice").select("n", r("skewness", 6), r("kurtosis", 6), r("statistic", 2), r("p", 6))


@query(
    "agg_lowess",
    """WITH p AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice AS y FROM lineitem), g(a) AS (VALUES (1.0::DOUBLE), (10.5), (25.0), (40.25), (50.0)), n AS (SELECT count(*) AS n FROM p),
    d AS (SELECT a, x, y, abs(x - a) AS d FROM p, g), r AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM d), h AS (SELECT a, max(d) AS h FROM r, n WHERE r <= floor(0.3::DOUBLE * n + 1e-10) GROUP BY 1),
    w AS (SELECT a, x - a AS u, y, pow(1 - pow(least(d / h, 1.0::DOUBLE), 3), 3) AS w FROM d JOIN h USING (a)), s AS (SELECT a, sum(w) AS w, sum(w * u) AS u, sum(w * u * u) AS uu, sum(w * y) AS v, sum(w * u * y) AS uv FROM w GROUP BY 1)
    SELECT a AS at, round((uu * v - u * uv) / (w * uu - u * u), 4) AS trend FROM s""",
)
def agg_lowess(spark, sf_dir):
    """The local trend of price over quantity at five places."""
    return stats.lowess(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", [1.0, 10.5, 25.0, 40.25, 50.0], 0.3).select("at", F.round("trend", 4).alias("trend"))


@query(
    "agg_robust_scaling",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, CASE WHEN l_quantity > 3 THEN l_quantity END AS b FROM lineitem), q AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS qa, quantile_cont(b, [0.25, 0.5, 0.75]) AS qb FROM x)
    SELECT l_orderkey, l_linenumber, round((a - qa[2]) / (qa[3] - qa[1]), 6) AS a, round((coalesce(b, qb[2]) - qb[2]) / (qb[3] - qb[1]), 6) AS b FROM x, q""",
)
def agg_robust_scaling(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("b"))
    return stats.robust_scaled(l, ["a", "b"]).select("l_orderkey", "l_linenumber", F.round("scaled_a", 6).alias("a"), F.round("scaled_b", 6).alias("b"))

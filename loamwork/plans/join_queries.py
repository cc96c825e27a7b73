"""Joins. JN-01..20; PRJ-12, 13, 15; KRN-04."""

from pyspark.sql import functions as F

from loamwork.functions import geometry
from loamwork.functions.cleaning import normalize_key
from loamwork.operators import joins, soil
from loamwork.plans.base import table
from loamwork.plans.registry import query

_NORM = "coalesce(upper(trim(regexp_replace({}, '\\s+', ' ', 'g'))), '')"


@query("project_normalize_key", f"SELECT c_custkey, {_NORM.format(chr(39) + '  ' + chr(39) + ' || c_mktsegment || ' + chr(39) + '   ' + chr(39) + ' || lower(c_name) || ' + chr(39) + ' ' + chr(39))} AS k FROM customer")
def project_normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_key(F.concat(F.lit("  "), "c_mktsegment", F.lit("   "), F.lower("c_name"), F.lit(" "))).alias("k"))


@query(
    "join_full_outer_provenance",
    """WITH a AS (SELECT upper(n_name) AS k, n_regionkey AS r, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0 GROUP BY 1, 2),
    b AS (SELECT upper(n_name) AS k, n_regionkey AS r, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 GROUP BY 1, 2)
    SELECT k, r, n_customers, n_suppliers, CASE WHEN n_customers IS NOT NULL AND n_suppliers IS NOT NULL THEN 'both' WHEN n_customers IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge FROM a FULL OUTER JOIN b USING (k, r)""",
)
def join_full_outer_provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda t, key, m, name: table(spark, sf_dir, t).join(n.where(f"n_nationkey % {m} <> 0"), F.col(key) == F.col("n_nationkey")).groupBy(normalize_key(F.col("n_name")).alias("k"), F.col("n_regionkey").alias("r")).agg(F.count(F.lit(1)).alias(name))
    return joins.with_provenance(side("customer", "c_nationkey", 3, "n_customers"), side("supplier", "s_nationkey", 4, "n_suppliers"), ["k", "r"])


@query("join_left_layers", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'")
def join_left_layers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey", "left")


@query("join_left_distinct", "WITH d AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN d ON c_custkey = o_custkey")
def join_left_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.left_on_distinct(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderkey"])


@query("join_covariates_exact", "WITH p AS (SELECT l_partkey, l_suppkey, max(l_tax) AS elevation FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l.l_partkey, elevation FROM lineitem l LEFT JOIN p USING (l_partkey, l_suppkey)")
def join_covariates_exact(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    lookup = l.where("l_linenumber <= 3").groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("elevation"))
    return soil.attach(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lookup, ["l_partkey", "l_suppkey"], ["elevation"]).drop("l_suppkey")


@query("join_covariates_depth", "WITH g AS (SELECT l_suppkey, l_linenumber AS depth, round(avg(l_discount), 6) AS sg FROM lineitem GROUP BY 1, 2) SELECT o_orderkey, s, d, sg FROM (SELECT o_orderkey, o_custkey % 100 AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS d FROM orders) LEFT JOIN g ON s = l_suppkey AND d = depth")
def join_covariates_depth(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("d")).agg(F.round(F.avg("l_discount"), 6).alias("sg"))
    code = F.try_element_at(F.create_map(*(F.lit(x) for x in ("1-URGENT", 1, "2-HIGH", 2, "5-LOW", 5))), F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("s"), code.alias("d"))
    return soil.attach(o, g, ["s", "d"], ["sg"])


_ZONES = [("low", [(0.0, 0.0), (40000.0, 0.0), (40000.0, 20.0), (0.0, 20.0)]), ("wedge", [(40000.0, 0.0), (90000.0, 0.0), (40000.0, 50.0)]), ("notch", [(60000.0, 30.0), (100000.0, 30.0), (100000.0, 60.0), (80000.0, 40.0), (60000.0, 60.0)])]


def _cross_sql(poly: list[tuple[float, float]]) -> str:
    n, terms = len(poly), []
    for k in range(n):
        (ax, ay), (bx, by) = poly[k], poly[(k + 1) % n]
        if ay != by:
            terms.append(f"((({ay} > y) <> ({by} > y)) AND x < ({bx - ax}) * (y - {ay}) / ({by - ay}) + {ax})::INTEGER")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query("join_point_in_polygon", "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, l_quantity AS y FROM lineitem) " + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, '{n}' AS zone FROM p WHERE {_cross_sql(z)}" for n, z in _ZONES))
def join_point_in_polygon(spark, sf_dir):
    """Points within polygons: boxes first, then the even-odd rule."""
    zones = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in z]) for n, z in _ZONES], "zone string, ring array<struct<x:double,y:double>>")
    zones = zones.select("zone", "ring", *(c.alias(n) for n, c in geometry.box(F.col("ring")).items()))
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & geometry.contains(F.col("ring"), F.col("x"), F.col("y"))
    return p.join(F.broadcast(zones), inside).select("l_orderkey", "l_linenumber", "l_partkey", "zone")  # a handful of literal zones


_HOR = "h AS (SELECT l_orderkey AS profile_id, (l_linenumber - 1) * 15.0::DOUBLE AS upper, (l_linenumber - 1) * 15.0::DOUBLE + l_quantity AS lower, ln(max(l_extendedprice)) AS soc FROM lineitem GROUP BY ALL)"


def horizons(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    top = (F.col("l_linenumber") - 1) * F.lit(15.0)
    return l.groupBy(F.col("l_orderkey").alias("profile_id"), top.alias("upper"), (top + F.col("l_quantity")).alias("lower")).agg(F.log(F.max("l_extendedprice")).alias("soc"))


_GRID = "g(top, bottom) AS (VALUES (0, 5), (5, 15), (15, 30), (30, 60), (60, 100), (100, 200))"
_SLICES = f"WITH {_HOR}, {_GRID} SELECT profile_id, top::DOUBLE AS top, bottom::DOUBLE AS bottom, round(sum(greatest(0, least(lower, bottom) - greatest(upper, top)) * soc) / sum(greatest(0, least(lower, bottom) - greatest(upper, top))), 8) AS soc FROM h, g WHERE upper < bottom AND top < lower GROUP BY 1, 2, 3"


@query("join_interval_overlap", f"WITH {_HOR}, {_GRID} SELECT profile_id, upper, top::DOUBLE AS top, bottom::DOUBLE AS bottom, least(lower, bottom) - greatest(upper, top) AS overlap FROM h, g WHERE upper < bottom AND top < lower")
def join_interval_overlap(spark, sf_dir):
    grid = spark.createDataFrame([(float(a), float(b)) for a, b in soil.SLICES], "top double, bottom double")
    return joins.overlap_join(horizons(spark, sf_dir), grid, [], ("upper", "lower"), ("top", "bottom")).select("profile_id", "upper", "top", "bottom", "overlap")


@query("soil_slice_means", _SLICES)
def soil_slice_means(spark, sf_dir):
    return soil.slice_means(horizons(spark, sf_dir), ["profile_id"], "soc").select("profile_id", "top", "bottom", F.round("soc", 8).alias("soc"))


@query("soil_harmonise_curve")
def soil_harmonise_curve(spark, sf_dir):
    """The penalised curve; checked against a plain numpy version in tests."""
    return soil.harmonise(horizons(spark, sf_dir), "profile_id", "soc")


@query(
    "join_interval_overlap_buckets",
    """WITH a AS (SELECT l_suppkey AS k, l_orderkey AS a_id, l_linenumber AS a_no, l_extendedprice AS lo, l_extendedprice + 300 AS hi FROM lineitem), b AS (SELECT l_suppkey AS k, l_orderkey AS b_id, l_linenumber AS b_no, l_extendedprice AS lo2, l_extendedprice + 200 AS hi2 FROM lineitem)
    SELECT a.k, a_id, a_no, b_id, b_no, round(least(hi, hi2) - greatest(lo, lo2), 4) AS overlap FROM a JOIN b ON a.k = b.k AND lo < hi2 AND lo2 < hi""",
)
def join_interval_overlap_buckets(spark, sf_dir):
    """Two large sides of intervals, over cells."""
    l = table(spark, sf_dir, "lineitem")
    a = l.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("a_id"), F.col("l_linenumber").alias("a_no"), F.col("l_extendedprice").alias("lo"), (F.col("l_extendedprice") + 300).alias("hi"))
    b = l.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("b_id"), F.col("l_linenumber").alias("b_no"), F.col("l_extendedprice").alias("lo2"), (F.col("l_extendedprice") + 200).alias("hi2"))
    return joins.overlap_join(a, b, ["k"], ("lo", "hi"), ("lo2", "hi2"), bucket=500.0).select("k", "a_id", "a_no", "b_id", "b_no", F.round("overlap", 4).alias("overlap"))


_PTS = "p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 37 % 1000)::DOUBLE AS y FROM customer)"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"))


@query("join_distance_pairs", f"WITH {_PTS} SELECT a.id AS id_a, b.id AS id_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60")
def join_distance_pairs(spark, sf_dir):
    return joins.near_pairs(_points(spark, sf_dir), 60.0).select("id_a", "id_b", F.round("distance", 6).alias("distance"))


@query(
    "join_keep_first",
    f"""WITH RECURSIVE {_PTS}, near AS MATERIALIZED (SELECT b.id, list(a.id) AS smaller FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60 GROUP BY 1),
    o AS MATERIALIZED (SELECT p.id, row_number() OVER (ORDER BY p.id) AS r, coalesce(smaller, []) AS smaller FROM p LEFT JOIN near ON near.id = p.id),
    t AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT o.r, CASE WHEN list_has_any(o.smaller, t.kept) THEN t.kept ELSE list_append(t.kept, o.id) END FROM t JOIN o ON o.r = t.r + 1)
    SELECT id, NOT list_contains((SELECT kept FROM t ORDER BY r DESC LIMIT 1), id) AS dropped FROM p""",
)
def join_keep_first(spark, sf_dir):
    """Greedy removal of later points near an earlier one that stays; checked against a plain loop in tests."""
    p = _points(spark, sf_dir)
    return joins.keep_first(p, joins.near_pairs(p, 60.0))


@query("join_metric_degrees", "WITH p AS (SELECT c_custkey AS id, 77 + c_acctbal / 10000 AS lon, 12 + (c_custkey % 100) / 50.0::DOUBLE AS lat FROM customer), m AS (SELECT avg(lat) AS m FROM p) SELECT id, round(lon * 111320 * cos(radians(m)), 2) AS x, round(lat * 111320, 2) AS y FROM p, m")
def join_metric_degrees(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (77 + F.col("c_acctbal") / 10000).alias("lon"), (12 + (F.col("c_custkey") % 100) / 50.0).alias("lat"))
    return joins.metric_degrees(p).select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("join_label_predictions", "SELECT quality = 1 AS truth, n_chars > 1000 AS said, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def join_label_predictions(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1000).alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query("join_semi_anti", "SELECT lang, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS n_rest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def join_semi_anti(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    with_, without = (d.join(l, "doc_id", how).groupBy("lang").agg(F.count(F.lit(1)).alias(n)) for how, n in (("left_semi", "n_labelled"), ("left_anti", "n_rest")))
    return with_.join(without, "lang", "full_outer").na.fill(0)


@query("join_grid_semi", "WITH r AS (SELECT DISTINCT round_even(s_acctbal / 50, 0) AS gx, round_even(s_nationkey / 2.0::DOUBLE, 0) AS gy FROM supplier) SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM r WHERE round_even(c_acctbal / 50, 0) = gx AND round_even((c_nationkey / 2.0::DOUBLE) * 50 / 50, 0) = gy)")
def join_grid_semi(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lon"), (F.col("c_nationkey") / 2.0 * 50).alias("lat"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("lon"), (F.col("s_nationkey") / 2.0 * 50).alias("lat"))
    return joins.on_grid(c, s, 50.0).select("c_custkey")


@query("join_pixel_lookup", "SELECT c_custkey, CASE WHEN floor((9000 - y) / 500) BETWEEN 0 AND 9 AND floor((x + 500) / 1000) BETWEEN 0 AND 9 THEN floor((9000 - y) / 500)::INTEGER END AS \"row\", CASE WHEN floor((9000 - y) / 500) BETWEEN 0 AND 9 AND floor((x + 500) / 1000) BETWEEN 0 AND 9 THEN floor((x + 500) / 1000)::INTEGER END AS col FROM (SELECT c_custkey, c_acctbal AS x, (c_custkey * 7 % 9500)::DOUBLE AS y FROM customer)")
def join_pixel_lookup(spark, sf_dir):
    row, col = joins.pixel_of(F.col("c_acctbal"), (F.col("c_custkey") * 7 % 9500).cast("double"), (-500.0, 9000.0), (1000.0, 500.0), (10, 10))
    return table(spark, sf_dir, "customer").select("c_custkey", row.alias("row"), col.alias("col"))


_SPANS = "w AS (SELECT conv_id AS page, turn * 10 AS w_start, turn * 10 + length(role) AS w_end, turn FROM conversations), e AS (SELECT conv_id AS page, turn * 10 + 3 AS e_start, turn * 10 + 12 AS e_end, turn AS e_no FROM conversations WHERE turn % 2 = 0)"


@query("join_span_overlap", f"WITH {_SPANS} SELECT w.page, turn, e_no FROM w JOIN e ON w.page = e.page AND w_start < e_end AND e_start < w_end")
def join_span_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page")
    w = c.select("page", (F.col("turn") * 10).alias("w_start"), (F.col("turn") * 10 + F.length("role")).alias("w_end"), "turn")
    e = c.where("turn % 2 = 0").select("page", (F.col("turn") * 10 + 3).alias("e_start"), (F.col("turn") * 10 + 12).alias("e_end"), F.col("turn").alias("e_no"))
    return joins.span_overlaps(w, e, ["page"]).select("page", "turn", "e_no")


@query("join_case_insensitive", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(trim('  ' || c_mktsegment)) = lower(trim(CASE s_suppkey % 3 WHEN 0 THEN 'Machinery ' WHEN 1 THEN ' building' ELSE 'FURNITURE' END)) AND c_nationkey = s_nationkey")
def join_case_insensitive(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Machinery ").when(F.col("s_suppkey") % 3 == 1, " building").otherwise("FURNITURE")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment"))).alias("k"), F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.trim(kind)).alias("k"), F.col("s_nationkey").alias("n"))
    return c.join(s, ["k", "n"]).select("c_custkey", "s_suppkey")


@query("filter_boxes", "SELECT count(*) AS n FROM customer WHERE c_acctbal - 10 <= 5000 AND c_acctbal + 10 >= 1000 AND c_nationkey <= 12 AND c_nationkey + 1 >= 4")
def filter_boxes(spark, sf_dir):
    a = {"min_x": F.col("c_acctbal") - 10, "max_x": F.col("c_acctbal") + 10, "min_y": F.col("c_nationkey"), "max_y": F.col("c_nationkey") + 1}
    b = dict(zip(("min_x", "max_x", "min_y", "max_y"), map(F.lit, (1000, 5000, 4, 12))))
    return table(spark, sf_dir, "customer").where(geometry.boxes_meet(a, b)).agg(F.count(F.lit(1)).alias("n"))


@query("filter_half_open_dates", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def filter_half_open_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").where("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-12'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_list_contains", "SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error' AND value > 150) > 0 AND count(*) FILTER (WHERE event_type = 'click' AND value > 150) > 0")
def filter_list_contains(spark, sf_dir):
    lists = table(spark, sf_dir, "events").where("value > 150").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return lists.where(F.array_contains("kinds", "error") & F.array_contains("kinds", "click")).select("user_id")

"""Soil, land cover, zones, text, identity, documents and volumes: MTH-01..06, 09..16, STR, ARR, MAP, JSN, DAT, GEO, KRN-13/14, AGG-23..26, 31, 35, 38, 39."""

from pyspark.sql import functions as F

from loamwork.functions import geometry, numeric, text
from loamwork.functions.cleaning import coalesce_date, joined_flags, number
from loamwork.operators import documents, landcover, soil, volume, votes
from loamwork.plans.base import table
from loamwork.plans.registry import query

# soil ----------------------------------------------------------------------------------------------------------------

_SOIL = """s AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity * 18 AS soc, l_tax * 30 AS bulk_density, l_discount * 1100 AS coarse, l_quantity / 4 AS ph, l_quantity AS clay, l_discount * 400 AS silt, l_tax * 700 AS sand, (l_linenumber - 1) * 20.0::DOUBLE AS upper, l_linenumber * 20.0::DOUBLE AS lower FROM lineitem)"""


def _soil(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), (c("l_quantity") * 18).alias("soc"), (c("l_tax") * 30).alias("bulk_density"), (c("l_discount") * 1100).alias("coarse"), (c("l_quantity") / 4).alias("ph"),
        c("l_quantity").alias("clay"), (c("l_discount") * 400).alias("silt"), (c("l_tax") * 700).alias("sand"), ((c("l_linenumber") - 1) * F.lit(20.0)).alias("upper"), (c("l_linenumber") * F.lit(20.0)).alias("lower"),
    )


@query("soil_units", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 10 WHEN 2 THEN l_quantity * 10 / 1.724::DOUBLE ELSE l_quantity / 1000 END, 6) AS soc FROM lineitem")
def soil_units(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("g_per_kg", "pct", "som_pct", "mg_per_kg"))), F.col("l_linenumber") % 4 + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(soil.soc_g_per_kg(F.col("l_quantity"), unit), 6).alias("soc"))


@query("soil_density_ph", f"WITH {_SOIL} SELECT o, n, p, CASE WHEN bulk_density BETWEEN 0.05 AND 2.0 THEN round(bulk_density, 6) END AS bd, round(ph + CASE WHEN n % 2 = 0 THEN 0.6::DOUBLE ELSE 0 END, 6) AS ph_w, round(coarse / 11 * bulk_density / 2.65::DOUBLE, 6) AS coarse_vol FROM s")
def soil_density_ph(spark, sf_dir):
    method = F.when(F.col("n") % 2 == 0, "cacl2").otherwise("h2o")
    return _soil(spark, sf_dir).select("o", "n", "p", F.round(soil.bulk_density(F.col("bulk_density")), 6).alias("bd"), F.round(soil.ph_in_water(F.col("ph"), method), 6).alias("ph_w"), F.round(soil.coarse_volume(F.col("coarse") / 11, F.col("bulk_density")), 6).alias("coarse_vol"))


@query("soil_carbon_stock", f"WITH {_SOIL} SELECT o, n, p, round(soc * bulk_density * (lower - upper) * (1 - least(greatest(coalesce(CASE WHEN n <> 3 THEN coarse END, 0), 0), 99) / 100) * 0.1::DOUBLE, 4) AS stock FROM s")
def soil_carbon_stock(spark, sf_dir):
    c = F.col
    return _soil(spark, sf_dir).select("o", "n", "p", F.round(soil.carbon_stock(c("soc"), c("bulk_density"), c("upper"), c("lower"), F.when(c("n") != 3, c("coarse"))), 4).alias("stock"))


@query("soil_texture", f"WITH {_SOIL}, t AS (SELECT *, clay + silt + sand AS t FROM s) SELECT o, n, p, round(CASE WHEN t > 0 AND t <> 100 THEN clay * 100 / t ELSE clay END, 6) AS clay, round(CASE WHEN t > 0 AND t <> 100 THEN sand * 100 / t ELSE sand END, 6) AS sand, CASE WHEN t < 95 OR t > 105 THEN 'texture_sum' END AS texture_flag FROM t")
def soil_texture(spark, sf_dir):
    return soil.texture(_soil(spark, sf_dir)).select("o", "n", "p", F.round("clay", 6).alias("clay"), F.round("sand", 6).alias("sand"), "texture_flag")


_FLAGS = "concat_ws(',', CASE WHEN NOT soc BETWEEN 0 AND 800 THEN 'range:soc' END, CASE WHEN NOT bulk_density BETWEEN 0.05 AND 2.0 THEN 'range:bulk_density' END, CASE WHEN NOT coarse BETWEEN 0 AND 100 THEN 'range:coarse' END, CASE WHEN NOT ph BETWEEN 2.5 AND 11 THEN 'range:ph' END)"


@query("soil_range_flags", f"WITH {_SOIL} SELECT o, n, p, {_FLAGS} AS flags, CASE WHEN soc BETWEEN 0 AND 800 THEN soc END AS soc FROM s")
def soil_range_flags(spark, sf_dir):
    q = soil.quality_control(_soil(spark, sf_dir).select("o", "n", "p", "soc", "bulk_density", "coarse", "ph"))
    return q.select("o", "n", "p", joined_flags(F.col("qc_flags")).alias("flags"), "soc")


@query("soil_drop_flagged", f"WITH {_SOIL} SELECT n, count(*) AS rows_left FROM s WHERE {_FLAGS} = '' GROUP BY 1")
def soil_drop_flagged(spark, sf_dir):
    q = soil.quality_control(_soil(spark, sf_dir).select("n", "soc", "bulk_density", "coarse", "ph"), drop=True)
    return q.groupBy("n").agg(F.count(F.lit(1)).alias("rows_left"))


@query("soil_valid_horizons", "SELECT count(*) AS n FROM (SELECT CASE WHEN l_linenumber <> 4 THEN l_quantity END AS u, l_linenumber * 8 AS l FROM lineitem) WHERE u IS NOT NULL AND l > u")
def soil_valid_horizons(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("upper"), (F.col("l_linenumber") * 8).alias("lower"))
    return soil.valid_horizons(h).agg(F.count(F.lit(1)).alias("n"))


@query("soil_enforce_schema", "SELECT 'orders' AS source, o_custkey::VARCHAR AS profile_id, o_totalprice AS soc, NULL::DOUBLE AS ph, count(*) AS n FROM orders GROUP BY ALL")
def soil_enforce_schema(spark, sf_dir):
    from loamwork.sources.readers import enforce_schema

    raw = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("profile_id"), F.col("o_totalprice").cast("string").alias("soc"), F.lit(1).alias("extra"))
    return enforce_schema(raw, soil.HORIZON).groupBy("source", "profile_id", "soc", "ph").agg(F.count(F.lit(1)).alias("n"))


@query("soil_summary", f"WITH {_SOIL} SELECT count(*) AS n_rows, count(DISTINCT o) AS n_profiles, count(DISTINCT p % 25) AS n_countries, count(*) FILTER (WHERE {_FLAGS} <> '') AS n_flagged, round(min(soc), 4) AS lowest, round(max(soc), 4) AS highest, round(avg(CASE WHEN soc BETWEEN 0 AND 800 THEN soc END), 4) AS mean, round(stddev_samp(CASE WHEN soc BETWEEN 0 AND 800 THEN soc END), 4) AS sd FROM s WHERE soc <= 800")
def soil_summary(spark, sf_dir):
    s = _soil(spark, sf_dir).where("soc <= 800").select(F.col("o").alias("profile_id"), (F.col("p") % 25).alias("country"), "soc", "bulk_density", "coarse", "ph")
    return soil.summary(soil.quality_control(s), "soc")


# land cover ----------------------------------------------------------------------------------------------------------

_MAPPING = [("dw", "click", 0), ("dw", "view", 1), ("dw", "error", 4), ("esa", "click", 3), ("esa", "purchase", 5)]


@query("landcover_map_labels", "WITH m(source, native, class_id) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _MAPPING) + ") SELECT event_id, class_id FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'dw' ELSE 'esa' END AS source, event_type AS native FROM events) LEFT JOIN m USING (source, native)")
def landcover_map_labels(spark, sf_dir):
    m = spark.createDataFrame(_MAPPING, "source string, native string, class_id int")
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "dw").otherwise("esa").alias("source"), F.col("event_type").alias("native"))
    return landcover.map_labels(e, m).select("event_id", "class_id")


@query("landcover_code_names", "SELECT vec_id, CASE label WHEN 0 THEN 'water' WHEN 1 THEN 'trees' WHEN 2 THEN 'grass' WHEN 3 THEN 'crops' WHEN 4 THEN 'shrub' WHEN 5 THEN 'built' WHEN 6 THEN 'bare' END AS class FROM embeddings")
def landcover_code_names(spark, sf_dir):
    names = F.create_map(*(x for k, c in enumerate(landcover.CLASSES) for x in (F.lit(k), F.lit(c))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.try_element_at(names, F.col("label").cast("int")).alias("class"))


@query("landcover_dequantise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: sign(round(v::DOUBLE * 100)) * pow(round(v::DOUBLE * 100) / 127.5::DOUBLE, 2))), 6) AS total FROM embeddings")
def landcover_dequantise(spark, sf_dir):
    q = F.transform("embedding", lambda v: F.round(v.cast("double") * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(landcover.dequantise(q), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("landcover_mahalanobis")
def landcover_mahalanobis(spark, sf_dir):
    """Vectors near their class: under three median distances; checked against numpy in tests."""
    return landcover.mahalanobis_filter(table(spark, sf_dir, "embeddings"), "label", "embedding").select("vec_id", "label")


@query("landcover_fraction_map", "SELECT user_id, string_agg(event_type || '=' || printf('%.6f', f), ',' ORDER BY event_type) AS fractions FROM (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def landcover_fraction_map(spark, sf_dir):
    m = landcover.share_of_class(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    pairs = F.transform(F.map_entries("fractions"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])))
    return m.select("user_id", F.array_join(pairs, ",").alias("fractions"))


# zones ---------------------------------------------------------------------------------------------------------------

_ZONES = "z AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS a, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE p_retailprice END AS b, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0 END::DOUBLE AS c FROM part)"


def _zones(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("a"), F.when(k % 2 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("b"), F.when(k % 5 == 0, 1.0).otherwise(0.0).alias("c"))


@query("zone_touching", f"WITH {_ZONES}, t AS (SELECT p_partkey, list_filter([CASE WHEN a > 0 THEN 'a' END, CASE WHEN b > 0 THEN 'b' END, CASE WHEN c > 0 THEN 'c' END], lambda x: x IS NOT NULL) AS zs FROM z) SELECT p_partkey, len(zs)::INTEGER AS n_zones, len(zs) >= 2 AS is_shared, CASE len(zs) WHEN 0 THEN 'none' WHEN 1 THEN zs[1] ELSE 'Shared: ' || array_to_string(zs, ' + ') END AS label FROM t")
def zone_touching(spark, sf_dir):
    from loamwork.operators.zones import touching

    return touching(_zones(spark, sf_dir), ["a", "b", "c"]).select("p_partkey", "n_zones", "is_shared", "label")


@query("zone_cascade", f"WITH {_ZONES} SELECT p_partkey FROM z JOIN part USING (p_partkey) WHERE p_brand IN ('Brand#1', 'Brand#2') AND b > 0")
def zone_cascade(spark, sf_dir):
    from loamwork.operators.zones import cascade, touching

    z = touching(_zones(spark, sf_dir), ["a", "b", "c"]).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return cascade(z, {"p_brand": ["Brand#1", "Brand#2"]}, "b").select("p_partkey")


@query("zone_codes", "SELECT p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)")
def zone_codes(spark, sf_dir):
    from loamwork.operators.zones import codes

    return codes(table(spark, sf_dir, "part"), "p_type")


# text and identity ---------------------------------------------------------------------------------------------------

_NUM = "num AS (SELECT o_orderkey, '2' || lpad(((o_orderkey * 104729 + 7) % 100000000000)::VARCHAR, 11, '0') AS number FROM orders)"


def _verhoeff_sql() -> str:
    product, powers = "[" + ",".join(map(str, text.PRODUCT)) + "]", "[" + ",".join(map(str, text.POWERS)) + "]"
    c = "0"
    for k in range(12):
        c = f"{product}[{c} * 10 + {powers}[{10 * (k % 8)} + substr(reverse(number), {k + 1}, 1)::INTEGER + 1] + 1]"
    return c


@query("text_check_digit", f"WITH {_NUM} SELECT o_orderkey, {_verhoeff_sql()} = 0 AS valid FROM num")
def text_check_digit(spark, sf_dir):
    n = F.concat(F.lit("2"), F.lpad(((F.col("o_orderkey") * 104729 + 7) % 100000000000).cast("string"), 11, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.verhoeff_valid(n).alias("valid"))


_RE = dict((n, p) for n, p, _, _ in text.ENTITIES)


@query("text_entity_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{_RE[n]}', 1))::BIGINT AS {n.lower()}" for n in ("EMAIL", "DOB", "VOTER_ID", "PAN", "DRIVING_LICENCE")) + " FROM documents")
def text_entity_counts(spark, sf_dir):
    c = text.entity_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c[n].alias(n.lower()) for n in ("EMAIL", "DOB", "VOTER_ID", "PAN", "DRIVING_LICENCE")))


@query("text_entities")
def text_entities(spark, sf_dir):
    """All identifiers with their spans: one row each."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.entities(F.col("text"))).alias("e"))
    return e.select("doc_id", "e.*")


@query("text_document_type", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'the\\s+and') THEN 'AND' WHEN regexp_matches(lower(text), 'of\\s+the') THEN 'OF' ELSE 'UNKNOWN' END AS kind FROM conversations")
def text_document_type(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(low.rlike("the\\s+and"), "AND").when(low.rlike("of\\s+the"), "OF").otherwise("UNKNOWN").alias("kind"))


@query("text_first_label", "SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'accepted' WHEN b = 0 OR (a > 0 AND a <= b) THEN 'idiot' ELSE 'the' END AS label FROM (SELECT doc_id, instr(lower(text), 'idiot') AS a, instr(lower(text), 'the') AS b FROM documents)")
def text_first_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_label(F.col("text"), ["idiot", "the"], "accepted").alias("label"))


@query("text_digits", "SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS d, length(regexp_replace(props || event_id, '[^0-9]', '', 'g')) = 12 AND NOT left(regexp_replace(props || event_id, '[^0-9]', '', 'g'), 1) IN ('0', '1') AS ok FROM events")
def text_digits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.digits(F.col("props")).alias("d"), text.twelve_digits(F.concat("props", F.col("event_id").cast("string"))).alias("ok"))


@query("text_word_spans", "WITH w AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS w FROM conversations), s AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM w) SELECT conv_id, turn, count(*) AS n, max(e - 1)::BIGINT AS stop, sum(e - 1 - length(w))::BIGINT AS starts FROM s GROUP BY 1, 2")
def text_word_spans(spark, sf_dir):
    spans = documents.word_spans(F.split("text", " "))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", spans.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["start"])
    return c.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.element_at("s", -1)["stop"].cast("long").alias("stop"), total.alias("starts"))


@query("text_zone_names", "SELECT event_id, CASE event_type WHEN 'click' THEN '+05:30' WHEN 'view' THEN '-03:00' ELSE 'Asia/Kolkata' END AS tz FROM events")
def text_zone_names(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", "utc+0530").when(F.col("event_type") == "view", "UTC-3").otherwise(" Asia/Kolkata ")
    return table(spark, sf_dir, "events").select("event_id", text.zone(raw).alias("tz"))


@query("text_date_token", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE year(o_orderdate) >= 2000 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE year(o_orderdate) < 2000")
def text_date_token(spark, sf_dir):
    name = F.concat(F.lit("NDVI_"), F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_token(name).alias("d"))


@query("text_options", "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' ELSE 'x' END AS a, (user_id % 3)::VARCHAR AS b FROM events")
def text_options(spark, sf_dir):
    raw = F.concat(F.lit("a="), F.when(F.col("event_type") == "click", "c").otherwise("x"), F.lit(",b="), (F.col("user_id") % 3).cast("string"))
    o = table(spark, sf_dir, "events").select("event_id", text.options(raw).alias("o"))
    return o.select("event_id", F.col("o")["a"].alias("a"), F.col("o")["b"].alias("b"))


@query("text_mrz", "SELECT c_custkey, c_custkey % 4 = 0 AS is_mrz FROM customer")
def text_mrz(spark, sf_dir):
    line = F.when(F.col("c_custkey") % 4 == 0, F.rpad(F.concat(F.lit("P<IND"), F.upper("c_mktsegment"), F.lit("<<ANNA")), 44, "<")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.machine_readable(line).alias("is_mrz"))


@query("date_arithmetic", "SELECT o_orderkey, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE))::INTEGER AS days, CAST(o_orderdate AS DATE) - 28 AS sowing, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::INTEGER AS ordinal, (date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) // 12)::BIGINT AS period FROM orders")
def date_arithmetic(spark, sf_dir):
    d = F.to_date("o_orderdate")
    days = F.datediff(d, F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(d, F.lit("1998-01-01").cast("date")).alias("days"), F.date_sub(d, 28).alias("sowing"), F.unix_date(d).alias("ordinal"), F.call_function("div", days, F.lit(12)).alias("period"))


@query("date_coalesce", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN make_date(year(o_orderdate), 1, 1) END AS d FROM orders")
def date_coalesce(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", coalesce_date(raw).alias("d"))


@query("project_number", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events")
def project_number(spark, sf_dir):
    raw = F.when(F.col("event_id") % 8 == 0, "n/a").when(F.col("event_id") % 4 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", number(raw).alias("v"))


# documents and votes -------------------------------------------------------------------------------------------------

_VOTES = """v AS (SELECT l.doc_id, d.lang, d.source, unnest([
    {'detector': 'length', 'available': true, 'label': CASE WHEN n_chars < 700 THEN 'cut' ELSE 'accepted' END, 'importance': 1.0::DOUBLE, 'issue': CASE WHEN n_chars < 700 THEN 'cut_off' END, 'confidence': CASE WHEN n_chars < 400 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END},
    {'detector': 'quality', 'available': true, 'label': CASE WHEN quality = 0 THEN 'blur' ELSE 'accepted' END, 'importance': 1.25::DOUBLE, 'issue': CASE WHEN quality = 0 THEN 'blurry' END, 'confidence': 0.8::DOUBLE},
    {'detector': 'toxic', 'available': l.doc_id % 5 <> 0, 'label': CASE WHEN toxic = 1 THEN 'document' ELSE 'accepted' END, 'importance': 0.75::DOUBLE, 'issue': CASE WHEN toxic = 1 THEN 'not_document' END, 'confidence': 0.65::DOUBLE}]) AS v
  FROM labels l JOIN documents d USING (doc_id)),
  f AS (SELECT doc_id, lang, source, v.detector AS detector, v.available AS available, v.label AS label, v.importance AS importance, v.issue AS issue, v.confidence AS confidence FROM v)"""


def _votes(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    n, q, t = F.col("n_chars"), F.col("quality"), F.col("toxic")
    vote = lambda name, ok, bad, label, weight, issue, sure: F.struct(F.lit(name).alias("detector"), ok.alias("available"), F.when(bad, label).otherwise("accepted").alias("label"), F.lit(weight).alias("importance"), F.array_compact(F.array(F.when(bad, issue))).alias("issues"), sure.alias("confidence"))
    return both.select("doc_id", "lang", "source", F.array(
        vote("length", F.lit(True), n < 700, "cut", 1.0, "cut_off", F.when(n < 400, 0.9).otherwise(0.5)), vote("quality", F.lit(True), q == 0, "blur", 1.25, "blurry", F.lit(0.8)),
        vote("toxic", F.col("doc_id") % 5 != 0, t == 1, "document", 0.75, "not_document", F.lit(0.65))).alias("votes"))


@query("vote_tallies", f"WITH {_VOTES} SELECT doc_id, label, count(*) AS n, round(sum(importance), 4) AS weight FROM f WHERE available GROUP BY 1, 2")
def vote_tallies(spark, sf_dir):
    return votes.tallies(_votes(spark, sf_dir), ["doc_id"])


@query("vote_winner", f"WITH {_VOTES}, t AS (SELECT doc_id, label, sum(importance) AS w FROM f WHERE available GROUP BY 1, 2) SELECT doc_id, label AS winner FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, list_position(['document', 'blur', 'cut', 'accepted'], label)) = 1")
def vote_winner(spark, sf_dir):
    return votes.winner(votes.tallies(_votes(spark, sf_dir), ["doc_id"]), ["doc_id"])


_DEC = "d AS (SELECT doc_id, threshold, count(*) FILTER (WHERE available AND issue IS NOT NULL AND confidence >= threshold)::INTEGER AS n_strong, bool_or(available AND issue = 'not_document' AND confidence >= threshold) AS nd, bool_or(available AND issue = 'blurry' AND confidence >= threshold) AS bl, bool_or(available AND issue = 'cut_off' AND confidence >= threshold) AS co FROM f, th GROUP BY 1, 2)"


@query("vote_decision", f"WITH {_VOTES}, th(threshold) AS (VALUES (0.7::DOUBLE)), {_DEC} SELECT doc_id, n_strong = 0 AS accepted, n_strong, CASE WHEN nd THEN 'document' WHEN bl THEN 'blur' WHEN co THEN 'cut' ELSE 'accepted' END AS label FROM d")
def vote_decision(spark, sf_dir):
    d = votes.decision(F.col("votes"), 0.7)
    return _votes(spark, sf_dir).select("doc_id", *(d[n].alias(n) for n in ("accepted", "n_strong", "label")))


@query("vote_replay", f"WITH {_VOTES}, th(threshold) AS (VALUES (0.4::DOUBLE), (0.6::DOUBLE), (0.85::DOUBLE)), {_DEC} SELECT threshold, n_strong = 0 AS accepted, count(*) AS n FROM d GROUP BY 1, 2")
def vote_replay(spark, sf_dir):
    t = spark.createDataFrame([(0.4,), (0.6,), (0.85,)], "threshold double")
    return votes.replay(_votes(spark, sf_dir), t, ["doc_id"]).groupBy("threshold", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("vote_file_verdict", f"WITH {_VOTES}, th(threshold) AS (VALUES (0.7::DOUBLE)), {_DEC}, s AS (SELECT source, bool_and(n_strong = 0) AS accepted, bool_or(nd) AS nd, bool_or(bl) AS bl, bool_or(co) AS co FROM d JOIN documents USING (doc_id) GROUP BY 1) SELECT source, accepted, array_to_string(list_filter([CASE WHEN bl THEN 'blurry' END, CASE WHEN co THEN 'cut_off' END, CASE WHEN nd THEN 'not_document' END], lambda x: x IS NOT NULL), ',') AS issues FROM s")
def vote_file_verdict(spark, sf_dir):
    d = votes.decision(F.col("votes"), 0.7)
    pages = _votes(spark, sf_dir).select("source", *(d[n].alias(n) for n in ("accepted", "issues")))
    return votes.file_verdict(pages, ["source"]).select("source", "accepted", F.array_join("issues", ",").alias("issues"))


@query("vote_wide", f"WITH {_VOTES} SELECT doc_id, max(label) FILTER (WHERE detector = 'length') AS length_label, max(confidence) FILTER (WHERE detector = 'length') AS length_confidence, max(label) FILTER (WHERE detector = 'toxic') AS toxic_label, max(confidence) FILTER (WHERE detector = 'toxic') AS toxic_confidence FROM f GROUP BY 1")
def vote_wide(spark, sf_dir):
    return votes.wide(_votes(spark, sf_dir), ["doc_id"], ["length", "toxic"])


@query("document_manual_label", "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'document' WHEN quality = 0 THEN 'blur' WHEN toxic = 1 THEN 'cut' ELSE 'accepted' END AS label FROM labels")
def document_manual_label(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "document").when(F.col("quality") == 0, "blur").when(F.col("toxic") == 1, "cut").otherwise("accepted").alias("label"))


@query("document_path_override", "SELECT page_id, regexp_matches(url, '(^|/)is_blur/min(/|$)') OR page_id % 7 = 0 AS overridden FROM pages")
def document_path_override(spark, sf_dir):
    path = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("/is_blur/min/a.png"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", documents.has_components(path, ["is_blur", "min"]).alias("overridden"))


_FEAT = "x AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_extendedprice / 1000 AS ten, l_quantity * 2 AS patch, l_discount * 1000 AS ink_ten, l_tax * 800 AS contrast, l_quantity AS gray, l_discount * 10 AS page_ratio, l_tax / 2 AS ink, l_discount / 2 AS edge, l_extendedprice / 600 AS sat FROM lineitem)"


def _features(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), (c("l_extendedprice") / 1000).alias("ten"), (c("l_quantity") * 2).alias("patch"), (c("l_discount") * 1000).alias("ink_ten"), (c("l_tax") * 800).alias("contrast"),
        c("l_quantity").alias("gray"), (c("l_discount") * 10).alias("page_ratio"), (c("l_tax") / 2).alias("ink"), (c("l_discount") / 2).alias("edge"), (c("l_extendedprice") / 600).alias("sat"),
    )


_BELOW = "(CASE WHEN {v} >= {t} THEN 0 ELSE least(1.0::DOUBLE, ({t} - {v}) / {t}) END)"
_RANGE = "(CASE WHEN {v} < {a} OR {v} > {b} THEN 0 WHEN {v} <= {m} THEN ({v} - {a}) / ({m} - {a}) ELSE ({b} - {v}) / ({b} - {m}) END)"


@query(
    "document_blur",
    f"WITH {_FEAT} SELECT o, n, p, ten < 40 OR (patch < 50 AND ink_ten < 80) AS is_blurry, ten >= 40 AND patch < 50 AND ink_ten < 80 AS watermark, round(CASE WHEN ten >= 40 AND patch < 50 AND ink_ten < 80 THEN greatest({_BELOW.format(v='patch', t='50.0::DOUBLE')}, {_BELOW.format(v='ink_ten', t='80.0::DOUBLE')}) ELSE {_BELOW.format(v='ten', t='40.0::DOUBLE')} END, 8) AS confidence FROM x",
)
def document_blur(spark, sf_dir):
    b = documents.blur(F.col("ten"), F.col("patch"), F.col("ink_ten"), 40.0, 50.0)
    return _features(spark, sf_dir).select("o", "n", "p", b["is_blurry"].alias("is_blurry"), b["watermark"].alias("watermark"), F.round(b["confidence"], 8).alias("confidence"))


_INKS, _EDGES, _LOWS = _RANGE.format(v="ink", a=0.003, b=0.28, m=0.045), _RANGE.format(v="edge", a=0.004, b=0.22, m=0.055), "(1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, sat - 75) / 95))"
_DOCC = f"greatest(0.34 * least(1.0::DOUBLE, page_ratio / 0.55::DOUBLE) + 0.24 * 0.5 + 0.18 * {_INKS} + 0.14 * {_EDGES} + 0.10 * {_LOWS}, 0.78 * (0.55 * {_INKS} + 0.30 * {_EDGES} + 0.15 * {_LOWS}))"


@query("document_page", f"WITH {_FEAT}, c AS (SELECT *, round({_DOCC}, 7) AS cf FROM x) SELECT o, n, p, round(cf, 7) AS confidence, NOT sat > 150 AND (cf >= 0.55 OR (ink >= 0.006 AND edge >= 0.008 AND cf >= 0.4125)) AS is_document FROM c")
def document_page(spark, sf_dir):
    c = documents.page_confidence(F.col("page_ratio"), F.lit(0.5), F.col("ink"), F.col("edge"), F.col("sat"))
    x = _features(spark, sf_dir).withColumn("cf", F.round(c, 7))
    return x.select("o", "n", "p", F.round("cf", 7).alias("confidence"), documents.is_document(F.col("cf"), F.col("ink"), F.col("edge"), F.col("sat"), 0.55, 0.006, 0.008, 150.0).alias("is_document"))


@query("document_cut", f"WITH {_FEAT}, c AS (SELECT *, n % 2 = 0 AS touches, n % 3 = 0 AS content, ink > 0.02 AND (NOT (n % 2 = 0 AND page_ratio >= 0.95) OR n % 3 = 0) AS bad FROM x) SELECT o, n, p, round(least(1.0::DOUBLE, CASE WHEN touches AND page_ratio < 0.93 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN bad THEN least(0.55::DOUBLE, ink / 0.02::DOUBLE * 0.25::DOUBLE) ELSE 0 END), 8) AS confidence FROM c")
def document_cut(spark, sf_dir):
    c = documents.cut_confidence(F.col("n") % 2 == 0, F.col("n") % 3 == 0, F.col("page_ratio"), F.col("ink"), 0.02)
    return _features(spark, sf_dir).select("o", "n", "p", F.round(c, 8).alias("confidence"))


@query("document_clear", f"WITH {_FEAT}, c AS (SELECT *, ten < 40 AS blurry, contrast < 30 AND gray < 25 AS low FROM x), s AS (SELECT *, greatest({_BELOW.format(v='contrast', t='30.0::DOUBLE')}, {_BELOW.format(v='gray', t='25.0::DOUBLE')}, CASE WHEN contrast < 19.5 THEN 0.75::DOUBLE ELSE 0 END) AS rs FROM c) SELECT o, n, p, NOT blurry AND NOT low AS is_clear, low AND NOT blurry AS pixelated, round(greatest(0, least(CASE WHEN blurry THEN 0.25::DOUBLE ELSE 1 END, CASE WHEN low THEN 1 - rs ELSE 1 END)), 8) AS confidence FROM s")
def document_clear(spark, sf_dir):
    c = documents.clear(F.col("ten") < 40, F.col("contrast"), F.col("gray"), F.lit(True), 30.0, 25.0)
    return _features(spark, sf_dir).select("o", "n", "p", c["is_clear"].alias("is_clear"), c["pixelated"].alias("pixelated"), F.round(c["confidence"], 8).alias("confidence"))


@query("document_nested_scores", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'error' WHEN quality = 0 THEN 'blur' ELSE 'accepted' END AS label, round(n_chars / 33047.0::DOUBLE, 3) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def document_nested_scores(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    nested = both.select("doc_id", F.when(F.col("quality").isNotNull(), F.struct(F.struct((F.col("quality") == 0).alias("is_blurry")).alias("blur"))).alias("result"), F.struct((F.col("n_chars") / 33047.0).alias("size")).alias("scores"))
    return nested.select("doc_id", F.when(F.col("result").isNull(), "error").when(F.col("result.blur.is_blurry"), "blur").otherwise("accepted").alias("label"), F.round("scores.size", 3).alias("score"))


@query("words_confidence", "SELECT user_id, round(avg(value / 500) FILTER (WHERE value / 500 >= 0.3), 6) AS mean_conf, bool_or(event_type = 'purchase') AS has_id FROM events GROUP BY 1")
def words_confidence(spark, sf_dir):
    c = F.col("value") / 500
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(F.when(c >= 0.3, c)), 6).alias("mean_conf"), F.bool_or(F.col("event_type") == "purchase").alias("has_id"))


@query("words_backend_choice", "WITH a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND value >= 30) AS n1, coalesce(avg(value / 200) FILTER (WHERE event_type = 'click'), 0) AS m1, count(*) FILTER (WHERE event_type = 'view' AND value >= 30) AS n2 FROM events GROUP BY 1) SELECT user_id, CASE WHEN (n1 < 5 OR m1 < 0.6) AND n2 > n1 THEN 'fallback' ELSE 'first' END AS backend FROM a")
def words_backend_choice(spark, sf_dir):
    e, click = table(spark, sf_dir, "events"), F.col("event_type") == "click"
    a = e.groupBy("user_id").agg(F.count_if(click & (F.col("value") >= 30)).alias("n1"), F.coalesce(F.avg(F.when(click, F.col("value") / 200)), F.lit(0.0)).alias("m1"), F.count_if((F.col("event_type") == "view") & (F.col("value") >= 30)).alias("n2"))
    return a.select("user_id", documents.backend(F.col("n1"), F.col("m1"), F.col("n2")).alias("backend"))


@query("words_token_match", "WITH n AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS t FROM part) SELECT DISTINCT c_custkey FROM (SELECT c_custkey, lower(unnest(string_split(c_mktsegment || ' ' || CASE c_custkey % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'zzz' ELSE 'of' END, ' '))) AS w FROM customer) JOIN n ON w = t WHERE length(t) >= 3")
def words_token_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    words = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.split(F.concat_ws(" ", "c_mktsegment", F.element_at(F.array(F.lit("Red"), F.lit("zzz"), F.lit("of")), (F.col("c_custkey") % 3 + 1).cast("int"))), " ")).alias("text"))
    return documents.words_of_names(words, names).select("c_custkey").distinct()


@query("words_box_union", "SELECT l_orderkey, min(l_linenumber * 10) AS x, min(l_quantity::INTEGER) AS y, (max(l_linenumber * 10 + l_partkey % 50) - min(l_linenumber * 10))::BIGINT AS w, max(l_quantity::INTEGER + 12) - min(l_quantity::INTEGER) AS h FROM lineitem GROUP BY 1")
def words_box_union(spark, sf_dir):
    b = F.struct((F.col("l_linenumber") * 10).alias("x"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_partkey") % 50).alias("w"), F.lit(12).alias("h"))
    u = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(geometry.union_box(F.collect_list(b)).alias("u"))
    return u.select("l_orderkey", F.col("u.x").alias("x"), F.col("u.y").alias("y"), F.col("u.w").alias("w"), F.col("u.h").alias("h"))


@query("words_box_overlap", "WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_linenumber * 10.0::DOUBLE AS x, l_quantity AS y, 20.0::DOUBLE AS w, 15.0::DOUBLE AS h FROM lineitem) SELECT a.o, a.n AS n1, a.p AS p1, b.n AS n2, b.p AS p2, round(i / (a.w * a.h + b.w * b.h - i), 6) AS iou FROM (SELECT a, b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i FROM b a JOIN b ON a.o = b.o AND a.n < b.n)")
def words_box_overlap(spark, sf_dir):
    side = lambda k: table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias(f"n{k}"), F.col("l_partkey").alias(f"p{k}"), (F.col("l_linenumber") * 10.0).alias(f"x{k}"), F.col("l_quantity").alias(f"y{k}"))
    size = (F.lit(20.0), F.lit(15.0))
    pairs = side(1).join(side(2), "o").where("n1 < n2")
    return pairs.select("o", "n1", "p1", "n2", "p2", F.round(geometry.overlap_ratio((F.col("x1"), F.col("y1"), *size), (F.col("x2"), F.col("y2"), *size)), 6).alias("iou"))


@query("words_box_dedup")
def words_box_dedup(spark, sf_dir):
    """Greedy removal of boxes that overlap one kept before; checked against a plain loop in tests."""
    b = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), (F.col("l_linenumber") * 10.0).alias("x"), F.col("l_quantity").alias("y"), F.lit(20.0).alias("w"), F.lit(15.0).alias("h"))
    boxes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(b)).alias("boxes"))
    return boxes.select("l_orderkey", F.size(geometry.keep_separate(F.col("boxes"))).alias("n_kept"))


@query("words_nested_confidence", "SELECT conv_id, round(avg(length(text)), 4) AS mean_conf, count(*) AS n FROM conversations GROUP BY 1")
def words_nested_confidence(spark, sf_dir):
    """Confidences of a tree of pages, blocks and words as one flat array."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.collect_list(F.struct(F.length("text").alias("conf"))).alias("words"))
    tree = turns.groupBy("conv_id").agg(F.collect_list(F.struct("words")).alias("blocks"))
    flat = F.flatten(F.transform("blocks", lambda b: F.transform(b["words"], lambda w: w["conf"])))
    return tree.select("conv_id", F.round(F.aggregate(flat, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(flat), 4).alias("mean_conf"), F.size(flat).cast("long").alias("n"))


@query("words_list_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, bool_or(event_type = 'error') AS has_error FROM events GROUP BY 1")
def words_list_union(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"), F.array_contains(kinds, "error").alias("has_error"))


@query("map_lookup_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 1.25::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM events")
def map_lookup_default(spark, sf_dir):
    weights = F.map_concat(F.create_map(F.lit("click"), F.lit(1.0)), F.create_map(F.lit("view"), F.lit(1.25)))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(weights, F.col("event_type")), F.lit(0.5)).alias("weight"))


@query("json_fields", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("json_daily_arrays", "SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS tmin, max(value) AS tmax, round((min(value) + max(value)) / 2, 6) AS tmean FROM events GROUP BY 1, 2")
def json_daily_arrays(spark, sf_dir):
    """Daily arrays in JSON, back to rows."""
    from loamwork.sources.readers import weather_days

    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("t")).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    arrays = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "a", "b"))).alias("r"))
    js = arrays.select("user_id", F.to_json(F.struct(F.struct(F.col("r.t").alias("time"), F.col("r.a").alias("temperature_2m_min"), F.col("r.b").alias("temperature_2m_max")).alias("daily"))).alias("value"))
    return weather_days(js, ["user_id"]).withColumn("tmean", F.round("tmean", 6))


@query("json_nested_layers", "SELECT event_id, round((user_id + 0.5) / 10, 6) AS sg_clay, round(value / 10, 6) AS sg_sand FROM events")
def json_nested_layers(spark, sf_dir):
    """Layers of a nested payload as columns sg_<name> = mean / 10."""
    e = table(spark, sf_dir, "events")
    layer = lambda n, v: F.struct(F.lit(n).alias("name"), F.array(F.struct(F.struct(v.cast("double").alias("mean")).alias("values"))).alias("depths"))
    js = e.select("event_id", F.to_json(F.struct(F.array(layer("clay", F.col("user_id") + 0.5), layer("sand", F.col("value"))).alias("layers"))).alias("js"))
    shape = "struct<layers:array<struct<name:string,depths:array<struct<values:struct<mean:double>>>>>>"
    rows = js.select("event_id", F.explode(F.from_json("js", shape)["layers"]).alias("l")).select("event_id", F.concat(F.lit("sg_"), "l.name").alias("n"), (F.element_at("l.depths", 1)["values"]["mean"] / 10).alias("v"))
    return rows.groupBy("event_id").pivot("n", ["sg_clay", "sg_sand"]).agg(F.round(F.first("v"), 6))


# numbers, volumes, places --------------------------------------------------------------------------------------------

@query("math_decibels", "SELECT event_id, round(10 * log10(greatest(value / 1000, 1e-6::DOUBLE)), 6) AS db, round(pow(10.0::DOUBLE, value / 100 / 10), 6) AS linear, round(value * value / (CASE WHEN user_id = 0 THEN NULL ELSE user_id END * user_id)::DOUBLE, 6) AS beta, CASE WHEN user_id % 2 = 1 AND value > 1 THEN round(10 * log10(value * value) - 83, 6) END AS gamma FROM events")
def math_decibels(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    dn = F.when(v > 1, v).otherwise(0.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.to_db(v / 1000), 6).alias("db"), F.round(numeric.from_db(v / 100), 6).alias("linear"), F.round(numeric.beta_nought(v, u.cast("double")), 6).alias("beta"), F.round(numeric.gamma_nought(dn, u % 2), 6).alias("gamma"))


@query("math_log1p", "SELECT p_partkey, round(ln(1 + p_retailprice), 8) AS y, round(exp(ln(1 + p_retailprice)) - 1, 4) AS back FROM part")
def math_log1p(spark, sf_dir):
    y = F.log1p("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(y, 8).alias("y"), F.round(F.expm1(y), 4).alias("back"))


@query("math_ramp", "SELECT event_id, round(least(greatest((value - 20) / 80, 0), 1), 6) AS score FROM events")
def math_ramp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.ramp(F.col("value"), 20.0, 100.0), 6).alias("score"))


_KILN = "k AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity + 50 AS kiln_major, l_quantity + 40 AS kiln_minor, l_quantity + 30 AS char_major, l_quantity + 20 AS char_minor, l_extendedprice / 1000 AS distance, l_tax + 1 AS scale, l_discount * 1000 - 20 AS formula FROM lineitem)"


def _kiln(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), (c("l_quantity") + 50).alias("kiln_major"), (c("l_quantity") + 40).alias("kiln_minor"), (c("l_quantity") + 30).alias("char_major"), (c("l_quantity") + 20).alias("char_minor"),
        (c("l_extendedprice") / 1000).alias("distance"), (c("l_tax") + 1).alias("scale"), (c("l_discount") * 1000 - 20).alias("formula"),
    )


@query(
    "volume_features",
    f"""WITH {_KILN}, m AS (SELECT min(formula) AS lo FROM k) SELECT o, n, p, round(pi() / 4 * (char_major / scale) * (char_minor / scale), 4) AS char_area, round(char_major / (kiln_major + 1e-9::DOUBLE), 6) AS fill_major,
    round(pi() / 6 * (char_major / scale) * pow(char_minor / scale, 2), 3) AS spheroid, round(ln(1 + distance), 6) AS log_distance, round(sqrt((distance / scale) / (kiln_major / scale + 1e-9::DOUBLE)), 6) AS sqrt_distance_norm, round(ln(formula - lo + 1), 6) AS log_formula FROM k, m""",
)
def volume_features(spark, sf_dir):
    v = volume.engineered(_kiln(spark, sf_dir))
    return v.select("o", "n", "p", *(F.round(c, k).alias(c) for c, k in (("char_area", 4), ("fill_major", 6), ("spheroid", 3), ("log_distance", 6), ("sqrt_distance_norm", 6), ("log_formula", 6))))


@query("volume_shrinkage", f"WITH {_KILN} SELECT o, n, p, round(kiln_major / (kiln_minor + 1e-9::DOUBLE), 6) AS kiln_sphericity, round(char_major / (char_minor + 1e-9::DOUBLE), 6) AS char_sphericity, round(((kiln_major - char_major) / (kiln_major + 1e-9::DOUBLE) + (kiln_minor - char_minor) / (kiln_minor + 1e-9::DOUBLE)) / 2, 6) AS shrinkage_mean FROM k")
def volume_shrinkage(spark, sf_dir):
    s = volume.shrinkage()
    return _kiln(spark, sf_dir).select("o", "n", "p", *(F.round(s[c], 6).alias(c) for c in ("kiln_sphericity", "char_sphericity", "shrinkage_mean")))


@query("volume_leaderboard", "WITH m(model, train, test, cv) AS (VALUES ('ridge', 30.0::DOUBLE, 37.2::DOUBLE, 39.3::DOUBLE), ('forest', 15.0::DOUBLE, 41.0::DOUBLE, 44.0::DOUBLE), ('mean', 78.0::DOUBLE, 80.0::DOUBLE, 79.0::DOUBLE)) SELECT model, row_number() OVER (ORDER BY test, model) AS place, CASE WHEN train / test < 0.65 THEN 'overfit' WHEN cv > 70 THEN 'underfit' ELSE 'ok' END AS status, test <= 30 AS on_target FROM m")
def volume_leaderboard(spark, sf_dir):
    m = spark.createDataFrame([("ridge", 30.0, 37.2, 39.3), ("forest", 15.0, 41.0, 44.0), ("mean", 78.0, 80.0, 79.0)], "model string, train double, test double, cv double")
    return volume.leaderboard(m, target=30.0)


@query("geo_centroid", "SELECT p_partkey, round(w / 2, 6) AS x, round(h / 2, 6) AS y, round(w * h, 4) AS area FROM (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice AS h FROM part)")
def geo_centroid(spark, sf_dir):
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(w, F.lit(0.0)), point(w, h), point(F.lit(0.0), h))
    r = table(spark, sf_dir, "part").select("p_partkey", geometry.centroid(ring).alias("c"), geometry.signed_area(ring).alias("a"))
    return r.select("p_partkey", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("a", 4).alias("area"))


@query("geo_tiles", "SELECT c_custkey, len(list_distinct([floor(lat / 3), floor((lat + 2) / 3)])) * len(list_distinct([floor(lon / 3), floor((lon + 2) / 3)])) AS n, printf('%s%02d%s%03d', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(floor(lat / 3) * 3)::INTEGER, 'E', (floor(lon / 3) * 3)::INTEGER) AS first_tile FROM (SELECT c_custkey, (c_nationkey - 10)::DOUBLE AS lat, (c_custkey % 170)::DOUBLE AS lon FROM customer)")
def geo_tiles(spark, sf_dir):
    lat, lon = (F.col("c_nationkey") - 10).cast("double"), (F.col("c_custkey") % 170).cast("double")
    t = table(spark, sf_dir, "customer").select("c_custkey", geometry.tile_names(lon, lat, lon + 2, lat + 2).alias("t"))
    return t.select("c_custkey", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first_tile"))


@query("geo_pixel_area", "SELECT c_custkey, round(pow(0.01::DOUBLE * 111320, 2) * cos(radians(c_nationkey)) / 10000, 6) AS ha FROM customer")
def geo_pixel_area(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(geometry.pixel_hectares(F.col("c_nationkey"), 0.01), 6).alias("ha"))


@query("geo_extent", f"SELECT c_custkey, round(2 * 111320 / 1000.0::DOUBLE * cos(radians((2 * c_nationkey + 1) / 2.0::DOUBLE)), 4) AS wide, round({111320 / 1000}::DOUBLE, 4) AS high, ceil(2 * 111320 / 1000.0::DOUBLE * cos(radians((2 * c_nationkey + 1) / 2.0::DOUBLE)) / 10) > 1 AS split FROM customer")
def geo_extent(spark, sf_dir):
    n = F.col("c_nationkey").cast("double")
    w, h = geometry.extent_km(F.lit(0.0), n, F.lit(2.0), n + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(w, 4).alias("wide"), F.round(h, 4).alias("high"), (w > 10).alias("split"))


@query("source_cache_key", "SELECT c_custkey, left(sha256('{\"lat\":' || c_nationkey || ',\"lon\":' || c_custkey || '}'), 16) AS k FROM customer")
def source_cache_key(spark, sf_dir):
    from loamwork.sources.readers import cache_key

    return table(spark, sf_dir, "customer").select("c_custkey", cache_key(F.col("c_nationkey").alias("lat"), F.col("c_custkey").alias("lon")).alias("k"))


@query("source_depth_codes", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS upper, CASE o_orderkey % 4 WHEN 0 THEN 20.0::DOUBLE WHEN 1 THEN 50.0::DOUBLE WHEN 2 THEN 20.0::DOUBLE END AS lower FROM orders")
def source_depth_codes(spark, sf_dir):
    from loamwork.sources.readers import depth_code

    code = F.element_at(F.array(*map(F.lit, ("0-20", " SUB", "Top", "deep"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    upper, lower = depth_code(code)
    return table(spark, sf_dir, "orders").select("o_orderkey", upper.alias("upper"), lower.alias("lower"))


@query("source_month_parts", "WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 100)::INTEGER AS b FROM orders) SELECT o_orderkey, greatest(x::DATE, a) AS first, least(last_day(x::DATE), b) AS last FROM (SELECT *, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS x FROM m)")
def source_month_parts(spark, sf_dir):
    from loamwork.sources.readers import month_parts

    a = F.to_date("o_orderdate")
    m = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(month_parts(a, F.date_add(a, (F.col("o_orderkey") % 100).cast("int")))).alias("p"))
    return m.select("o_orderkey", "p.first", "p.last")


@query("source_weather_cells", "WITH p AS (SELECT c_custkey, round_even(c_acctbal / 1000, 1) AS lat, round_even(c_nationkey / 7.0::DOUBLE, 1) AS lon FROM customer) SELECT c_custkey, round(lat * 2 + lon, 6) AS tmean FROM p")
def source_weather_cells(spark, sf_dir):
    from loamwork.sources.readers import share_by_cell

    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("lat"), (F.col("c_nationkey") / 7.0).alias("lon"))
    return share_by_cell(p, lambda cells: cells.withColumn("tmean", F.round(F.col("_lat") * 2 + F.col("_lon"), 6))).select("c_custkey", "tmean")


@query("source_daily_temperature", "WITH k AS (SELECT user_id, avg(v) > 150 AS k FROM (SELECT user_id, ts, CASE WHEN user_id % 2 = 0 THEN value / 10 + 280 ELSE value / 10 END AS v FROM events) GROUP BY 1) SELECT user_id, CAST(ts AS DATE) AS day, round(min(value / 10 + CASE WHEN user_id % 2 = 0 THEN 280 - 273.15::DOUBLE ELSE 0 END), 4) AS tmin, round(max(value / 10 + CASE WHEN user_id % 2 = 0 THEN 280 - 273.15::DOUBLE ELSE 0 END), 4) AS tmax FROM events GROUP BY 1, 2")
def source_daily_temperature(spark, sf_dir):
    from loamwork.sources.readers import daily_temperature

    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("user_id") % 2 == 0, F.col("value") / 10 + 280).otherwise(F.col("value") / 10).alias("v"))
    return daily_temperature(e, ["user_id"], "ts", "v").select("user_id", "day", F.round("tmin", 4).alias("tmin"), F.round("tmax", 4).alias("tmax"))


@query("source_layouts", "SELECT entity_id, obs_date, signal, value FROM (SELECT c_custkey::VARCHAR AS entity_id, DATE '2024-01-05' AS obs_date, 'NDVI' AS signal, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, DATE '2024-01-17', 'NDVI', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey::DOUBLE END FROM customer)")
def source_layouts(spark, sf_dir):
    from loamwork.sources.readers import to_observations

    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("farm"), F.col("c_acctbal").alias("NDVI_20240105"), F.when(F.col("c_custkey") % 3 == 0, -9999).otherwise(F.col("c_nationkey")).alias("NDVI_20240117"))
    return to_observations(wide, "farm")


@query("source_tile_index", "SELECT l_orderkey, year(l_shipdate)::INTEGER AS y, l_partkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey, year(l_shipdate) ORDER BY l_partkey, l_suppkey, l_linenumber) = 1")
def source_tile_index(spark, sf_dir):
    from loamwork.operators.joins import first_of_each

    hit = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20)).withColumn("y", F.year("l_shipdate"))
    return first_of_each(hit, ["l_orderkey", "y"], ["l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "y", "l_partkey")


@query("source_scenes", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_custkey % 100 <= 40 AND o_custkey % 100 + 5 >= 10 AND o_orderstatus = 'O'")
def source_scenes(spark, sf_dir):
    from loamwork.sources.readers import scenes

    x = F.col("o_custkey") % 100
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), F.col("o_orderstatus").alias("mode"), x.alias("min_lon"), (x + 5).alias("max_lon"), F.lit(0).alias("min_lat"), F.lit(1).alias("max_lat"))
    return scenes(c, (10, 0, 40, 1), "1997-01-01", "1998-01-01", "O").select("id")


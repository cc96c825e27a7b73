"""Sources and sinks, round trips through files in the shared folder. SRC-01..08, 10, 13, 16, 17, 22..27, 29; SNK-01..04, 07, 08; PRJ-01, 11, 26; AGG-39."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamwork.operators import soil
from loamwork.plans.base import table
from loamwork.plans.registry import query
from loamwork.sources import readers, sinks
from loamwork.sources.scratch import path


@query("source_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark, sf_dir):
    at = path(spark, "csv")
    table(spark, sf_dir, "nation").write.option("header", True).csv(at)
    return readers.read_table(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("source_tsv_pair", "SELECT l_orderkey AS profile, l_linenumber AS layer, l_quantity AS depth, o_orderstatus AS country FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON l_orderkey = o_orderkey")
def source_tsv_pair(spark, sf_dir):
    """Profiles and layers as two tab-separated tables, joined on the left."""
    a, b = path(spark, "layers"), path(spark, "profiles")
    table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("depth")).write.option("header", True).option("sep", "\t").csv(a)
    table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("profile"), F.col("o_orderstatus").alias("country")).write.option("header", True).option("sep", "\t").csv(b)
    layers = readers.read_table(spark, a, "profile long, layer int, depth double", "\t")
    return readers.profiles_with_layers(layers, readers.read_table(spark, b, "profile long, country string", "\t"), "profile")


@query("source_many_files", "SELECT p_partkey::VARCHAR AS profile_id, 'wave' || p_size % 3 AS source, p_retailprice AS soc, CASE WHEN p_size % 3 = 1 THEN p_size::DOUBLE END AS clay FROM part")
def source_many_files(spark, sf_dir):
    """Waves with their own column names, each brought to one schema, then pooled."""
    part, frames = table(spark, sf_dir, "part"), []
    for k, (key, value) in enumerate((("POINTID", "OC"), ("Point_ID", "Organic"), ("id", "oc"))):
        at = path(spark, f"wave{k}")
        extra = [F.col("p_size").alias("Clay")] if k == 1 else []
        part.where(f"p_size % 3 = {k}").select(F.col("p_partkey").alias(key), F.col("p_retailprice").alias(value), *extra).write.option("header", True).csv(at)
        raw = readers.read_table(spark, at)
        named = raw.select(readers.first_column(raw, ["POINTID", "Point_ID", "id"]).alias("profile_id"), readers.first_column(raw, ["OC", "Organic", "oc"]).alias("soc"), readers.first_column(raw, ["Clay", "clay"]).alias("clay"), F.lit(f"wave{k}").alias("source"), F.lit(0.0).alias("upper"), F.lit(20.0).alias("lower"))
        frames.append(readers.enforce_schema(named, soil.HORIZON))
    return readers.union_sources(frames).select("profile_id", "source", "soc", "clay")


@query("source_rename_scale", "SELECT l_orderkey::VARCHAR AS profile_id, l_linenumber, l_partkey, l_discount * 10 AS soc FROM lineitem")
def source_rename_scale(spark, sf_dir):
    """Renaming by a dictionary where the columns exist, percent to g/kg once."""
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("profile_name"), "l_linenumber", "l_partkey", F.col("l_discount").alias("soc (percent)"))
    names = {"profile_name": "profile_id", "soc (percent)": "soc", "absent": "other"}
    return raw.withColumnsRenamed(names).withColumn("soc", soil.soc_g_per_kg(F.col("soc"), F.lit("pct")))


@query("source_registry", "SELECT 'customer' AS source, c_custkey::VARCHAR AS profile_id, c_acctbal AS soc FROM customer UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_acctbal * 10 FROM supplier")
def source_registry(spark, sf_dir):
    """Registered readers with their units; one that fails is left out."""
    readers.register("customer")(lambda s, sf: table(s, sf, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_acctbal").alias("soc")))
    readers.register("supplier", soc_unit="pct")(lambda s, sf: table(s, sf, "supplier").select(F.col("s_suppkey").alias("profile_id"), F.col("s_acctbal").alias("soc")))
    readers.register("absent")(lambda s, sf: table(s, sf, "no_such_table"))
    df = readers.collect_sources(spark, ["customer", "absent", "supplier"], soil.HORIZON, sf=sf_dir)
    unit = F.create_map(*(F.lit(x) for n in ("customer", "supplier") for x in (n, readers.REGISTRY[n][1]["soc_unit"])))
    return df.select("source", "profile_id", soil.soc_g_per_kg(F.col("soc"), F.element_at(unit, F.col("source"))).alias("soc"))


@query("source_geojson", "SELECT c_custkey, c_nationkey::DOUBLE AS min_lon, (c_custkey % 60)::DOUBLE AS min_lat, c_nationkey + 0.5::DOUBLE AS max_lon, c_custkey % 60 + 0.25::DOUBLE AS max_lat FROM customer")
def source_geojson(spark, sf_dir):
    x, y = F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 60).cast("double")
    ring = F.array(F.array(F.array(x, y), F.array(x + 0.5, y), F.array(x + 0.5, y + 0.25), F.array(x, y)))
    feature = F.struct(F.struct(F.col("c_custkey").cast("string").alias("id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    text = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value"))
    g = readers.geojson_features(text)
    return g.select(F.col("properties")["id"].cast("long").alias("c_custkey"), "min_lon", "min_lat", "max_lon", "max_lat")


@query("source_signals", "SELECT event_id, CASE event_type WHEN 'click' THEN 'NDVI' WHEN 'view' THEN 'VH' ELSE 'VALUE' END AS signal FROM events")
def source_signals(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "s2_NDVI_mean").when(F.col("event_type") == "view", "band1").otherwise("x")
    attribute = F.when(F.col("event_type") == "view", "Sentinel-1 VH backscatter")
    return table(spark, sf_dir, "events").select("event_id", readers.signal_of(name, attribute).alias("signal"))


@query("source_curve", "SELECT user_id::VARCHAR AS entity_id, CAST(ts AS DATE) AS obs_date, max(value) AS value FROM events WHERE event_type = CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END GROUP BY 1, 2")
def source_curve(spark, sf_dir):
    """One signal's curve, from the generic signal where an entity lacks it."""
    keep = (F.col("user_id") % 2 == 0) | (F.col("event_type") != "click")
    signal = F.when(F.col("event_type") == "click", "NDVI").when(F.col("event_type") == "view", "VALUE").otherwise("OTHER")
    o = table(spark, sf_dir, "events").where(keep).groupBy(F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("obs_date"), signal.alias("signal")).agg(F.max("value").alias("value"))
    clicks = o.where("signal = 'NDVI'").select("entity_id").distinct()
    both = o.join(clicks.withColumn("_c", F.lit(True)), "entity_id", "left").where("cast(entity_id as int) % 2 = 1 or _c").drop("_c")
    return readers.curve(both, "NDVI")


@query("source_labelled_paths", "SELECT DISTINCT '/data/' || CASE doc_id % 3 WHEN 0 THEN 'is_blur' WHEN 1 THEN 'clear' ELSE 'misc' END || '/' || doc_id % 200 || '.png' AS path, CASE doc_id % 3 WHEN 0 THEN 'blur' ELSE 'accepted' END AS label FROM labels WHERE doc_id % 3 < 2")
def source_labelled_paths(spark, sf_dir):
    folder = F.element_at(F.array(F.lit("is_blur"), F.lit("clear"), F.lit("misc")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("/data/"), folder, F.lit("/"), (F.col("doc_id") % 200).cast("string"), F.lit(".png")).alias("path"))
    return readers.labelled_files(files, {"is_blur": "blur", "clear": "accepted"})


@query("source_newest_run", "SELECT max_by('run-' || o_orderkey, (o_orderdate, 'run-' || o_orderkey)) AS path FROM orders WHERE ('run-' || o_orderkey) LIKE '%7%'")
def source_newest_run(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return readers.newest(f, "7")


@query("source_ocr_table", "SELECT conv_id AS page, turn, role AS text, turn * 10 AS x, turn / 10.0::DOUBLE AS conf FROM conversations")
def source_ocr_table(spark, sf_dir):
    line = F.concat_ws("\t", F.lit("5"), (F.col("turn") * 10).cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), (F.col("turn") * 10).cast("string"), F.col("role"))
    noise = F.concat_ws("\n", F.lit("5\t1\t1"), F.lit("5\t1\t1\t1\t1\t-1\tx"), F.lit("5\t1\t1\t1\t1\t90\t "))
    text = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", F.concat_ws("\n", F.lit("level\tleft\ttop\twidth\theight\tconf\ttext"), line, noise).alias("value"))
    return readers.ocr_words(text, ["page", "turn"]).select("page", "turn", "text", F.col("x").cast("long").alias("x"), "conf")


@query("source_xml_vector", "SELECT event_id, value AS first, value * 2 AS second, 2 AS n FROM events")
def source_xml_vector(spark, sf_dir):
    xml = F.concat(F.lit("<cal><sigma> "), F.col("value").cast("string"), F.lit(" "), (F.col("value") * 2).cast("string"), F.lit(" </sigma></cal>"))
    v = table(spark, sf_dir, "events").select("event_id", readers.xml_vector(xml, "sigma").alias("v"))
    return v.select("event_id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.size("v").alias("n"))


@query("source_periods", "SELECT o_orderkey, i::INTEGER AS k, d + i::INTEGER * greatest((o_orderkey % 400) // 12, 1)::INTEGER AS first FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, unnest(range(12)) AS i FROM orders)")
def source_periods(spark, sf_dir):
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(readers.periods(d, F.date_add(d, (F.col("o_orderkey") % 400).cast("int")))).alias("k", "p"))
    return o.select("o_orderkey", "k", "p.first")


@query("source_wide_columns", "SELECT user_id::VARCHAR AS entity_id, max(value) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-05') AS NDVI_20240105, max(value) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-06') AS NDVI_20240106 FROM events GROUP BY 1")
def source_wide_columns(spark, sf_dir):
    o = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("obs_date")).agg(F.max("value").alias("value")).withColumn("signal", F.lit("NDVI"))
    return readers.wide(o, ["NDVI"], ["20240105", "20240106"])


@query("source_stacked", "SELECT r_name AS entity_id, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_stacked(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = {r.r_name: r.r_regionkey for r in table(spark, sf_dir, "region").collect()}  # the literal names of five regions
    return readers.stack({name: n.where(F.col("n_regionkey") == k).select("n_nationkey") for name, k in names.items()})


@query("source_strata", "SELECT cluster, count(*) AS n FROM (SELECT (p_size % 7 - 1)::VARCHAR AS cluster FROM part WHERE p_size % 7 - 1 >= 0) GROUP BY 1")
def source_strata(spark, sf_dir):
    """Points without a cluster (-1) go; the stratum is text."""
    p = table(spark, sf_dir, "part").withColumn("c", F.col("p_size") % 7 - 1).where("c >= 0")
    return p.groupBy(F.col("c").cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_both_formats", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def sink_both_formats(spark, sf_dir):
    at = path(spark, "export")
    sinks.export(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), at)
    csv = readers.read_table(spark, f"{at}/csv", "c_custkey long, c_mktsegment string, c_acctbal double")
    return spark.read.parquet(f"{at}/parquet").intersect(csv)


@query("sink_series_by_entity", "SELECT r_regionkey AS entity_id, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_series_by_entity(spark, sf_dir):
    at, n = path(spark, "series"), table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("entity_id"), "n_nationkey")
    sinks.entity_series(n.select("entity_id").distinct(), n, at)
    return spark.read.option("header", True).schema("n_nationkey int, entity_id int").csv(f"{at}/series").select("entity_id", "n_nationkey")


@query("sink_checkpoint", "SELECT s_suppkey, s_acctbal FROM supplier")
def sink_checkpoint(spark, sf_dir):
    return sinks.checkpointed(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), path(spark, "step"))


@query("sink_one_row", "SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier")
def sink_one_row(spark, sf_dir):
    at = path(spark, "one")
    sinks.one_row(table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")), at)
    return spark.read.schema("n long, total double").json(f"{at}/json")


@query("sink_json_decisions", """SELECT '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS value FROM conversations""")
def sink_json_decisions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("pages"))
    return sinks.json_rows(c, "decisions")


@query("sink_audit", "SELECT conv_id, count(*)::INTEGER AS n_items, count(*) < 4 AS reliable FROM conversations GROUP BY 1")
def sink_audit(spark, sf_dir):
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    items = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("start"), F.col("role").alias("label"), F.lit(0.9).alias("score"), box.alias("box"), n.alias("n"))
    few = sinks.audit_document(items.where("n < 4"), ["conv_id"]).unionByName(sinks.audit_document(items.where("n >= 4"), ["conv_id"], F.array(F.lit("many items"))))
    return few.select("conv_id", F.get_json_object("audit", "$.n_items").cast("int").alias("n_items"), (F.get_json_object("audit", "$.reliable") == "true").alias("reliable"))


@query("sink_magic", "SELECT event_id, event_id % 3 < 2 AS is_tiff FROM events")
def sink_magic(spark, sf_dir):
    head = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("49492A00FF"))).when(F.col("event_id") % 3 == 1, F.unhex(F.lit("4D4D002A"))).otherwise(F.unhex(F.lit("504B0304")))
    return table(spark, sf_dir, "events").select("event_id", sinks.is_tiff(head).alias("is_tiff"))

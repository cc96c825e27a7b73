"""Sources: delimited text, JSON, GeoJSON, XML vectors, OCR tables, manifests, and their canonical shapes.

Schemas are given or found from column names on the driver; data are never scanned to infer them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of delimited files with a header: the first line of the first file alone."""
    return spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path).columns


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Delimited text with a header; all strings without a schema."""
    r = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, others dropped, all cast (what can't be cast is null)."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def first_column(df: DataFrame, names: list[str]) -> Column:
    """The first of the candidate columns that df has; null if it has none."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def profiles_with_layers(layers: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Layers with their profile's columns; the first profile of a repeated key."""
    return layers.join(profiles.dropDuplicates([key]), key, "left")


_DATE = re.compile(r"^(?:(?P<prefix>.*?)_?)(?P<date>20\d{6})$")
_ISO = re.compile(r"^20\d{2}-\d{2}-\d{2}$")


def detect_layout(columns: list[str]) -> str:
    """wide (PREFIX_YYYYMMDD columns), iso (YYYY-MM-DD columns) or long."""
    if any(_DATE.match(c) for c in columns):
        return "wide"
    return "iso" if any(_ISO.match(c) for c in columns) else "long"


def to_observations(df: DataFrame, entity: str, signal: str = "NDVI", date: str = "date", value: str = "value") -> DataFrame:
    """observations(entity_id, obs_date, signal, value) from any of the three layouts; bad numbers and -9999 are null."""
    from loamwork.functions.cleaning import no_data, number

    layout = detect_layout(df.columns)
    if layout == "long":
        return df.select(F.col(entity).cast("string").alias("entity_id"), F.to_date(F.col(date).cast("string")).alias("obs_date"), F.lit(signal).alias("signal"), no_data(number(F.col(value))).alias("value"))
    named = [c for c in df.columns if (_DATE if layout == "wide" else _ISO).match(c)]
    long = df.select(F.col(entity).cast("string").alias("entity_id"), *(F.col(f"`{c}`").cast("string").alias(c) for c in named)).unpivot("entity_id", named, "_c", "_v")
    token = F.to_date(F.regexp_extract("_c", "(20\\d{6})$", 1), "yyyyMMdd") if layout == "wide" else F.to_date("_c")
    kind = F.regexp_replace("_c", "_?20\\d{6}$", "") if layout == "wide" else F.lit("")
    return long.select("entity_id", token.alias("obs_date"), F.when(kind == "", F.lit(signal)).otherwise(kind).alias("signal"), no_data(number(F.col("_v"))).alias("value"))


def curve(observations: DataFrame, signal: str) -> DataFrame:
    """One signal's curve; where an entity lacks it, the generic signal VALUE."""
    has = observations.where(F.col("signal") == signal).select("entity_id").distinct().withColumn("_has", F.lit(True))
    both = observations.where(F.col("signal").isin(signal, "VALUE")).join(has, "entity_id", "left")
    return both.where(F.col("signal") == F.when(F.col("_has"), F.lit(signal)).otherwise("VALUE")).select("entity_id", "obs_date", "value")


def geojson_features(text: DataFrame, column: str = "value") -> DataFrame:
    """(feature, kind, points, min_lon, min_lat, max_lon, max_lat) of FeatureCollections as JSON text, for any nesting of rings."""
    shape = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    f = text.select(F.posexplode(F.from_json(F.col(column), shape)["features"]).alias("feature", "x"))
    numbers = F.transform(F.regexp_extract_all(F.col("x.geometry.coordinates"), F.lit("\\[\\s*(-?[0-9.eE+-]+)\\s*,\\s*(-?[0-9.eE+-]+)"), F.lit(1)), lambda v: v.cast("double"))
    second = F.transform(F.regexp_extract_all(F.col("x.geometry.coordinates"), F.lit("\\[\\s*(-?[0-9.eE+-]+)\\s*,\\s*(-?[0-9.eE+-]+)"), F.lit(2)), lambda v: v.cast("double"))
    points = F.arrays_zip(numbers.alias("x"), second.alias("y"))
    return f.select("feature", F.col("x.properties").alias("properties"), F.col("x.geometry.type").alias("kind"), points.alias("points"), F.array_min(numbers).alias("min_lon"), F.array_min(second).alias("min_lat"), F.array_max(numbers).alias("max_lon"), F.array_max(second).alias("max_lat"))


def weather_days(text: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """(keys, day, tmin, tmax, tmean) from daily arrays as JSON text."""
    shape = "struct<daily:struct<time:array<string>,temperature_2m_min:array<double>,temperature_2m_max:array<double>>>"
    d = text.select(*keys, F.from_json(F.col(column), shape)["daily"].alias("d"))
    z = d.select(*keys, F.explode(F.arrays_zip(F.col("d.time").alias("time"), F.col("d.temperature_2m_min").alias("tmin"), F.col("d.temperature_2m_max").alias("tmax"))).alias("r"))
    return z.select(*keys, F.to_date("r.time").alias("day"), F.col("r.tmin").alias("tmin"), F.col("r.tmax").alias("tmax"), ((F.col("r.tmin") + F.col("r.tmax")) / 2).alias("tmean"))


def month_parts(start: Column, end: Column) -> Column:
    """Array of (first, last) days of the months of a range, cut at its ends; empty for an inverted range."""
    months = F.when(start <= end, F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, start).alias("first"), F.least(F.last_day(m), end).alias("last")))


def daily_temperature(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, day, tmin, tmax, tmean) from sub-daily readings: one of each repeated time, Kelvin told by the mean of the key."""
    once = df.dropDuplicates([*keys, time])
    kelvin = once.groupBy(*keys).agg((F.avg(value) > 150).alias("_k"))
    c = once.join(kelvin, keys).withColumn("_c", F.when(F.col("_k"), F.col(value) - 273.15).otherwise(F.col(value)))
    return c.groupBy(*keys, F.to_date(time).alias("day")).agg(F.min("_c").alias("tmin"), F.max("_c").alias("tmax"), F.avg("_c").alias("tmean"))


def share_by_cell(points: DataFrame, lookup, lon: str = "lon", lat: str = "lat", places: int = 1) -> DataFrame:
    """points with lookup's columns, asked for once for each rounded cell and joined back."""
    keyed = points.withColumns({"_lat": F.bround(lat, places), "_lon": F.bround(lon, places)})
    cells = keyed.select("_lat", "_lon").distinct()
    return keyed.join(lookup(cells), ["_lat", "_lon"], "left").drop("_lat", "_lon")


def labelled_files(files: DataFrame, folders: dict[str, str], path: str = "path") -> DataFrame:
    """(path, label) of files whose parent folder has a label; one row for each path."""
    parent = F.element_at(F.split(path, "/"), -2)
    names = F.create_map(*(F.lit(x) for kv in folders.items() for x in kv))
    return files.select(F.col(path).alias("path"), F.try_element_at(names, parent).alias("label")).where("label is not null").dropDuplicates(["path"])


def newest(files: DataFrame, tag: str) -> DataFrame:
    """The newest of the files (path, modificationTime) whose path holds tag."""
    return files.where(F.col("path").contains(tag)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def ocr_words(text: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """words(keys, idx, text, x, y, w, h, conf) from OCR's tab-separated table with a header line.

    Columns are found by name; short rows, blank texts and negative confidences go; confidences are divided by 100.
    """
    lines = F.split(F.col(column), "\n")
    head = F.split(F.element_at(lines, 1), "\t")
    rows = text.select(*keys, head.alias("head"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("idx", "line")).withColumn("c", F.split("line", "\t"))
    rows = rows.where(F.size("c") >= F.size("head"))
    at = lambda name: F.try_element_at("c", F.nullif(F.array_position("head", name), F.lit(0)).cast("int"))
    words = rows.select(*keys, "idx", at("text").alias("text"), *(at(s).try_cast("int").alias(d) for s, d in (("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))), (at("conf").try_cast("double") / 100).alias("conf"))
    return words.where((F.trim("text") != "") & (F.col("conf") >= 0))


def xml_vector(xml: Column, tag: str) -> Column:
    """The numbers in the first element of that name, as doubles."""
    return F.transform(F.split(F.trim(F.xpath_string(xml, F.lit(f"//{tag}"))), "\\s+"), lambda v: v.try_cast("double"))


def scenes(catalogue: DataFrame, box: tuple[float, float, float, float], start: str, end: str, mode: str | None = None) -> DataFrame:
    """Scenes of a catalogue that meet a box and a half-open interval, oldest first."""
    west, south, east, north = box
    hit = (F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south)
    hit = hit & (F.col("datetime") >= F.lit(start).cast("timestamp")) & (F.col("datetime") < F.lit(end).cast("timestamp"))
    return catalogue.where(hit if mode is None else hit & (F.col("mode") == mode)).orderBy("datetime", "id")


def cache_key(*columns: Column) -> Column:
    """16 hex digits of the SHA-256 of the columns as canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


#: Depth codes in centimetres.
DEPTHS = {"0-20": (0.0, 20.0), "20-50": (20.0, 50.0), "top": (0.0, 20.0), "sub": (20.0, 50.0)}


def depth_code(code: Column) -> tuple[Column, Column]:
    """upper and lower depth of a code; null where unknown."""
    key = F.lower(F.trim(code))
    table = lambda k: F.create_map(*(x for name, d in DEPTHS.items() for x in (F.lit(name), F.lit(d[k]))))
    return F.try_element_at(table(0), key), F.try_element_at(table(1), key)


#: The readers of a pipeline by name: (function, units); callers add their own.
REGISTRY: dict[str, tuple] = {}


def register(name: str, soc_unit: str = "g_per_kg", ph_unit: str = "h2o"):
    def keep(f):
        REGISTRY[name] = (f, {"soc_unit": soc_unit, "ph_unit": ph_unit})
        return f

    return keep


def collect_sources(spark: SparkSession, names: list[str], schema: T.StructType, **options) -> DataFrame:
    """All registered sources in one schema; sources that cannot be read are left out, none at all is an error."""
    frames, failed = [], {}
    for n in names:
        try:
            reader, units = REGISTRY[n]
            frames.append(enforce_schema(reader(spark, **options).withColumn("source", F.lit(n)), schema))
        except Exception as e:  # a source's own failure is reported, not fatal
            failed[n] = str(e)
    if not frames:
        raise RuntimeError(f"no source could be read: {failed}")
    return union_sources(frames)


#: Parts of variable names, and the signals they stand for, in order.
SIGNALS = [("ndvi", "NDVI"), ("evi", "EVI"), ("vh", "VH"), ("vv", "VV"), ("lswi", "LSWI"), ("value", "VALUE")]


def signal_of(variable: Column, attribute: Column | None = None) -> Column:
    """The signal that a variable's name, or else its long name, stands for; VALUE otherwise."""
    out = F.lit("VALUE")
    for source in ([attribute] if attribute is not None else []) + [variable]:
        for part, name in reversed(SIGNALS):
            out = F.when(F.lower(source).contains(part), name).otherwise(out)
    return out


def wide(observations: DataFrame, signals: list[str], dates: list[str]) -> DataFrame:
    """SIGNAL_YYYYMMDD columns for given signals and dates, for exchange with tools that want them."""
    keyed = observations.withColumn("_k", F.concat_ws("_", "signal", F.date_format("obs_date", "yyyyMMdd")))
    return keyed.groupBy("entity_id").pivot("_k", [f"{s}_{d}" for s in signals for d in dates]).agg(F.first("value"))


def periods(start: Column, end: Column, parts: int = 12) -> Column:
    """Array of (first, last) days of equal periods of floor(days / parts) days, one day at least."""
    days = F.greatest(F.call_function("div", F.datediff(end, start), F.lit(parts)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.date_add(start, k * days).alias("first"), F.date_add(start, (k + 1) * days - 1).alias("last")))


def stack(series: dict[str, DataFrame], name: str = "entity_id") -> DataFrame:
    """Series of many entities, one below the other, with the entity's name."""
    return union_sources([df.withColumn(name, F.lit(k)) for k, df in series.items()])

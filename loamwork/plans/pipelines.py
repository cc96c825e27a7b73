"""End-to-end pipelines composed of the library's operators: phenology, wetness, soil, documents, identity."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import text
from loamwork.functions.cleaning import joined_flags
from loamwork.operators import documents, phenology, runs, series, soil, stats, votes
from loamwork.operators.joins import as_of
from loamwork.sources import readers, sinks


@dataclass(frozen=True)
class PhenologyConfig:
    """Parameters of a phenology run; validate() names what is wrong."""

    season: tuple[tuple[int, int], tuple[int, int]] = ((5, 1), (11, 30))
    base_c: float = 10.0
    target_gdd: float = 1650.0
    nursery_days: int = 28
    search_days: int = 75
    mismatch_days: int = 14
    greenup_level: float = 0.25
    hint_level: float = 0.55
    least_amplitude: float = 0.12

    def validate(self) -> PhenologyConfig:
        wrong = [n for n, ok in (("target_gdd", self.target_gdd > 0), ("nursery_days", 0 <= self.nursery_days <= 120), ("search_days", self.search_days > 0), ("greenup_level", -1 <= self.greenup_level <= 1)) if not ok]
        if wrong:
            raise ValueError(f"invalid: {', '.join(wrong)}")
        return self


def phenology_batch(ndvi: DataFrame, vh: DataFrame, weather: DataFrame, farms: DataFrame, assessed: date, config: PhenologyConfig = PhenologyConfig()) -> DataFrame:
    """One row for each farm: dates, degrees, stage, confidence, harvest and flags at an assessment date.

    ndvi and vh are observations(entity_id, obs_date, value); weather is (entity_id, obs_date, tmin, tmax); farms is
    (entity_id, given_date) with a transplanting date where the farmer gave one. Farms without curves stay, with flags.
    """
    c, day = config.validate(), F.lit(assessed).cast("date")
    clean = series.interpolate(series.despike(ndvi.withColumn("value", series.valid_range(F.col("value"), -0.2, 1.0))), "value_clean", "filled").select("entity_id", "obs_date", F.col("filled").alias("value")).where("value is not null")
    smooth = clean.select("entity_id", "obs_date", series.savgol(F.col("value")).alias("value"))
    green = phenology.estimate_greenup(smooth, c.greenup_level, c.least_amplitude, 2 * c.least_amplitude)
    dip = series.first_minimum(vh.withColumn("value", series.valid_range(F.col("value"), -35.0, 5.0, -22.0)).where("value is not null"), c.search_days)
    sure = F.when(F.col("confidence") == "high", 0.7).otherwise(0.5)
    dates = farms.join(green, "entity_id", "left").join(dip, "entity_id", "left").select("entity_id", "given_date", *phenology.fuse_dates(F.col("min_date"), F.lit(0.55), F.col("greenup_date"), sure))
    resolved = dates.select("entity_id", F.col("confidence").alias("date_confidence"), *phenology.resolve_date(F.col("given_date"), F.col("event_date"), c.mismatch_days, c.nursery_days))
    degrees = weather.join(resolved.select("entity_id", "event_date"), "entity_id").where(F.col("event_date").isNotNull())
    degrees = series.running_total(degrees.withColumn("gdd", phenology.growing_degrees(F.col("tmin"), F.col("tmax"), c.base_c)), F.col("gdd"), F.col("event_date"))
    asked = resolved.withColumn("obs_date", day)
    at = as_of(as_of(asked, degrees, ["entity_id"], "obs_date", ["total"]), clean.withColumnRenamed("value", "ndvi"), ["entity_id"], "obs_date", ["ndvi"])
    harvest = series.reach_target(degrees, c.target_gdd, "gdd", "total").withColumnRenamed("reached", "harvest_date")
    at = at.join(harvest, "entity_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    staged = phenology.classify_stage(at, F.col("total")).withColumn("days", F.datediff(day, "event_date"))
    staged = staged.withColumn("hint", F.when(F.col("days").isNotNull(), phenology.stage_hint(F.col("days"), F.col("ndvi"), c.hint_level)))
    no_weather = F.col("harvest_date").isNull()
    stage, confidence, gdd = phenology.stage_branches(no_weather & F.col("hint").isNotNull(), day < F.col("event_date"), F.col("provided"))
    known = F.col("event_date").isNotNull()
    flags = F.array_compact(F.array(F.when(~known, "no_date"), F.when(F.col("mismatch"), "date_mismatch"), F.when(known & no_weather, "no_weather"), F.when(day < F.col("event_date"), "before_transplant")))
    return staged.select(
        "entity_id", "event_date", "sowing_date", "provided", "date_confidence", F.when(known, stage).alias("stage"), F.when(known, confidence).alias("confidence"), F.when(known, gdd).alias("gdd"),
        "days", "hint", "ndvi", "harvest_date", joined_flags(flags).alias("flags"),
    )


def heterogeneity(pixel_dates: DataFrame, gap: int = 20) -> DataFrame:
    """(farm_id, n, first_date, last_date, status) from a date for each pixel."""
    g = pixel_dates.groupBy("farm_id").agg(F.count("event_date").alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    return g.withColumn("status", F.when(F.col("n") < 2, "insufficient").when(F.datediff("last_date", "first_date") >= gap, "heterogeneous").otherwise("uniform"))


def wetness_run(backscatter: DataFrame, areas: DataFrame, folder: str | None = None, least_dates: int = 3) -> tuple[DataFrame, DataFrame]:
    """Fields' classes and one row of hectares; fields with fewer dates are left out. Written as JSON and CSV if folder is given."""
    enough = backscatter.groupBy("entity_id").agg(F.count("value").alias("_n")).where(F.col("_n") >= least_dates).select("entity_id")
    fields = runs.adjacent_cycles(runs.wetness(backscatter.join(enough, "entity_id", "left_semi")))
    summary = stats.area_summary(fields.join(areas, "entity_id"), F.col("area"))
    if folder:
        sinks.one_row(summary, folder)
    return fields, summary


def soil_run(spark: SparkSession, sources: list[str], folder: str, covariates: DataFrame | None = None, value: str = "soc") -> DataFrame:
    """Registered sources in one schema and one unit, sliced by depth, checked, with covariates; written in two formats.

    Units differ by source, so each reader's are applied before pooling; each step's rows are written down.
    """
    frames = []
    for name in sources:
        one = readers.collect_sources(spark, [name], soil.HORIZON)
        units = readers.REGISTRY[name][1]
        one = one.withColumns({"soc": soil.soc_g_per_kg(F.col("soc"), F.lit(units["soc_unit"])), "ph": soil.ph_in_water(F.col("ph"), F.lit(units["ph_unit"])), "bulk_density": soil.bulk_density(F.col("bulk_density"))})
        frames.append(one)
    pooled = sinks.checkpointed(readers.union_sources(frames), f"{folder}/pooled")
    checked = soil.quality_control(soil.texture(soil.valid_horizons(pooled)))
    sliced = soil.harmonise(checked, "profile_id", value).withColumnRenamed("top", "upper").withColumnRenamed("bottom", "lower")
    site = checked.groupBy("profile_id").agg(F.first("source", True).alias("source"), F.first("country", True).alias("country"), F.first("lon", True).alias("lon"), F.first("lat", True).alias("lat"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("qc_flags")))).alias("qc_flags"))
    out = sliced.join(site, "profile_id")
    if covariates is not None:
        out = soil.attach(out, covariates, ["lon", "lat"], [c for c in covariates.columns if c not in ("lon", "lat")])
    sinks.export(out, f"{folder}/final")
    return out


def document_run(pages: DataFrame, factories: dict, importance: dict[str, float] | None = None, least_confidence: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(pages with votes and decisions, files with verdicts) of pages(file, page, ...) under detector plug-ins."""
    from loamwork.operators.detectors import vote

    voted = vote(pages, factories, importance)
    d = votes.decision(F.col("votes"), least_confidence)
    decided = voted.select(*pages.columns, "votes", *(c.alias(n) for n, c in d.items()))
    return decided, votes.file_verdict(decided, ["file"])


#: Labels of a card's fields, and words at which a value ends.
LABELS = {"name": "name|नाम", "father": "father'?s? name", "birth": "dob|date of birth|year of birth", "address": "address|पता"}
STOP = "^(name|father|dob|date|address|male|female|issue)"


def identity_run(words: DataFrame, page: list[str], keep: tuple[str, ...] = ("name",)) -> tuple[DataFrame, DataFrame]:
    """(words with redact, audit document of each page) of OCR words(page, idx, text, x, y, w, h, conf).

    Values of the labels to keep stay readable; identifiers are listed with the boxes around their words.
    """
    lined = documents.lines_of(words, page)
    values = documents.label_values(lined, page, {k: LABELS[k] for k in keep}, STOP)
    names = values.select(*page, F.explode(F.split("value", " ")).alias("_v"))
    kept = words.join(names, [*(words[p] == names[p] for p in page), words["text"] == names["_v"]], "left_semi")
    joined = words.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("ws"))
    texts = F.transform("ws", lambda s: s["text"])
    spans = joined.select(*page, F.array_join(texts, " ").alias("t"), F.explode(F.arrays_zip(F.transform("ws", lambda s: s["idx"]).alias("idx"), documents.word_spans(texts).alias("s"))).alias("z"))
    placed = words.join(spans.select(*page, F.col("z.idx").alias("idx"), F.col("z.s.start").alias("w_start"), F.col("z.s.stop").alias("w_stop")), [*page, "idx"])
    found = joined.select(*page, F.explode(text.entities(F.array_join(texts, " "))).alias("e")).select(*page, "e.label", "e.start", "e.stop", "e.score")
    items = documents.audit(placed, found, page)
    return documents.redaction(words, kept, page), sinks.audit_document(items, page)

"""Cleaning, interpolation, smoothing, phenology dates, growing sums and stages. WIN-01..22, 32, 34; PRJ-03, 04; JN-08, 09, 12."""

from pyspark.sql import functions as F

from loamwork.operators import phenology, series
from loamwork.operators.joins import as_of, range_join
from loamwork.plans.base import DAILY, GAPPY, daily, gappy, table
from loamwork.plans.registry import query

W = "WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date)"
MED = "quantile_cont({}, 0.5) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("series_rolling_median", f"WITH {GAPPY} SELECT entity_id, obs_date, round({MED.format('value')}, 6) AS med FROM gappy")
def series_rolling_median(spark, sf_dir):
    return gappy(spark, sf_dir).select("entity_id", "obs_date", F.round(series.rolling_median(F.col("value")), 6).alias("med"))


_CLEAN = GAPPY + f""", o AS (SELECT *, abs(value - {MED.format('value')}) AS off FROM gappy),
  cl AS (SELECT entity_id, obs_date, CASE WHEN NOT coalesce(off > greatest(5.0, 2.0 * {MED.format('off')}), false) THEN value END AS value_clean FROM o)"""


@query("series_despike", f"WITH {_CLEAN} SELECT entity_id, obs_date, value_clean FROM cl")
def series_despike(spark, sf_dir):
    return series.despike(gappy(spark, sf_dir), 5.0, 2.0).select("entity_id", "obs_date", "value_clean")


def _interp(column: str, source: str) -> str:
    return f"""n AS (SELECT entity_id, obs_date, {column} AS v, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) AS p FROM {source}),
  k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, last_value(v IGNORE NULLS) OVER b AS v0,
      first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1, first_value(v IGNORE NULLS) OVER a AS v1 FROM n
      WINDOW b AS (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT entity_id, obs_date, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END AS filled FROM k)"""


@query("series_interpolate", f"WITH {GAPPY}, {_interp('value', 'gappy')} SELECT entity_id, obs_date, round(filled, 6) AS filled FROM filled")
def series_interpolate(spark, sf_dir):
    return series.interpolate(gappy(spark, sf_dir)).select("entity_id", "obs_date", F.round("filled", 6).alias("filled"))


@query("series_fill_median", f"WITH {GAPPY} SELECT entity_id, obs_date, round(coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY entity_id)), 6) AS v FROM gappy")
def series_fill_median(spark, sf_dir):
    return gappy(spark, sf_dir).select("entity_id", "obs_date", F.round(series.fill_median(F.col("value")), 6).alias("v"))


def _at(k: int) -> str:
    if not k:
        return "filled"
    edge = "first_value(filled) OVER (PARTITION BY entity_id ORDER BY obs_date)" if k < 0 else "last_value(filled) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce({'lag' if k < 0 else 'lead'}(filled, {abs(k)}) OVER (PARTITION BY entity_id ORDER BY obs_date), {edge})"


_S7 = " + ".join(f"({w}) * {_at(k)}" for k, w in zip(range(-3, 4), (-2, 3, 6, 7, 6, 3, -2)))
_S5 = " + ".join(f"({w}) * {_at(k)}" for k, w in zip(range(-2, 3), (-3, 12, 17, 12, -3)))
_SMOOTH = f"{GAPPY}, {_interp('value', 'gappy')}, sm AS (SELECT entity_id, obs_date, CASE WHEN count(*) OVER (PARTITION BY entity_id) >= 7 THEN ({_S7}) / 21 WHEN count(*) OVER (PARTITION BY entity_id) >= 5 THEN ({_S5}) / 35 ELSE filled END AS smooth FROM filled)"


@query("series_savgol", f"WITH {_SMOOTH} SELECT entity_id, obs_date, round(smooth, 6) AS smooth FROM sm")
def series_savgol(spark, sf_dir):
    filled = series.interpolate(gappy(spark, sf_dir))
    return filled.select("entity_id", "obs_date", F.round(series.savgol(F.col("filled")), 6).alias("smooth"))


@query("series_valid_range", f"WITH {DAILY} SELECT entity_id, obs_date, CASE WHEN value BETWEEN 5 AND 120 THEN greatest(value, 20.0::DOUBLE) END AS v FROM daily")
def series_valid_range(spark, sf_dir):
    return daily(spark, sf_dir).select("entity_id", "obs_date", series.valid_range(F.col("value"), 5.0, 120.0, 20.0).alias("v"))


@query("series_sentinel", "SELECT event_id, nullif(CASE WHEN event_id % 9 = 0 THEN -9999.0::DOUBLE ELSE value END, -9999.0::DOUBLE) AS v FROM events")
def series_sentinel(spark, sf_dir):
    from loamwork.functions.cleaning import no_data

    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, -9999.0).otherwise(F.col("value")).alias("v"))
    return raw.select("event_id", no_data(F.col("v")).alias("v"))


_GRAD = f"""WITH {DAILY}, x AS (SELECT entity_id, obs_date, value AS f, lag(value) OVER w AS f0, lead(value) OVER w AS f2,
  date_diff('day', lag(obs_date) OVER w, obs_date)::DOUBLE AS h, date_diff('day', obs_date, lead(obs_date) OVER w)::DOUBLE AS k FROM daily {W})
  SELECT entity_id, obs_date, round(CASE WHEN h IS NULL THEN (f2 - f) / k WHEN k IS NULL THEN (f - f0) / h ELSE (h * h * f2 + (k * k - h * h) * f - k * k * f0) / (h * k * (h + k)) END, 6) AS slope FROM x"""


@query("series_gradient", _GRAD)
def series_gradient(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("day", F.unix_date("obs_date").cast("double"))
    return d.select("entity_id", "obs_date", F.round(series.gradient(F.col("value"), F.col("day")), 6).alias("slope"))


@query("series_integral", f"WITH {DAILY}, s AS (SELECT entity_id, date_diff('day', obs_date, lead(obs_date) OVER w) * (value + lead(value) OVER w) / 2 AS s FROM daily {W}) SELECT entity_id, round(coalesce(sum(s), 0), 4) AS integral FROM s GROUP BY 1")
def series_integral(spark, sf_dir):
    return series.trapezoid(daily(spark, sf_dir)).select("entity_id", F.round("integral", 4).alias("integral"))


@query(
    "series_features",
    f"""WITH {DAILY},
    b AS (SELECT entity_id, quantile_cont(value, 0.2) AS base, max(value) AS hi, avg(value) AS mean, count(*) AS n FROM daily GROUP BY 1)
    SELECT entity_id, round(base, 6) AS baseline, round(hi - base, 6) AS amplitude, round(mean, 6) AS mean, n FROM b""",
)
def series_features(spark, sf_dir):
    return phenology.features(daily(spark, sf_dir)).select("entity_id", F.round("baseline", 6).alias("baseline"), F.round("amplitude", 6).alias("amplitude"), F.round("mean", 6).alias("mean"), "n")


def _sensor(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("obs_date")).agg(F.max("value").alias("value"))


_SENS = "a AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, max(value) AS a FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id AS entity_id, CAST(ts AS DATE) AS obs_date, max(value) AS b FROM events WHERE event_type = 'view' GROUP BY 1, 2)"
_MERGED = f"{_SENS}, m AS (SELECT entity_id, obs_date, a, b, coalesce(a, b) AS merged FROM a FULL OUTER JOIN b USING (entity_id, obs_date))"


@query("series_merge_sensors", f"WITH {_MERGED}, {_interp('merged', 'm')} SELECT m.entity_id, m.obs_date, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'missing' END AS tag, round(filled, 6) AS filled FROM m JOIN filled f ON m.entity_id = f.entity_id AND m.obs_date = f.obs_date")
def series_merge_sensors(spark, sf_dir):
    both = series.merge_sensors(_sensor(spark, sf_dir, "click"), _sensor(spark, sf_dir, "view"))
    return both.select("entity_id", "obs_date", "tag", F.round("filled", 6).alias("filled"))


@query("series_source_counts", f"WITH {_MERGED} SELECT entity_id, count(*) FILTER (WHERE a IS NOT NULL) AS n_first, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS n_second, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS n_missing FROM m GROUP BY 1")
def series_source_counts(spark, sf_dir):
    both = series.merge_sensors(_sensor(spark, sf_dir, "click"), _sensor(spark, sf_dir, "view"))
    return both.groupBy("entity_id").agg(*(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("first", "second", "missing")))


@query("series_align", f"WITH {_SENS} SELECT entity_id, obs_date, a AS left_value, b AS right_value FROM a FULL OUTER JOIN b USING (entity_id, obs_date)")
def series_align(spark, sf_dir):
    """Full outer alignment of two series on the sorted union of their dates."""
    from loamwork.operators.joins import align

    return align(_sensor(spark, sf_dir, "click"), _sensor(spark, sf_dir, "view"))


_ORD = "ord AS (SELECT o_custkey % 50 AS entity_id, CAST(o_orderdate AS DATE) AS obs_date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("entity_id"), F.to_date("o_orderdate").alias("obs_date")).agg(F.max("o_totalprice").alias("value"))


_SEASON = _ORD + """, yr AS (SELECT entity_id, unnest(generate_series(min(year(obs_date)) - 1, max(year(obs_date)) + 1)) AS y FROM ord GROUP BY 1),
  se AS (SELECT entity_id, y, make_date(y, 10, 1) AS season_start, make_date(y + 1, 3, 31) AS season_end FROM yr),
  ct AS (SELECT s.entity_id, y, season_start, season_end, count(*) FILTER (WHERE obs_date BETWEEN season_start AND season_end) AS n_obs FROM se s JOIN ord o ON s.entity_id = o.entity_id GROUP BY ALL),
  best AS (SELECT entity_id, season_start, season_end, n_obs FROM ct QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n_obs DESC, y) = 1)"""


@query("series_season", f"WITH {_SEASON} SELECT * FROM best")
def series_season(spark, sf_dir):
    return series.season_year(_orders(spark, sf_dir), (10, 1), (3, 31))


@query("series_peak_window", f"WITH {_SEASON} SELECT o.entity_id, count(*) AS n_in, min(obs_date) AS first_date, max(obs_date) AS last_date FROM ord o JOIN best b ON o.entity_id = b.entity_id WHERE obs_date BETWEEN season_start AND least(season_end, make_date(year(season_start) + 1, 2, 15)) GROUP BY 1")
def series_peak_window(spark, sf_dir):
    o = _orders(spark, sf_dir)
    inside = phenology.in_peak_window(o, series.season_year(o, (10, 1), (3, 31)), (2, 15))
    return inside.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_in"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))


_PEAK = DAILY + """, pr AS (SELECT entity_id, obs_date AS d, value AS v, coalesce(min(value) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 30, false) AS low,
    coalesce(value > lag(value) OVER (PARTITION BY entity_id ORDER BY obs_date) AND value >= lead(value) OVER (PARTITION BY entity_id ORDER BY obs_date), false) AS loc FROM daily),
  t1 AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY v DESC, d) = 1),
  t2 AS (SELECT * FROM pr WHERE loc AND low QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY v DESC, d) = 1),
  t3 AS (SELECT * FROM pr WHERE loc QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY d) = 1),
  peak AS (SELECT t1.entity_id, CASE WHEN t1.low THEN t1.d WHEN t2.d IS NOT NULL THEN t2.d WHEN t3.d IS NOT NULL THEN t3.d ELSE t1.d END AS peak_date,
    CASE WHEN t1.low THEN t1.v WHEN t2.d IS NOT NULL THEN t2.v WHEN t3.d IS NOT NULL THEN t3.v ELSE t1.v END AS peak_value,
    CASE WHEN t1.low THEN 'global' WHEN t2.d IS NOT NULL THEN 'local_after_dip' WHEN t3.d IS NOT NULL THEN 'first_local' ELSE 'global_without_dip' END AS method
    FROM t1 LEFT JOIN t2 USING (entity_id) LEFT JOIN t3 USING (entity_id))"""


@query("series_peak", f"WITH {_PEAK} SELECT * FROM peak")
def series_peak(spark, sf_dir):
    return series.pick_peak(daily(spark, sf_dir), 30)


_UP = DAILY + """, lo AS (SELECT entity_id, obs_date AS ld, value AS lv, max(value) OVER (PARTITION BY entity_id) AS hi FROM daily QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY value, obs_date) = 1),
  up AS (SELECT d.entity_id, coalesce(min(obs_date) FILTER (WHERE value >= 150), min(obs_date) FILTER (WHERE value >= lv + 0.25 * (hi - lv))) AS greenup_date FROM daily d JOIN lo ON d.entity_id = lo.entity_id AND obs_date >= ld GROUP BY 1)"""


@query("series_greenup", f"WITH {_UP} SELECT * FROM up")
def series_greenup(spark, sf_dir):
    return series.greenup(daily(spark, sf_dir), 150.0)


@query(
    "series_greenup_choice",
    f"""WITH {_PEAK}, c AS (SELECT d.entity_id, d.obs_date, p.peak_date FROM daily d JOIN peak p USING (entity_id) WHERE value >= 60)
    SELECT entity_id, coalesce(min(obs_date) FILTER (WHERE obs_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND date_diff('day', obs_date, peak_date) >= 5),
      min(obs_date) FILTER (WHERE obs_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'), min(obs_date)) AS greenup_date FROM c GROUP BY 1""",
)
def series_greenup_choice(spark, sf_dir):
    d = daily(spark, sf_dir)
    return phenology.choose_greenup(d.where("value >= 60"), series.pick_peak(d, 30), F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"), 5)


@query(
    "series_greenup_estimate",
    f"""WITH {_UP}, a AS (SELECT entity_id, max(value) - quantile_cont(value, 0.2) AS amp, count(value) AS n FROM daily GROUP BY 1)
    SELECT entity_id, CASE WHEN n >= 4 AND amp >= 60 THEN greenup_date END AS greenup_date,
      CASE WHEN n < 4 OR amp < 60 THEN 'low' WHEN amp < 120 THEN 'medium' ELSE 'high' END AS confidence FROM a JOIN up USING (entity_id)""",
)
def series_greenup_estimate(spark, sf_dir):
    return phenology.estimate_greenup(daily(spark, sf_dir), absolute=150.0, gate=60.0, high=120.0)


_TR = DAILY + """, st AS (SELECT *, min(obs_date) OVER (PARTITION BY entity_id) AS s FROM daily),
  tr AS (SELECT entity_id, CASE WHEN count(*) >= 3 THEN arg_min(obs_date, (value, obs_date)) END AS min_date, CASE WHEN count(*) >= 3 THEN min(value) END AS min_value FROM st WHERE date_diff('day', s, obs_date) <= 20 GROUP BY 1)"""


@query("series_first_minimum", f"WITH {_TR} SELECT * FROM tr")
def series_first_minimum(spark, sf_dir):
    return series.first_minimum(daily(spark, sf_dir), 20)


_FUSE = _TR + """, gr AS (SELECT entity_id, min(obs_date) FILTER (WHERE value >= 80) AS g FROM daily GROUP BY 1),
  fu AS (SELECT entity_id, min_date, g, CASE WHEN min_date IS NULL AND g IS NULL THEN NULL WHEN min_date IS NULL THEN g WHEN g IS NULL THEN min_date
     WHEN abs(date_diff('day', min_date, g)) <= 14 THEN least(min_date, g) ELSE g END AS fused,
     CASE WHEN min_date IS NULL AND g IS NULL THEN NULL WHEN min_date IS NULL THEN 0.7::DOUBLE WHEN g IS NULL THEN 0.55::DOUBLE WHEN abs(date_diff('day', min_date, g)) <= 14 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence
     FROM tr JOIN gr USING (entity_id))"""


def _dates(spark, sf_dir):
    d = daily(spark, sf_dir)
    g = d.groupBy("entity_id").agg(F.min(F.when(F.col("value") >= 80, F.col("obs_date"))).alias("g"))
    return series.first_minimum(d, 20).join(g, "entity_id")


@query("series_fuse_dates", f"WITH {_FUSE} SELECT entity_id, fused AS event_date, confidence FROM fu")
def series_fuse_dates(spark, sf_dir):
    both = _dates(spark, sf_dir)
    return both.select("entity_id", *phenology.fuse_dates(F.col("min_date"), F.lit(0.55), F.col("g"), F.lit(0.7)))


@query(
    "series_resolve_dates",
    f"""WITH {_FUSE}, pv AS (SELECT *, CASE WHEN entity_id % 2 = 0 THEN DATE '2024-01-04' END AS given FROM fu)
    SELECT entity_id, coalesce(given, fused) AS event_date, coalesce(given, fused) - 28 AS sowing_date, given IS NOT NULL AS provided,
      given IS NOT NULL AND fused IS NOT NULL AND abs(date_diff('day', given, fused)) > 14 AS mismatch FROM pv""",
)
def series_resolve_dates(spark, sf_dir):
    fused = _dates(spark, sf_dir).select("entity_id", *phenology.fuse_dates(F.col("min_date"), F.lit(0.55), F.col("g"), F.lit(0.7)))
    given = F.when(F.col("entity_id") % 2 == 0, F.lit("2024-01-04").cast("date"))
    return fused.select("entity_id", *phenology.resolve_date(given, F.col("event_date"), 14, 28))


_GDD = DAILY + """, g AS (SELECT entity_id, obs_date, greatest(0.0::DOUBLE, (v_min + v_max) / 2 - 10.0::DOUBLE) AS gdd FROM daily),
  cum AS (SELECT *, sum(CASE WHEN obs_date >= DATE '2024-01-05' THEN gdd ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY obs_date ROWS UNBOUNDED PRECEDING) AS total FROM g)"""


def _gdd(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("gdd", phenology.growing_degrees(F.col("v_min"), F.col("v_max"), 10.0))
    return series.running_total(d, F.col("gdd"), F.lit("2024-01-05").cast("date")).select("entity_id", "obs_date", "gdd", "total")


@query("gdd_running", f"WITH {_GDD} SELECT entity_id, obs_date, round(gdd, 6) AS gdd, round(total, 4) AS total, date_diff('day', DATE '2024-01-05', obs_date)::INTEGER AS days FROM cum")
def gdd_running(spark, sf_dir):
    return _gdd(spark, sf_dir).select("entity_id", "obs_date", F.round("gdd", 6).alias("gdd"), F.round("total", 4).alias("total"), F.datediff("obs_date", F.lit("2024-01-05")).alias("days"))


@query(
    "gdd_reach_target",
    f"""WITH {_GDD}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date DESC) AS r FROM cum),
    l AS (SELECT entity_id, max(obs_date) AS last_d, max(total) FILTER (WHERE r = 1) AS at_d, avg(gdd) FILTER (WHERE r <= 14) AS mean, count(*) FILTER (WHERE total < 1650) AS below FROM r GROUP BY 1)
    SELECT entity_id, CASE WHEN below = 0 OR mean <= 0 THEN last_d ELSE least(last_d + ceil((1650 - at_d) / mean)::INTEGER, last_d) END AS reached FROM l""",
)
def gdd_reach_target(spark, sf_dir):
    return series.reach_target(_gdd(spark, sf_dir), 1650.0, "gdd", "total")


_STAGES = "stages(name, lo, hi) AS (VALUES ('establishment', 0.0, 80.0), ('vegetative', 80.0, 520.0), ('panicle_initiation', 520.0, 640.0), ('reproductive', 640.0, 1063.0), ('ripening', 1063.0, 1176.0), ('maturity', 1176.0, 1650.0))"
_STAGED = """, sg AS (SELECT c.*, coalesce(s.name, CASE WHEN total >= 1650 THEN 'maturity' ELSE 'establishment' END) AS stage,
  least(abs(total - coalesce(s.lo, CASE WHEN total >= 1650 THEN 1176 ELSE 0 END)), abs(coalesce(s.hi, CASE WHEN total >= 1650 THEN 1650 ELSE 80 END) - total)) AS margin FROM cum c LEFT JOIN stages s ON total >= s.lo AND total < s.hi)"""


@query("gdd_stage", f"WITH {_GDD}, {_STAGES}{_STAGED} SELECT entity_id, obs_date, stage, round(margin, 4) AS margin FROM sg")
def gdd_stage(spark, sf_dir):
    staged = phenology.classify_stage(_gdd(spark, sf_dir), F.col("total"))
    return staged.select("entity_id", "obs_date", "stage", F.round("margin", 4).alias("margin"))


@query("range_join_stage", f"WITH {_STAGES} SELECT l_orderkey, l_linenumber, l_partkey, name FROM lineitem JOIN stages ON l_quantity * 30 >= lo AND l_quantity * 30 < hi")
def range_join_stage(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 30).alias("x"))
    return range_join(left, phenology.stage_table(spark), "x", "gdd_min", "gdd_max").select("l_orderkey", "l_linenumber", "l_partkey", "name")


@query("as_of_last_value", "SELECT o.o_orderkey, e.event_id AS last_event, e.value AS last_value FROM (SELECT *, o_custkey % 150 AS k, make_date(2024, 1, 1) + (o_orderkey % 40)::INTEGER AS d FROM orders) o ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) e ON o.k = e.user_id AND o.d >= CAST(e.ts AS DATE)")
def as_of_last_value(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 40).cast("int")).alias("d"))
    right = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "ts", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"))
    return as_of(left, right, ["k"], "d", ["last_event", "last_value"], tie=["ts", "last_event"]).select("o_orderkey", "last_event", "last_value")


_HINT = """, h AS (SELECT entity_id, obs_date, value, date_diff('day', DATE '2024-01-05', obs_date) * 5 AS dat FROM daily),
  hint AS (SELECT *, CASE WHEN dat < 15 THEN 'establishment' WHEN dat < 55 AND (value IS NULL OR value < 55) THEN 'vegetative' WHEN dat < 85 AND value >= 55 THEN 'reproductive' WHEN dat < 120 THEN 'ripening' ELSE 'maturity' END AS hint FROM h)"""


@query("stage_hint", f"WITH {DAILY}{_HINT} SELECT entity_id, obs_date, hint FROM hint")
def stage_hint(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("dat", F.datediff("obs_date", F.lit("2024-01-05")) * 5)
    return d.select("entity_id", "obs_date", phenology.stage_hint(F.col("dat"), F.col("value"), 55.0).alias("hint"))


_AGREE = "(stage = hint OR (stage, hint) IN (('establishment','vegetative'), ('vegetative','establishment'), ('reproductive','vegetative'), ('ripening','reproductive'), ('maturity','ripening')))"
_CONF = f"least(greatest(0.55::DOUBLE * least(1.0::DOUBLE, margin / 80) + 0.25::DOUBLE * (CASE WHEN {_AGREE} THEN 1.0::DOUBLE ELSE 0.45::DOUBLE END) + 0.20::DOUBLE * 0.7::DOUBLE, 0.2::DOUBLE), 0.98::DOUBLE)"


@query("stage_confidence", f"WITH {_GDD}, {_STAGES}{_STAGED}{_HINT} SELECT sg.entity_id, sg.obs_date, {_AGREE} AS agrees, round({_CONF}, 10) AS confidence FROM sg JOIN hint USING (entity_id, obs_date)")
def stage_confidence(spark, sf_dir):
    staged = phenology.classify_stage(_gdd(spark, sf_dir), F.col("total")).select("entity_id", "obs_date", "stage", "margin")
    hints = daily(spark, sf_dir).select("entity_id", "obs_date", phenology.stage_hint(F.datediff("obs_date", F.lit("2024-01-05")) * 5, F.col("value"), 55.0).alias("hint"))
    both = staged.join(hints, ["entity_id", "obs_date"])
    agrees, confidence = phenology.stage_confidence(F.col("stage"), F.col("hint"), F.col("margin"), F.lit(0.7))
    return both.select("entity_id", "obs_date", agrees.alias("agrees"), F.round(confidence, 10).alias("confidence"))


@query(
    "stage_branches",
    f"""WITH {_GDD}, {_STAGES}{_STAGED}{_HINT} SELECT sg.entity_id, sg.obs_date,
      CASE WHEN sg.entity_id % 3 = 0 THEN hint WHEN sg.obs_date < DATE '2024-01-05' THEN 'pre_transplant' ELSE stage END AS stage,
      CASE WHEN sg.entity_id % 3 = 0 THEN 0.6::DOUBLE WHEN sg.obs_date < DATE '2024-01-05' THEN 0.8::DOUBLE ELSE round({_CONF}, 10) END AS confidence,
      CASE WHEN sg.entity_id % 3 = 0 THEN NULL WHEN sg.obs_date < DATE '2024-01-05' THEN 0.0::DOUBLE ELSE round(total, 4) END AS gdd
    FROM sg JOIN hint USING (entity_id, obs_date)""",
)
def stage_branches(spark, sf_dir):
    staged = phenology.classify_stage(_gdd(spark, sf_dir), F.col("total")).select("entity_id", "obs_date", "stage", "margin", "total")
    hints = daily(spark, sf_dir).select("entity_id", "obs_date", phenology.stage_hint(F.datediff("obs_date", F.lit("2024-01-05")) * 5, F.col("value"), 55.0).alias("hint"))
    both = staged.join(hints, ["entity_id", "obs_date"])
    stage, confidence, gdd = phenology.stage_branches(no_gdd=F.col("entity_id") % 3 == 0, before=F.col("obs_date") < F.lit("2024-01-05").cast("date"), trusted=F.lit(True))
    return both.select("entity_id", "obs_date", stage.alias("stage"), F.round(confidence, 10).alias("confidence"), F.round(gdd, 4).alias("gdd"))

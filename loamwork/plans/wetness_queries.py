"""Wetness index, drying cycles, classes, areas, thresholds and runs. WIN-23..31, 35; AGG-04, 05; PRJ-14, 23."""

from pyspark.sql import functions as F

from loamwork.operators import runs
from loamwork.plans.base import DAILY, daily
from loamwork.plans.registry import query

WI = DAILY + """, wi AS (
  SELECT *, CASE WHEN hi = lo THEN 0.0 ELSE 1 - 2 * (value - lo) / (hi - lo) END AS wi
  FROM (SELECT *, min(value) OVER (PARTITION BY entity_id) AS lo, max(value) OVER (PARTITION BY entity_id) AS hi FROM daily))"""


def _wi(spark, sf_dir):
    return runs.wetness(daily(spark, sf_dir))


@query("wet_index", f"WITH {WI} SELECT entity_id, obs_date, round(wi, 6) AS wi FROM wi")
def wet_index(spark, sf_dir):
    return _wi(spark, sf_dir).select("entity_id", "obs_date", F.round("wi", 6).alias("wi"))


@query("wet_series_range", f"WITH {DAILY} SELECT entity_id, min(value) AS lo, max(value) AS hi, round(max(value) - min(value), 6) AS span, count(*) >= 2 AS enough FROM daily GROUP BY entity_id")
def wet_series_range(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("entity_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.max("value") - F.min("value"), 6).alias("span"), (F.count("value") >= 2).alias("enough"))


_EVENTS = """, ev AS (SELECT entity_id, obs_date, CASE WHEN wi >= 0.3 THEN 'wet' WHEN wi <= -0.1 THEN 'dry' END AS s FROM wi),
  e2 AS (SELECT *, lag(s) OVER (PARTITION BY entity_id ORDER BY obs_date) AS p FROM ev WHERE s IS NOT NULL),
  e3 AS (SELECT *, lag(s) OVER (PARTITION BY entity_id ORDER BY obs_date) AS q, lag(s, 2) OVER (PARTITION BY entity_id ORDER BY obs_date) AS q2,
                lag(obs_date) OVER (PARTITION BY entity_id ORDER BY obs_date) AS dried FROM e2 WHERE p IS NULL OR p <> s),
  cyc AS (SELECT * FROM e3 WHERE s = 'wet' AND q = 'dry' AND q2 = 'wet')"""


@query(
    "wet_cycles_state",
    f"WITH {WI}{_EVENTS} SELECT d.entity_id, count(c.entity_id) AS n_cycles, least(count(c.entity_id) / 5.0::DOUBLE, 1.0::DOUBLE) AS likelihood FROM (SELECT DISTINCT entity_id FROM wi) d LEFT JOIN cyc c USING (entity_id) GROUP BY d.entity_id",
)
def wet_cycles_state(spark, sf_dir):
    return runs.drying_cycles(_wi(spark, sf_dir)).drop("cycle_dates")


@query("wet_cycle_dates", f"WITH {WI}{_EVENTS} SELECT entity_id, dried AS dry_date, obs_date AS wet_date FROM cyc")
def wet_cycle_dates(spark, sf_dir):
    return runs.drying_cycles(_wi(spark, sf_dir)).select("entity_id", F.inline("cycle_dates"))


_ADJ = WI + """, h AS (SELECT *, lead(wi) OVER (PARTITION BY entity_id ORDER BY obs_date) AS nx FROM wi),
  cl AS (SELECT entity_id, count(*) FILTER (WHERE wi <= -0.1 AND nx >= 0.3) AS n_cycles, max(wi) >= 0.3 AS ever_flooded FROM h GROUP BY entity_id),
  cls AS (SELECT *, least(n_cycles / 5.0::DOUBLE, 1.0::DOUBLE) AS likelihood, least(n_cycles / 5.0::DOUBLE, 1.0::DOUBLE) >= 0.4 AND ever_flooded AS is_awd FROM cl)"""


@query("wet_cycles_adjacent", f"WITH {_ADJ} SELECT entity_id, n_cycles, likelihood FROM cls")
def wet_cycles_adjacent(spark, sf_dir):
    return runs.adjacent_cycles(_wi(spark, sf_dir)).select("entity_id", "n_cycles", "likelihood")


@query("wet_classes", f"WITH {_ADJ} SELECT entity_id, n_cycles, likelihood, ever_flooded, is_awd, ever_flooded AND NOT is_awd AS continuous FROM cls")
def wet_classes(spark, sf_dir):
    return runs.adjacent_cycles(_wi(spark, sf_dir))


@query(
    "wet_area_summary",
    f"""WITH {_ADJ}, a AS (SELECT *, ever_flooded AND NOT is_awd AS cont, (entity_id % 7 + 1) * 625.0::DOUBLE AS area FROM cls)
    SELECT round_even(coalesce(sum(area) FILTER (WHERE is_awd), 0) / 10000, 4) AS awd_area_ha, round_even(coalesce(sum(area) FILTER (WHERE cont), 0) / 10000, 4) AS continuous_area_ha,
      round_even(coalesce(sum(area) FILTER (WHERE is_awd OR cont), 0) / 10000, 4) AS paddy_area_ha,
      CASE WHEN coalesce(sum(area) FILTER (WHERE is_awd OR cont), 0) > 0 THEN round_even(coalesce(sum(area) FILTER (WHERE is_awd), 0) / sum(area) FILTER (WHERE is_awd OR cont) * 100, 2) ELSE 0 END AS pct_awd FROM a""",
)
def wet_area_summary(spark, sf_dir):
    from loamwork.operators.stats import area_summary

    classes = runs.adjacent_cycles(_wi(spark, sf_dir)).withColumn("area", (F.col("entity_id") % 7 + 1) * 625.0)
    return area_summary(classes, F.col("area"))


@query(
    "wet_otsu",
    f"""WITH {DAILY}, e AS (SELECT entity_id, min(value) AS lo, max(value) AS hi FROM daily GROUP BY 1),
    b AS (SELECT entity_id, lo, hi, least(floor((value - lo) / ((hi - lo) / 256)), 255)::BIGINT AS b, count(*) AS n FROM daily JOIN e USING (entity_id) WHERE hi > lo GROUP BY ALL),
    s AS (SELECT entity_id, b, lo + (b + 0.5::DOUBLE) * ((hi - lo) / 256) AS c, sum(n) OVER u AS w1, sum(n * b) OVER u AS s1, sum(n) OVER a AS w, sum(n * b) OVER a AS s FROM b
          WINDOW u AS (PARTITION BY entity_id ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY entity_id)),
    v AS (SELECT *, round(w1::DOUBLE * (w - w1) * pow(s1::DOUBLE / w1 - (s - s1)::DOUBLE / nullif(w - w1, 0), 2) / pow(w, 2), 6) AS v FROM s),
    t AS (SELECT entity_id, c AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY v DESC NULLS LAST, b) = 1)
    SELECT d.entity_id, round(max(threshold), 6) AS threshold, count(*) FILTER (WHERE value <= threshold) AS n_flooded, count(*) AS n FROM daily d JOIN t USING (entity_id) GROUP BY 1""",
)
def wet_otsu(spark, sf_dir):
    d = daily(spark, sf_dir)
    both = d.join(runs.otsu(d, ["entity_id"]), "entity_id")
    return both.groupBy("entity_id").agg(F.round(F.max("threshold"), 6).alias("threshold"), F.count_if(F.col("value") <= F.col("threshold")).alias("n_flooded"), F.count(F.lit(1)).alias("n"))


_RUNS = DAILY + """, f AS (SELECT entity_id, obs_date, value > 50 AS f FROM daily),
  g AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date) - row_number() OVER (PARTITION BY entity_id, f ORDER BY obs_date) AS g FROM f),
  r AS (SELECT entity_id, f, count(*) AS n, min(obs_date) AS s FROM g GROUP BY entity_id, f, g)"""


@query("run_longest", f"WITH {_RUNS} SELECT entity_id, max(CASE WHEN f THEN n ELSE 0 END) AS longest FROM r GROUP BY 1")
def run_longest(spark, sf_dir):
    return runs.longest_run(daily(spark, sf_dir), F.col("value") > 50)


@query("run_first_confirmed", f"WITH {_RUNS} SELECT entity_id, min(CASE WHEN f AND n >= 2 THEN s END) AS run_start FROM r GROUP BY 1")
def run_first_confirmed(spark, sf_dir):
    return runs.first_run(daily(spark, sf_dir), F.col("value") > 50, 2)


@query("run_first_share", f"WITH {DAILY}, p AS (SELECT obs_date, count(*) FILTER (WHERE value > 60) >= 0.2 * count(*) AS hit, round(count(*) FILTER (WHERE value > 60) / count(*), 6) AS share FROM daily GROUP BY 1) SELECT min(obs_date) AS first_date, count(*) AS n_days FROM p WHERE hit")
def run_first_share(spark, sf_dir):
    """First day on which a fifth of the entities lie above the threshold."""
    share = daily(spark, sf_dir).groupBy("obs_date").agg((F.count_if(F.col("value") > 60) >= 0.2 * F.count(F.lit(1))).alias("hit"))
    return share.where("hit").agg(F.min("obs_date").alias("first_date"), F.count(F.lit(1)).alias("n_days"))


@query(
    "parcel_verdict",
    f"""WITH {_RUNS}, e AS (SELECT entity_id, max(CASE WHEN f THEN n ELSE 0 END) >= 2 AS planted FROM r GROUP BY 1),
    l AS (SELECT entity_id, arg_max(value, obs_date) / 500 AS p FROM daily GROUP BY 1),
    z AS (SELECT entity_id % 10 AS parcel, count(*) FILTER (WHERE planted) / count(*) AS frac, avg(p) FILTER (WHERE planted) AS mp FROM e JOIN l USING (entity_id) GROUP BY 1)
    SELECT parcel, round(frac, 6) AS fraction, round(coalesce(mp * frac, 0), 6) AS confidence, frac > 0.30 AND coalesce(mp * frac, 0) > 0.05 AS is_plantation FROM z""",
)
def parcel_verdict(spark, sf_dir):
    """Share of confirmed pixels in a parcel, confidence from their latest probability, and the verdict."""
    from loamwork.operators.landcover import verdict

    d = daily(spark, sf_dir)
    flags = runs.longest_run(d, F.col("value") > 50).select("entity_id", (F.col("longest") >= 2).alias("planted"))
    last = d.groupBy("entity_id").agg((F.max_by("value", "obs_date") / 500).alias("p"))
    pixels = flags.join(last, "entity_id").withColumn("parcel", F.col("entity_id") % 10)
    return verdict(pixels, ["parcel"], fraction=0.30, confidence=0.05).select("parcel", F.round("fraction", 6).alias("fraction"), F.round("confidence", 6).alias("confidence"), "is_plantation")

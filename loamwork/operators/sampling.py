"""Sampling design: Cochran's sizes, plans by stratum, seeded draws, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normal quantile, relative error, loss, hectares of a unit, cores of a block, points that make a deviation reliable.
Z, ERROR, LOSS, UNIT_HA, LEAST_CORES, MOST_CORES, RELIABLE = 1.96, 0.15, 0.20, 0.5, 2, 3, 10


def cochran(mean: Column, sd: Column, population: Column, z: float = Z, error: float = ERROR) -> Column:
    """Rounded-up sample size with finite correction; null where mean or population is not positive."""
    n0 = F.pow(F.try_divide(z * sd, error * mean), 2)
    return F.when((mean > 0) & (population > 0), F.ceil(F.when(n0 == 0, 0.0).otherwise(F.try_divide(n0, 1 + F.try_divide(n0 - 1, population))))).cast("double")


def plan(strata: DataFrame) -> DataFrame:
    """Planned cores for strata(stratum, n_points, n_blocks, mean, sd, area).

    Strata with too few points for a deviation of their own take the mean deviation of the reliable ones (pooled),
    or the largest if none is reliable. Sizes get the loss on top and stay within the cores that blocks allow.
    """
    reliable = (F.col("n_points") >= RELIABLE) & F.col("sd").isNotNull()
    pooled = strata.agg(F.avg(F.when(reliable, F.col("sd"))).alias("_pool"), F.max("sd").alias("_max"))  # one row
    s = strata.join(F.broadcast(pooled))
    used = F.when(reliable, F.col("sd")).otherwise(F.coalesce("_pool", "_max"))
    source = F.when(reliable, "own").when(F.col("_pool").isNotNull(), "pooled").otherwise("max")
    s = s.withColumns({"std_used": used, "std_source": source, "n_blocks": F.coalesce("n_blocks", F.lit(1)), "population": F.greatest(F.col("area") / UNIT_HA, F.lit(1.0))})
    s = s.withColumn("n_raw", cochran(F.col("mean"), F.col("std_used"), F.col("population")))
    s = s.withColumn("n_buffered", F.ceil(F.round(F.col("n_raw") * (1 + LOSS), 9)).cast("double"))
    s = s.withColumns({"block_floor": LEAST_CORES * F.col("n_blocks"), "block_ceiling": MOST_CORES * F.col("n_blocks")})
    cores = F.least(F.greatest(F.coalesce("n_buffered", F.col("block_floor").cast("double")), F.col("block_floor").cast("double")), F.col("block_ceiling").cast("double")).cast("long")
    s = s.withColumn("planned_cores", cores)
    return s.withColumns({
        "is_std_imputed": F.col("std_source") != "own", "is_no_estimate": F.col("n_raw").isNull(), "is_at_floor": F.coalesce(F.col("n_buffered") < F.col("block_floor"), F.lit(True)),
        "is_at_ceiling": F.coalesce(F.col("n_buffered") > F.col("block_ceiling"), F.lit(False)), "is_short": F.coalesce(F.col("n_buffered") > F.col("planned_cores"), F.lit(False)),
    }).drop("_pool", "_max")


def stratified(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each label, drawn by the order of seeded hashes: repeatable, whatever the partitions.

    Each task keeps its n smallest of a label first, by a partial top-n over salted parts of a hot label.
    """
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    salted = df.withColumn("_s", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(64)))
    top = lambda frame, *keys: frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return top(top(salted, label, "_s"), label).drop("_s")


def split(key: Column, shares: list[float], seed: int = 0) -> Column:
    """Number of the part (0, 1, ...) that a row's group key falls into: rows of one group stay together.

    The place comes from the MD5 of seed and key as text, so that any engine finds the same parts.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    part, upto = F.lit(len(shares) - 1), 1.0
    for k in range(len(shares) - 1, 0, -1):
        upto -= shares[k]
        part = F.when(place < upto, k - 1).otherwise(part)
    return part


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds chunk: rows in order, size to a chunk, from counts by hash-free ranges of the order key.

    Ranges of the key are numbered by running counts of a narrow table, so no task sorts all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn("chunk", F.lit(None).cast("long"))
    width = max(1, -(-(int(high) - int(low) + 1) // parts))
    cut = df.withColumn("_p", F.floor((F.col(order) - int(low)) / width))
    counts = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # ``parts`` rows at most
    before = counts.withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_p")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return cut.join(F.broadcast(before), "_p").withColumn("chunk", F.floor((F.col("_b") + rank - 1) / size)).drop("_p", "_b")

"""Joins beyond plain equality: provenance, as-of, ranges, overlaps, distances, spans.

None of them is a nested loop: ranges meet over cells of their mean length, distances over grid cells, as-of over one
sorted pass of both sides' union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.sources.scratch import path

#: Rows up to which intervals are broadcast, after counting them.
SMALL = 10_000


def with_provenance(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys with _merge: both, left_only or right_only. Null keys match nothing."""
    l, r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return l.join(r, keys, "full_outer").withColumn("_merge", side).drop("_l", "_r")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    often = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.join(often, keys, "left_semi")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def left_on_distinct(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Left join with the first row of each key on the right, so no left row is repeated."""
    return left.join(first_of_each(right, keys, order), keys, "left")


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_value and right_value on the union of the two series' dates."""
    l, r = left.withColumnRenamed("value", "left_value"), right.withColumnRenamed("value", "right_value")
    return l.join(r, ["entity_id", "obs_date"], "full_outer")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, take: list[str], tie: list[str] | None = None) -> DataFrame:
    """left with columns ``take`` of the last right row of its key with on <= its own; null if there is none.

    One pass over the sorted union of both sides: a key's rows are never paired up. Among right rows with one ``on``,
    the last by ``tie`` counts.
    """
    tie = tie or take
    value = F.struct(*take)
    l = left.withColumns({"_row": F.struct(*left.columns), "_side": F.lit(1)}).select(*keys, on, "_row", "_side")
    r = right.select(*keys, on, value.alias("_take"), F.struct(*tie).alias("_tie"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(on), F.col("_side"), F.col("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_side = 1")
    return last.select("_row.*", *(F.col("_last")[c].alias(c) for c in take))


class _Cells:
    """Cells of equal width over a line, for intervals of one side (low, high): as wide as these are on average.

    So all of them together are in two cells each on average, however many there are. What lies beyond their
    smallest and largest finite bounds is in the two outermost cells.
    """

    def __init__(self, intervals: DataFrame, low: str, high: str, width: float | None = None):
        real = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
        start, stop, mean, self.rows = intervals.agg(
            F.least(F.min(real(low)), F.min(real(high))), F.greatest(F.max(real(low)), F.max(real(high))), F.avg(F.greatest(real(high) - real(low), F.lit(0.0))), F.count(F.lit(1))
        ).first()  # one row
        self.width = width or mean or max(1.0, (stop or 0.0) - (start or 0.0))
        self.start, self.stop = (start or 0.0) - self.width, (stop or 0.0) + self.width

    def of(self, x: Column) -> Column:
        """The cell of a number; null stays null."""
        return F.when(x.isNotNull(), F.floor(F.least(F.greatest(x.cast("double"), F.lit(self.start)), F.lit(self.stop)) / self.width))

    def between(self, low: str, high: str) -> Column:
        """A row for each cell of an interval; none if it is empty or a bound is null."""
        first, last = self.of(F.col(low)), self.of(F.col(high))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    def side(self, df: DataFrame) -> DataFrame:
        """The intervals' frame, broadcast if it was counted to be small."""
        return F.broadcast(df) if self.rows <= SMALL else df


def range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Rows of left with each range [low, high) that holds value: an equality join over cells of the ranges' mean length, for any number of ranges."""
    cells = _Cells(ranges, low, high)
    joined = left.withColumn("_cell", cells.of(F.col(value))).join(cells.side(ranges.withColumn("_cell", cells.between(low, high))), "_cell")
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], bucket: float | None = None) -> DataFrame:
    """Pairs of intervals of one key (of all, without keys) that overlap, with overlap, their common length.

    They meet over cells as long as right's intervals on average, or of length ``bucket``: an equality join at every size.
    """
    common = F.least(F.col(l[1]), F.col(r[1])) - F.greatest(F.col(l[0]), F.col(r[0]))
    cells = _Cells(right, *r, bucket)
    joined = left.withColumn("_cell", cells.between(*l)).join(cells.side(right.withColumn("_cell", cells.between(*r))), [*keys, "_cell"])
    first = cells.of(F.greatest(F.col(l[0]), F.col(r[0])))  # each pair once, in the first cell they share
    meet = (F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1]))
    return joined.where(meet & (F.col("_cell") == first)).withColumn("overlap", common).drop("_cell")


#: Fixed value: metres in a degree of latitude.
METRES = 111_320.0


#: Points of a cell that one task compares with the points around them.
DENSE = 2_000


def near_pairs(points: DataFrame, radius: float, x: str = "x", y: str = "y", key: str = "id") -> DataFrame:
    """(id_a, id_b, distance) of all pairs of points up to radius apart, id_a < id_b, over grid cells of that size.

    Each point enters its own cell on one side, and on the other its own and four of the eight around it, so that two cells
    meet once. The points of a cell with more than DENSE are dealt over several tasks.
    """
    p = points.select(F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    a = p.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    around = F.explode(F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit(dx == dy == 0).alias("own")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)))))
    b = a.select(F.col("id").alias("id_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"), around.alias("c")).select("id_b", "x_b", "y_b", "c.cx", "c.cy", "c.own")
    dense = a.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select("cx", "cy", F.ceil(F.col("n") / DENSE).cast("int").alias("parts"))
    if dense.limit(1).count():
        parts = F.coalesce("parts", F.lit(1))
        a = a.join(dense, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        b = b.join(dense, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = a.drop("parts").join(b, ["cx", "cy", "part"])
    else:
        met = a.join(b, ["cx", "cy"])
    d = F.sqrt(F.pow(F.col("x") - F.col("x_b"), 2) + F.pow(F.col("y") - F.col("y_b"), 2))
    once = F.when(F.col("own"), F.col("id") < F.col("id_b")).otherwise(F.col("id") != F.col("id_b"))
    pairs = met.where(once).withColumn("distance", d).where(F.col("distance") <= radius)
    return pairs.select(F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"), "distance")


def metric_degrees(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds x and y in metres about the points' mean latitude."""
    mean = points.agg(F.avg(lat)).first()[0] or 0.0  # one number
    return points.withColumns({"x": F.col(lon) * METRES * math.cos(math.radians(mean)), "y": F.col(lat) * METRES})


def keep_first(points: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """Points with dropped: in order of id, a point goes if one that stays is near it.

    Pairs (id_a < id_b) are dealt out by ranges of id_b; a task goes through its points in order and decides each whose
    smaller neighbours are decided, by itself or in rounds before. So neighbours with ids close to each other, as along
    a line, are decided in one round, and those with ids far apart have short chains. The smallest undecided point is
    decided in each round, so the rounds end by themselves. State is written to the shared folder between rounds.
    """
    spark = points.sparkSession

    def held(df: DataFrame) -> DataFrame:
        at = path(spark, "keep-first")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    def decide(batches):
        import pyarrow as pa

        known: dict = {}  # of this task's points: whether each is dropped
        now, kept_near, waits = None, False, False

        def made(out: list) -> None:
            if now is not None and (kept_near or not waits):
                known[now] = kept_near
                out.append((now, kept_near))

        for batch in batches:
            out: list[tuple] = []
            for b, a, dropped in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if b != now:
                    made(out)
                    now, kept_near, waits = b, False, False
                dropped = known.get(a) if dropped is None else dropped
                kept_near |= dropped is False
                waits |= dropped is None
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out], pa.bool_())], ["id", "dropped"])
        out = []
        made(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], batch.schema.field(0).type), pa.array([x for _, x in out], pa.bool_())], ["id", "dropped"])

    kind = dict(points.dtypes)[key]
    left = held(pairs.select(F.col("id_a").cast(kind), F.col("id_b").cast(kind)))
    lonely = points.select(F.col(key).alias("id")).distinct().join(left.select(F.col("id_b").alias("id")).distinct(), "id", "left_anti")
    decided = held(lonely.withColumn("dropped", F.lit(False)))
    while left.limit(1).count():
        seen = left.join(decided.select(F.col("id").alias("id_a"), "dropped"), "id_a", "left").select("id_b", "id_a", "dropped")
        new = held(seen.repartitionByRange("id_b").sortWithinPartitions("id_b", "id_a").mapInArrow(decide, f"id {kind}, dropped boolean"))
        decided = held(decided.unionByName(new))
        left = held(left.join(new.select(F.col("id").alias("id_b")), "id_b", "left_anti"))
    return decided.withColumnRenamed("id", key)


def span_overlaps(words: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Words and entities of one page whose half-open character spans meet (w_start < e_end and e_start < w_end)."""
    return words.join(entities, keys).where((F.col("w_start") < F.col("e_end")) & (F.col("e_start") < F.col("w_end")))


def on_grid(left: DataFrame, right: DataFrame, tolerance: float, columns: tuple[str, str] = ("lon", "lat"), how: str = "left_semi") -> DataFrame:
    """Rows of left in a cell (coordinates rounded to the tolerance) that right has too."""
    cell = lambda df, a, b: df.withColumns({a: F.bround(F.col(columns[0]) / tolerance), b: F.bround(F.col(columns[1]) / tolerance)})
    l, r = cell(left, "_gx", "_gy"), cell(right, "_gx", "_gy").select("_gx", "_gy").distinct()
    return l.join(r, ["_gx", "_gy"], how).drop("_gx", "_gy")


def pixel_of(lon: Column, lat: Column, origin: tuple[float, float], size: tuple[float, float], shape: tuple[int, int]) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point under a north-up affine transform; null outside the raster."""
    col, row = F.floor((lon - origin[0]) / size[0]), F.floor((origin[1] - lat) / size[1])
    inside = (col >= 0) & (col < shape[1]) & (row >= 0) & (row < shape[0])
    return F.when(inside, row).cast("int"), F.when(inside, col).cast("int")

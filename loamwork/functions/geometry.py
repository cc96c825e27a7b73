"""Plane geometry on arrays of struct(x, y): rings in order, first point repeated or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Array of (ax, ay, bx, by), the last point joined to the first."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the even-odd rule; the lower and left edges belong to the ring."""
    crosses = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def centroid(ring: Column) -> Column:
    """struct(x, y) by the shoelace sums; the mean of the points of a ring without area."""
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    edges, area = _edges(ring), signed_area(ring)
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e) * cross(e))
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return F.struct(
        F.when(area != 0, total(lambda e: e["ax"] + e["bx"]) / (6 * area)).otherwise(mean("x")).alias("x"),
        F.when(area != 0, total(lambda e: e["ay"] + e["by"]) / (6 * area)).otherwise(mean("y")).alias("y"),
    )


def box(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x, y, w, h)."""
    wide = F.greatest(F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    high = F.greatest(F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    both = wide * high
    return F.coalesce(F.try_divide(both, a[2] * a[3] + b[2] * b[3] - both), F.lit(0.0))


def union_box(boxes: Column) -> Column:
    """Box around an array of struct(x, y, w, h)."""
    low = lambda c: F.array_min(F.transform(boxes, lambda b: b[c]))
    high = lambda c, s: F.array_max(F.transform(boxes, lambda b: b[c] + b[s]))
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h"))


def padded(box_: Column, pad: int, width: int, height: int) -> Column:
    """A box with a margin, inside the page."""
    x, y = F.greatest(box_["x"] - pad, F.lit(0)), F.greatest(box_["y"] - pad, F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), (F.least(box_["x"] + box_["w"] + pad, F.lit(width)) - x).alias("w"), (F.least(box_["y"] + box_["h"] + pad, F.lit(height)) - y).alias("h"))


def keep_separate(boxes: Column, most: float = 0.3) -> Column:
    """Boxes in order, without those that overlap one kept before by more than ``most``: a fold."""
    empty = F.slice(boxes, 1, 0)
    of = lambda b: (b["x"], b["y"], b["w"], b["h"])
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: overlap_ratio(of(k), of(b)) > most), kept).otherwise(F.concat(kept, F.array(b))))


def tile_names(min_x: Column, min_y: Column, max_x: Column, max_y: Column, size: int = 3) -> Column:
    """Names (N12E077) of the cells of ``size`` degrees that a box meets, by their lower left corners."""
    steps = lambda a, b: F.sequence(F.floor(a / size) * size, F.floor(b / size) * size, F.lit(size).cast("long"))
    name = lambda y, x: F.concat(F.when(y >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"))
    return F.flatten(F.transform(steps(min_y, max_y), lambda y: F.transform(steps(min_x, max_x), lambda x: name(y, x))))


#: Fixed value: metres in a degree of latitude.
METRES = 111_320.0


def pixel_hectares(lat: Column, degrees: float) -> Column:
    """Area of a square pixel in degrees, narrowing with the cosine of the latitude."""
    return F.pow(F.lit(degrees * METRES), 2) * F.cos(F.radians(lat)) / 10_000


def extent_km(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> tuple[Column, Column]:
    """Width and height of a box in degrees, about its middle latitude."""
    return (max_x - min_x) * METRES / 1000 * F.cos(F.radians((min_y + max_y) / 2)), (max_y - min_y) * METRES / 1000

"""Raster kernels over pixels(scene, row, col, value): focal statistics, speckle filter, sharpness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_tile(pixels: DataFrame, pad: int, tile: int, name: str, kernel) -> DataFrame:
    """pixels with a column ``name``: kernel(grid, null where unknown) of each tile of bounded size with its margin.

    Pixels in a tile's margin are sent to it too, so a scene of any size spreads over tasks. Unknown pixels stay null.
    """
    step = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - pad) / tile), F.floor(F.col(c) / tile), F.floor((F.col(c) + pad) / tile)))
    dealt = pixels.withColumn("tr", F.explode(step("row"))).withColumn("tc", F.explode(step("col")))

    def run(table):
        import pyarrow as pa

        r, c, v = (table.column(n).to_numpy(zero_copy_only=False) for n in ("row", "col", "value"))
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        grid[r - r.min(), c - c.min()] = v.astype(float)
        out = np.where(np.isnan(grid), np.nan, kernel(grid))
        mine = (r // tile == tr) & (c // tile == tc)
        found = out[r[mine] - r.min(), c[mine] - c.min()]
        t = table.filter(pa.array(mine)).select(["scene", "row", "col", "value"])
        return t.append_column(name, pa.array(found, pa.float64(), from_pandas=True))

    kinds = dict(pixels.dtypes)
    return dealt.select("scene", F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"), "tr", "tc").groupBy("scene", "tr", "tc").applyInArrow(run, f"scene {kinds['scene']}, row long, col long, value double, {name} double")


def window_median(grid: np.ndarray, radius: int) -> np.ndarray:
    """Median of the known values around each place; a few rows at a time, for bounded memory."""
    size = 2 * radius + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(grid, radius, constant_values=np.nan), (size, size))
    out = np.full(grid.shape, np.nan)
    for k in range(0, len(grid), 32):
        x = np.sort(windows[k : k + 32].reshape(*windows[k : k + 32].shape[:2], -1), axis=2)  # unknown ones last
        n = (~np.isnan(x)).sum(axis=2)
        lo, hi = np.maximum(n - 1, 0) // 2, n // 2
        pick = lambda at: np.take_along_axis(x, np.minimum(at, x.shape[2] - 1)[:, :, None], axis=2)[:, :, 0]
        out[k : k + 32] = np.where(n > 0, (pick(lo) + pick(hi)) / 2, np.nan)
    return out


def focal_median(pixels: DataFrame, radius: int = 1, tile: int = 256) -> DataFrame:
    """pixels(scene, row, col, value) with focal: median of the known values in a square window; null where the pixel itself is unknown."""
    return _by_tile(pixels, radius, tile, "focal", lambda grid: window_median(grid, radius))


def lee(image: np.ndarray, size: int = 7, looks: float = 4.0) -> np.ndarray:
    """Speckle filter: each pixel moves to its window's mean by how far the window's variation is noise alone; edges are mirrored."""
    pad = size // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(image.astype(float), pad, mode="reflect"), (size, size))
    mean, sd = windows.mean(axis=(2, 3)), windows.std(axis=(2, 3))
    noise, spread = 1 / looks, np.square(sd / np.where(mean == 0, 1e-12, mean))
    weight = np.clip(1 - noise / np.where(spread == 0, np.inf, spread), 0, 1) * (spread > 0)
    return mean + weight * (image - mean)


def speckle_filter(pixels: DataFrame, size: int = 7, looks: float = 4.0, tile: int = 256) -> DataFrame:
    """pixels with filtered. Tiles at a scene's edge mirror their own border; unknown pixels take the tile's mean for their neighbours."""

    def kernel(grid):
        known = ~np.isnan(grid)
        if not known.any() or min(grid.shape) <= size // 2:
            return grid
        return lee(np.where(known, grid, grid[known].mean()), size, looks)

    return _by_tile(pixels, size // 2, tile, "filtered", kernel)


def sharpness(pixels: DataFrame) -> DataFrame:
    """(scene, tenengrad, laplacian_var): mean squared gradient and variance of the Laplacian of inner pixels, by neighbour windows."""
    from pyspark.sql import Window

    across, down = Window.partitionBy("scene", "row").orderBy("col"), Window.partitionBy("scene", "col").orderBy("row")
    n = pixels.withColumns({"l": F.lag("value").over(across), "r": F.lead("value").over(across), "u": F.lag("value").over(down), "d": F.lead("value").over(down)}).na.drop(subset=["l", "r", "u", "d"])
    gradient = F.pow(F.col("r") - F.col("l"), 2) + F.pow(F.col("d") - F.col("u"), 2)
    bend = F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("value")
    return n.groupBy("scene").agg(F.avg(gradient).alias("tenengrad"), F.var_pop(bend).alias("laplacian_var"))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Polyline without the points that lie within tolerance of the line through those kept (an explicit stack, no recursion)."""
    p, keep, stack = np.array(points, float), np.zeros(len(points), bool), [(0, len(points) - 1)]
    if len(points) < 3:
        return points
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, off = p[b] - p[a], p[a + 1 : b] - p[a]
        length = np.hypot(*line)
        d = np.hypot(*off.T) if length == 0 else np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / length
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [tuple(x) for x in p[keep].tolist()]


def simplify_to(points: list[tuple[float, float]], tolerance: float, most: int, tries: int = 5) -> list[tuple[float, float]]:
    """Simplified with a tolerance that doubles until at most ``most`` points are left, ``tries`` times at most."""
    out = simplify(points, tolerance)
    for _ in range(tries - 1):
        if len(out) <= most:
            break
        tolerance *= 2
        out = simplify(points, tolerance)
    return out

"""Areas from uploaded vector files: shapefiles, alone or zipped, and GeoJSON, as longitude and latitude.

Files are read by Spark's binary source, from wherever it can read, and parsed one in a task each: areas are small files. A
shapefile needs its .prj; geographic coordinates stay as they are, and transverse Mercator ones (UTM and the like) are turned
back by the sixth-order series in the third flattening. Other projections and files without one are errors.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types that hold points, and those that hold rings or lines (plain, with z, with m).
POINTS, PARTS = (1, 11, 21), (3, 5, 13, 15, 23, 25)
AREA = "source string, number int, rings array<array<array<double>>>"


def records(content: bytes) -> list[tuple[int, list[np.ndarray]]]:
    """(record number, rings as arrays of x and y) of a .shp file's content; null shapes have no rings."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 12 <= len(content):
        number, words = struct.unpack(">2i", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        rings: list[np.ndarray] = []
        if kind in POINTS:
            rings = [np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)]
        elif kind in PARTS:
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            points = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
            rings = [points[a:b] for a, b in zip(starts, starts[1:])]
        elif kind:
            raise ValueError(f"shape type {kind} is not supported")
        out.append((number, rings))
    return out


def to_degrees(points: np.ndarray, projection: str) -> np.ndarray:
    """Longitude and latitude of points in the coordinate system that a .prj file's text names."""
    if "PROJCS" not in projection:
        if "GEOGCS" not in projection:
            raise ValueError("unknown coordinate system")
        return points
    kind = re.search(r'PROJECTION\["([^"]+)"', projection)
    if not kind or kind[1].lower() != "transverse_mercator":
        raise ValueError(f"projection {kind[1] if kind else 'without a name'} is not supported")
    given = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\["([^"]+)",\s*([-+0-9.eE]+)', projection)}
    a, inverse_flattening = map(float, re.search(r'SPHEROID\["[^"]+",\s*([0-9.eE+]+),\s*([0-9.eE+]+)', projection).groups())
    return _from_transverse_mercator(points, a, 1 / inverse_flattening, given)


def _from_transverse_mercator(points: np.ndarray, a: float, f: float, given: dict[str, float]) -> np.ndarray:
    """Krueger's series: the conformal sphere's transverse coordinates, then the latitude by Newton steps."""
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Coefficients of the inverse series up to the sixth power of n.
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    scale = given.get("scale_factor", 1.0) * radius
    e = math.sqrt(f * (2 - f))
    if given.get("latitude_of_origin", 0.0):
        raise ValueError("an origin off the equator is not supported")
    xi, eta = (points[:, 1] - given.get("false_northing", 0.0)) / scale, (points[:, 0] - given.get("false_easting", 0.0)) / scale
    u = xi - sum(b * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, b in enumerate(beta, 1))
    v = eta - sum(b * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, b in enumerate(beta, 1))
    conformal = np.sin(u) / np.hypot(np.sinh(v), np.cos(u))  # tangent of the conformal latitude
    tangent = conformal / (1 - e * e)
    for _ in range(6):
        sigma = np.sinh(e * np.arctanh(e * tangent / np.hypot(1, tangent)))
        now = tangent * np.hypot(1, sigma) - sigma * np.hypot(1, tangent)
        tangent = tangent + (conformal - now) / np.hypot(1, now) * (1 + (1 - e * e) * tangent**2) / ((1 - e * e) * np.hypot(1, tangent))
    lon = given.get("central_meridian", 0.0) + np.degrees(np.arctan2(np.sinh(v), np.cos(u)))
    return np.stack([lon, np.degrees(np.arctan(tangent))], 1)


def _geojson_rings(node) -> list[list[list[float]]]:
    """All rings of a GeoJSON object, wherever they lie."""
    if node is None:
        return []
    if node.get("type") == "FeatureCollection":
        return [r for f in node["features"] for r in _geojson_rings(f)]
    if node.get("type") == "Feature":
        return _geojson_rings(node.get("geometry"))
    if node.get("type") == "GeometryCollection":
        return [r for g in node["geometries"] for r in _geojson_rings(g)]
    c = node.get("coordinates", [])
    depth = {"Point": [[c]], "MultiPoint": [[p] for p in c], "LineString": [c], "MultiLineString": c, "Polygon": c, "MultiPolygon": [r for p in c for r in p]}
    return [[[float(p[0]), float(p[1])] for p in r] for r in depth.get(node.get("type"), [])]


def areas_of(name: str, members: dict[str, bytes]) -> list[tuple[str, int, list]]:
    """(source, number, rings) of the areas in the files of one upload: members maps file names to contents."""
    out = []
    for file, content in sorted(members.items()):
        stem, _, kind = file.rpartition(".")
        if kind.lower() in ("geojson", "json"):
            found = json.loads(content)
            features = found["features"] if found.get("type") == "FeatureCollection" else [found]
            out += [(name, k + 1, _geojson_rings(f)) for k, f in enumerate(features)]
        elif kind.lower() == "shp":
            prj = next((c for f, c in members.items() if f.lower() == f"{stem}.prj".lower()), None)
            if prj is None:
                raise ValueError(f"{file} has no coordinate system")
            out += [(name, number, [to_degrees(r, prj.decode("utf-8", "replace")).tolist() for r in rings]) for number, rings in records(content)]
    if not out:
        raise ValueError(f"{name} holds no areas")
    return out


def areas(spark: SparkSession, path: str) -> DataFrame:
    """source, number and rings (longitude, latitude) of all areas in the files that a path names: zips of either kind, .geojson, or .shp beside .prj."""

    def run(table):
        import pyarrow as pa

        members: dict[str, bytes] = {}
        for file, content in zip(table.column("file").to_pylist(), table.column("content").to_pylist()):
            if file.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members |= {m: z.read(m) for m in z.namelist() if m.lower().endswith((".shp", ".prj", ".geojson", ".json")) and not m.startswith("__MACOSX")}
            else:
                members[file] = content
        rows = areas_of(table.column("upload")[0].as_py(), members)
        kinds = [pa.string(), pa.int32(), pa.list_(pa.list_(pa.list_(pa.float64())))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["source", "number", "rings"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    wanted = files.where(F.lower("file").rlike("[.](zip|geojson|json|shp|prj)$")).withColumn("upload", F.regexp_replace("file", "[.][^.]*$", ""))
    return wanted.groupBy("upload").applyInArrow(run, AREA)


def dissolved(areas: DataFrame) -> DataFrame:
    """One row for each source: all its rings as one area, and its box (min_x, min_y, max_x, max_y)."""
    points = F.flatten("rings")
    bound = lambda best, k: best(F.transform("points", lambda p: p[k]))
    joined = areas.groupBy("source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "rings"))), lambda a: a["rings"])).alias("rings"))
    joined = joined.withColumn("points", points)
    return joined.select("source", "rings", bound(F.array_min, 0).alias("min_x"), bound(F.array_min, 1).alias("min_y"), bound(F.array_max, 0).alias("max_x"), bound(F.array_max, 1).alias("max_y"))

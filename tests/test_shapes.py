"""Shapefiles and GeoJSON uploads, with files made by hand."""

import io
import json
import math
import struct
import zipfile

import numpy as np
import pytest

from loamwork.sources import shapes

SQUARE = [(77.0, 12.0), (77.0, 12.1), (77.1, 12.1), (77.1, 12.0), (77.0, 12.0)]
WGS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
UTM = f'PROJCS["WGS_1984_UTM_Zone_43N",{WGS},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",75.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def shp(polygons, kind=5):
    body = b""
    for k, rings in enumerate(polygons, 1):
        points = [p for r in rings for p in r]
        if not points:
            content = struct.pack("<i", 0)
        elif kind == 1:
            content = struct.pack("<i2d", 1, *points[0])
        else:
            starts = np.cumsum([0, *map(len, rings)])[:-1]
            xs, ys = zip(*points)
            content = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", k, len(content) // 2) + content
    return struct.pack(">i5xi", 9994, 0)[:4] + b"\0" * 96 + body


def forward(lon, lat, central=75.0, a=6378137.0, f=1 / 298.257223563):
    """Easting and northing by Gauss and Krueger's forward series, third order: good to a millimetre or so."""
    n = f / (2 - f)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    radius = a / (1 + n) * (1 + n * n / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = math.radians(lat), math.radians(lon - central)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(c * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, c in enumerate(alpha, 1))
    y = xi + sum(c * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, c in enumerate(alpha, 1))
    return 500000 + 0.9996 * radius * x, 0.9996 * radius * y


def test_records():
    hole = [(77.02, 12.02), (77.04, 12.02), (77.04, 12.04), (77.02, 12.02)]
    got = shapes.records(shp([[SQUARE, hole], [], [SQUARE]]))
    assert [(n, [len(r) for r in rings]) for n, rings in got] == [(1, [5, 4]), (2, []), (3, [5])]
    assert got[0][1][0].tolist() == [list(p) for p in SQUARE]
    assert shapes.records(shp([[[(1.0, 2.0)]]], kind=1))[0][1][0].tolist() == [[1.0, 2.0]]
    for bad in (b"", b"x" * 200):
        with pytest.raises(ValueError, match="not a shapefile"):
            shapes.records(bad)
    with pytest.raises(ValueError, match="shape type 31"):
        shapes.records(shp([[SQUARE]], kind=31))


@pytest.mark.parametrize("lon,lat", [(75.0, 0.0), (77.1, 12.3), (72.5, 28.9), (75.4, -33.0), (78.0, 60.0)])
def test_transverse_mercator(lon, lat):
    x, y = forward(lon, lat)
    assert shapes.to_degrees(np.array([[x, y]]), UTM)[0] == pytest.approx([lon, lat], abs=2e-8)


def test_other_systems():
    points = np.array([[1.0, 2.0]])
    assert shapes.to_degrees(points, WGS) is points
    with pytest.raises(ValueError, match="Lambert"):
        shapes.to_degrees(points, UTM.replace("Transverse_Mercator", "Lambert_Conformal_Conic"))
    with pytest.raises(ValueError, match="unknown"):
        shapes.to_degrees(points, "nothing")


def test_uploads(spark, tmp_path):
    metres = [forward(*p) for p in SQUARE]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("inner/farm.shp", shp([[metres], [metres]]))
        z.writestr("inner/farm.prj", UTM)
        z.writestr("inner/farm.dbf", b"ignored")
    feature = {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE]]}}
    (tmp_path / "zipped.zip").write_bytes(packed.getvalue())
    (tmp_path / "plain.shp").write_bytes(shp([[SQUARE]]))
    (tmp_path / "plain.prj").write_text(WGS)
    (tmp_path / "notes.txt").write_text("no area")
    (tmp_path / "web.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {"type": "Feature", "geometry": None}]}))
    got = {(r.source, r.number): r.rings for r in shapes.areas(spark, str(tmp_path)).collect()}
    assert set(got) == {("zipped", 1), ("zipped", 2), ("plain", 1), ("web", 1), ("web", 2)}
    assert np.allclose(got["zipped", 2], [SQUARE], atol=1e-7) and np.allclose(got["plain", 1], [SQUARE]) and len(got["web", 1]) == 2 and got["web", 2] == []
    boxes = {r.source: r for r in shapes.dissolved(shapes.areas(spark, str(tmp_path))).collect()}
    assert boxes["zipped"].max_y == pytest.approx(12.1, abs=1e-7) and len(boxes["zipped"].rings) == 2 and boxes["web"].min_x == 77.0
    (tmp_path / "plain.prj").unlink()
    with pytest.raises(Exception, match="no coordinate system"):
        shapes.areas(spark, str(tmp_path)).collect()

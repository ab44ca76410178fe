"""Zones against published points and by round trips; geometries of several reference systems."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.functions.projection import between, from_web, from_zone, to_web, to_zone
from cadastra.operators import spatial as sp
from cadastra.operators.quadtree import shape_join

DEG = lambda d, m, s: -(d + m / 60 + s / 3600)


def test_published_points():
    """Two survey marks of the public technical manual of the datum, in zone 55."""
    for lat, lon, east, north in [(DEG(37, 57, 3.72030), -DEG(144, 25, 29.52440), 273741.297, 5796489.777), (DEG(37, 39, 10.15610), -DEG(143, 55, 35.38390), 228854.052, 5828259.038)]:
        assert to_zone(np.array(lon), np.array(lat), 55) == (pytest.approx(east, abs=0.002), pytest.approx(north, abs=0.002))


def test_round_trips(spark):
    lat, off = (x.ravel() for x in np.meshgrid(np.linspace(-80, 80, 41), np.linspace(-4, 4, 21)))
    for zone, south in ((55, True), (31, False), (1, True)):
        lon = off + 6 * zone - 183
        e, n = to_zone(lon, lat, zone, south)
        back = from_zone(e, n, zone, south)
        # a billionth of a degree is a tenth of a millimetre
        assert np.abs(back[0] - lon).max() < 1e-10 and np.abs(back[1] - lat).max() < 1e-10
    x, y = from_web(*to_web(off, lat))
    assert np.abs(x - off).max() < 1e-10 and np.abs(y - lat).max() < 1e-10
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(off + 147, lat)], "lon double, lat double")
    got = rows.select(*to_zone(F.col("lon"), F.col("lat"), 55)).toPandas().to_numpy()
    assert np.abs(got - np.stack(to_zone(off + 147, lat, 55), axis=1)).max() < 1e-6
    made = spark.createDataFrame([(float(a), float(b)) for a, b in got], "e double, n double").select(*from_zone(F.col("e"), F.col("n"), 55)).toPandas().to_numpy()
    assert np.abs(made - np.stack([off + 147, lat], axis=1)).max() < 1e-10
    with pytest.raises(ValueError):
        between(np.array(1.0), np.array(1.0), 4283, 28399)


def test_geometries_of_several_systems(spark):
    """Lots in degrees, zones of a layer in metres: joined once they are in one system."""
    square = lambda x, y, w: sp.write_wkb("Polygon", [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]])
    lots = spark.createDataFrame([(i, bytearray(square(147.0 + i / 100, -33.0, 0.001))) for i in range(20)] + [(99, None)], "id long, geometry binary")
    lots = sp.set_srid(lots, 4283)
    east, north = to_zone(np.array(147.05), np.array(-33.0), 55)
    layer = sp.set_srid(spark.createDataFrame([(7, bytearray(square(float(east) - 200, float(north) - 200, 1500.0)))], "id long, geometry binary"), 28355)
    both = sp.transformed(layer, 4283)
    g = bytes(both.first()["geometry"])
    assert sp.srid_of(g) == 4283 and sp.srid_of(sp.with_srid(g, None)) is None and sp.read_wkb(g)[0] == "Polygon"
    back = sp.read_wkb(bytes(sp.transformed(both, 28355).first()["geometry"]))[1]
    assert np.abs(np.array(back) - np.array(sp.read_wkb(bytes(layer.first()["geometry"]))[1])).max() < 0.001
    assert {tuple(r) for r in shape_join(lots, both).collect()} == {(5, 7), (6, 7)}
    point = spark.createDataFrame([(1, bytearray(sp.write_wkb("Point", [(147.0, -33.0)])))], "id long, geometry binary")
    assert sp.wkt(bytes(sp.transformed(point, 28355, 4283).first()["geometry"])).startswith("POINT (500000 ")
    with pytest.raises(ValueError):
        sp.transformed(point, 9999)
    with pytest.raises(Exception, match="names no reference system"):
        sp.transformed(point, 3857).collect()

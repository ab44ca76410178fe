"""Rings put together again and shapes that meet in a quadtree, against areas and against tests of all pairs."""

import math
import random

import numpy as np
import pytest

from cadastra.operators import quadtree as qt
from cadastra.operators import spatial as sp
from cadastra.operators.rings import _holds, area, drawn_in, valid


def ring(*p):
    return np.array([*p, p[0]], float)


def areas(shape, off=1e-7):
    return pytest.approx(sorted(sum(area(r) for r in p) for p in shape), abs=off)


def odd(rings, p):
    inside = False
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r[:-1], r[1:]):
            inside ^= bool((y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0)
    return inside


SQUARE, HOLE = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))
DUMBBELL = ring((0, 0), (3, 0), (3, 1.4), (5, 1.4), (5, 0), (8, 0), (8, 3), (5, 3), (5, 1.6), (3, 1.6), (3, 3), (0, 3))


def test_valid():
    assert areas(valid([[ring((0, 0), (2, 2), (2, 0), (0, 2))]])) == [1, 1]  # a bow tie
    star = valid([[ring(*[(math.sin(0.8 * math.pi * k), math.cos(0.8 * math.pi * k)) for k in range(5)])]])
    assert len(star) == 5 and sum(area(p[0]) for p in star) == pytest.approx(0.775677, abs=1e-5)
    for hole in (HOLE, HOLE[::-1]):
        assert [len(p) for p in valid([[SQUARE, hole]])] == [2] and areas(valid([[SQUARE, hole]])) == [12]
    # a hole that touches the shell, one that reaches out of it, parts that overlap, a spike, a ring of no area, repeated corners
    assert areas(valid([[SQUARE, ring((0, 0), (2, 1), (1, 2))]])) == [14.5]
    out = ring((3, 3), (5, 3), (5, 5), (3, 5))
    assert areas(valid([[SQUARE, out]])) == [3, 15] and areas(valid([[SQUARE], [out]])) == [19]
    assert areas(valid([[ring((0, 0), (4, 0), (4, 4), (4, 6), (4, 4), (0, 4), (0, 4))]])) == [16]
    assert valid([[ring((0, 0), (1, 1), (2, 2))]]) == [] and valid([[ring((1, 1), (1, 1), (1, 1))]]) == []
    same = valid([[SQUARE]])
    assert {tuple(x) for x in same[0][0].tolist()} == {tuple(x) for x in SQUARE.tolist()}
    bow = sp.make_valid(sp.write_wkb("Polygon", [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]))
    assert sp.read_wkb(bow)[0] == "MultiPolygon" and sp.make_valid(sp.write_wkb("Point", [(1, 2)])) == sp.write_wkb("Point", [(1, 2)])
    assert sp.make_valid(sp.write_wkb("Polygon", [[(0, 0), (1, 1), (0, 0)]])) is None


def test_drawn_in():
    assert areas(drawn_in([[DUMBBELL]], 0.05, 8), 0.01) == [2 * 2.9**2 + 2.1 * 0.1]
    for by in (0.15, 0.5, 1.4):  # the neck is 0.2 wide
        assert areas(drawn_in([[DUMBBELL]], by, 8), 0.005) == [(3 - 2 * by) ** 2] * 2
    assert drawn_in([[DUMBBELL]], 1.6, 8) == []
    assert [len(p) for p in drawn_in([[SQUARE, HOLE]], 0.25, 8)] == [2] and drawn_in([[SQUARE, HOLE]], 0.6, 8) == []
    assert sp.read_wkb(sp.inset(sp.write_wkb("Polygon", [[tuple(x) for x in DUMBBELL.tolist()]]), 0.15))[0] == "MultiPolygon"


@pytest.mark.parametrize("whole", [False, True])
def test_random_rings(whole):
    rng = np.random.default_rng(1 + whole)
    for _ in range(40):
        rings = []
        for _ in range(rng.integers(1, 3)):
            q = rng.random((rng.integers(3, 9), 2)) * 10
            q = np.round(q) if whole else q
            rings.append(np.vstack([q, q[:1]]))
        made = valid([rings])
        edges = np.vstack([np.zeros((0, 4)), *[np.hstack([r[:-1], r[1:]]) for p in made for r in p]])
        small = drawn_in([rings], 0.3, 8)
        assert all(len({tuple(x) for x in r.tolist()}) == len(r) - 1 for p in made + small for r in p)
        for p in rng.random((40, 2)) * 10:
            assert odd(rings, p) == (sum(odd(q, p) for q in made) == 1)
            d = edges[:, 2:] - edges[:, :2]
            t = np.clip(((p - edges[:, :2]) * d).sum(axis=1) / (d**2).sum(axis=1), 0, 1)
            away = np.linalg.norm(edges[:, :2] + t[:, None] * d - p, axis=1).min() if len(edges) else 0
            if abs(away - 0.3) > 0.01:
                assert (odd(rings, p) and away > 0.3) == (sum(odd(q, p) for q in small) == 1)


def all_pairs(a, b):
    """Whether two geometries meet: each edge with each, then each first corner in the other's polygons."""
    parts = qt._edges(a), qt._edges(b)
    if any(qt._cross(x, y) for x, _ in parts[0] for y, _ in parts[1]):
        return True
    within = lambda p, g: any(odd(q, p) for q in sp.polygons(g))
    return any(within(e[0, :2], b) for e, _ in parts[0]) or any(within(e[0, :2], a) for e, _ in parts[1])


def shapes(rng, n, whole, far=30.0):
    out = []
    for i in range(n):
        at, wide = (rng.random() * far, rng.random() * far), rng.choice([0.3, 2, 2, 9])
        f = (lambda v: float(round(v))) if whole else float
        corner = lambda k, m, w=wide, at=at: (f(at[0] + w * math.cos(2 * math.pi * k / m)), f(at[1] + w * math.sin(2 * math.pi * k / m)))
        m = rng.randint(3, 12)
        r = [corner(k, m) for k in range(m)]
        hole = [((x - at[0]) / 2 + at[0], (y - at[1]) / 2 + at[1]) for x, y in r]
        kind = rng.randrange(6)
        made = {0: ("Point", [r[0]]), 1: ("Polygon", [[*r, r[0]], [*hole, hole[0]]]), 2: ("MultiPolygon", [[[*r, r[0]]], [[(x + 12, y) for x, y in [*r, r[0]]]]])}.get(kind, ("Polygon", [[*r, r[0]]]))
        out.append((i, bytearray(sp.write_wkb(*made))))
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_shape_join(spark, whole):
    """Small leaves and groups: holes, parts, points, touching borders on whole coordinates, many shapes on one spot, nulls and repeats."""
    rng = random.Random(5 + whole)
    a, b = shapes(rng, 90, whole), shapes(rng, 70, whole)
    spot = [(1000 + k, a[0][1]) for k in range(25)]
    big = sp.write_wkb("Polygon", [[(-5, -5), (40, -5), (40, 40), (-5, 40), (-5, -5)]])
    a, b = a + spot + [(5000, bytearray(big)), (5001, None)], b + [(7, b[0][1]), (5002, bytearray(big)), (None, bytearray(big))]
    want = {(i, j) for i, g in a for j, h in b if g and h and j is not None and all_pairs(bytes(g), bytes(h))}
    got = [tuple(r) for r in qt.shape_join(spark.createDataFrame(a, "id long, geometry binary"), spark.createDataFrame(b, "id long, geometry binary"), corners=200, pieces=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [(i, j, g, h) for i, g in a[:40] for j, h in b[:40]]
    assert all(qt.intersects(bytes(g), bytes(h)) == all_pairs(bytes(g), bytes(h)) for _, _, g, h in some)


def test_one_large_polygon(spark):
    """A polygon of 20,000 corners over lots: no lot's row ever has more of it than the edges in its leaf."""
    n, lots = 20_000, 1500
    at = lambda k: (50 + 40 * (1 + 0.2 * math.sin(60 * math.pi * k / n)) * math.cos(2 * math.pi * k / n), 50 + 40 * (1 + 0.2 * math.sin(60 * math.pi * k / n)) * math.sin(2 * math.pi * k / n))
    r = ring(*map(at, range(n)))
    rng = np.random.default_rng(3)
    corners = rng.random((lots, 2)) * 100
    square = lambda x, y: sp.write_wkb("Polygon", [[(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5), (x, y)]])
    a = spark.createDataFrame([(i, bytearray(square(*c))) for i, c in enumerate(corners.tolist())], "id long, geometry binary")
    b = spark.createDataFrame([(0, bytearray(sp.write_wkb("Polygon", [[tuple(x) for x in r.tolist()]])))], "id long, geometry binary")
    tree = qt.plant([a, b], corners=500)
    large = list(qt.pieces_of(tree, [(np.hstack([r[:-1], r[1:]]), True)]))
    assert max(len(e) for *_, e, _ in large) <= 2010 and any(not len(e) and holds for *_, e, holds in large)
    got = {x["a_id"] for x in qt.shape_join(a, b, corners=500, pieces=300).collect()}
    edges = np.hstack([r[:-1], r[1:]])
    want = {i for i, (x, y) in enumerate(corners.tolist()) if len(qt._touching(edges, x, y, 0.5)) or _holds(r, x, y)}
    assert got == want and 0 < len(want) < lots


def test_no_shapes(spark):
    none = spark.createDataFrame([], "id long, geometry binary")
    assert qt.shape_join(none, none).count() == 0 and qt.shape_join(none, spark.createDataFrame([(1, bytearray(sp.write_wkb("Point", [(1, 1)])))], "id long, geometry binary")).count() == 0
    point = spark.createDataFrame([(1, bytearray(sp.write_wkb("Point", [(1, 1)])))], "id string, geometry binary")
    assert [tuple(r) for r in qt.shape_join(point, point).collect()] == [("1", "1")]


def test_equal_shapes_meet_once(spark, monkeypatch):
    """Shapes that occur many times on either side are tested once; every pair of ids comes back once, also where an id has several shapes."""
    box = lambda x: bytearray(sp.write_wkb("Polygon", [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]]))
    a, b = [(i, box(2.0 * (i % 5))) for i in range(2500)], [(f"z{i}", box(2.0 * (i % 4) + 0.5)) for i in range(40)]
    want = {(i, z) for i, _ in a for z, _ in b if i % 5 == int(z[1:]) % 4}
    tested, real = [], sp.shape_join
    monkeypatch.setattr(sp, "shape_join", lambda x, y, *more: tested.append((x.count(), y.count())) or real(x, y, *more))

    def joined(a, b, shrink=0.0):
        return [tuple(r) for r in sp.geometry_join(spark.createDataFrame(a, "id long, geometry binary"), spark.createDataFrame(b, "id string, geometry binary"), 0.0, shrink).collect()]

    for shrink in (0.0, 0.01):
        got = joined([*a, (9999, None), (None, box(0.0))], b, shrink)
        assert len(got) == len(want) and set(got) == want
    assert tested == [(5, 4)] * 2
    one = [(7, box(0.0)), (7, box(2.0)), (7, box(0.0))]
    assert joined(one, [("y", box(1.5))] * 3) == [(7, "y")] and joined(one, [("y", box(0.5)), ("x", box(9.0))]) == [(7, "y")] and joined(a, b[:1]) and joined([], b) == []

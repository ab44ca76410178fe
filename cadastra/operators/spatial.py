"""Spatial joins without a spatial engine: grid cells make theta joins into equi-joins; exact tests follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.projection import between
from cadastra.operators.nearest import nearest
from cadastra.operators.quadtree import intersects, shape_join  # noqa: F401
from cadastra.operators.rings import area, drawn_in, valid
from cadastra.operators.wkb import from_wkt, moved, polygons, read_wkb, srid_of, with_srid, wkt, write_wkb  # noqa: F401
from cadastra.sources.tables import written


def cells(lo: str, hi: str, size: float):
    """The numbers of the grid cells that an interval touches."""
    return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))


def box_join(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id) of boxes (id, x0, y0, x1, y1) that touch. A pair is taken in the cell of its common lower corner only."""
    spread = lambda t, p: t.select(*[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")]).withColumn("cx", F.explode(cells(p + "x0", p + "x1", size))).withColumn("cy", F.explode(cells(p + "y0", p + "y1", size)))
    both = spread(a, "a_").join(spread(b, "b_"), ["cx", "cy"])
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    corner = (F.floor(F.greatest("a_x0", "b_x0") / size) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / size) == F.col("cy"))
    return both.filter(meet & corner).select("a_id", "b_id")


def nearest_metres(points: DataFrame, places: DataFrame, group: str) -> DataFrame:
    """nearest() over longitudes (x) and latitudes (y), with metres: the distance on the spheroid to the place found, rounded."""
    found = nearest(points, places, group)
    full = found.join(points.select("id", F.col("x").alias("lon1"), F.col("y").alias("lat1")), "id").join(places.select("place_id", F.col("x").alias("lon2"), F.col("y").alias("lat2")), "place_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon1, lat1, lon2, lat2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4, 8))
            yield pa.record_batch([*b.columns[:4], pa.array(np.round(geodesic_metres(lat1, lon1, lat2, lon2)))], [*b.schema.names[:4], "metres"])

    rows = full.select("id", group, "place_id", "distance", *[F.col(c).cast("double").alias(c) for c in ("lon1", "lat1", "lon2", "lat2")])
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes[:4]) + ", metres double")


def centroid(data: bytes) -> tuple[float, float]:
    """The area centroid of polygons; the mean of the points where there is no area."""
    area = sx = sy = 0.0
    points: list = []
    for p in polygons(data):
        for r in p:
            x, y = r[:, 0], r[:, 1]
            cross = x[:-1] * y[1:] - x[1:] * y[:-1]
            area, sx, sy = area + cross.sum() / 2, sx + ((x[:-1] + x[1:]) * cross).sum() / 6, sy + ((y[:-1] + y[1:]) * cross).sum() / 6
            points += r[:-1].tolist()
    if abs(area) < 1e-300:
        points = points or read_wkb(data)[1]
        return tuple(np.mean(points, axis=0).tolist())
    return sx / area, sy / area


def _moved_in(r: np.ndarray, by: float) -> np.ndarray | None:
    """A convex ring with its inside on the left, every edge moved to the left; edges that would turn round go. None where no ring is left."""
    u = np.diff(r, axis=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n, left = np.stack([-u[:, 1], u[:, 0]], axis=1) * by, list(range(len(u)))

    def corner(i: int, j: int) -> np.ndarray:
        """Where moved edges i and j meet."""
        turn = u[i, 0] * u[j, 1] - u[i, 1] * u[j, 0]
        if abs(turn) < 1e-12:
            return r[j] + n[j]
        d = r[j] + n[j] - r[i] - n[i]
        return r[i] + n[i] + u[i] * (d[0] * u[j, 1] - d[1] * u[j, 0]) / turn

    while len(left) > 2:
        at = [corner(left[k - 1], left[k]) for k in range(len(left))]
        length = [float((at[(k + 1) % len(left)] - at[k]) @ u[left[k]]) for k in range(len(left))]
        if min(length) > 0:
            return np.array([*at, at[0]])
        left.pop(int(np.argmin(length)))
    return None


def _convex(r: np.ndarray) -> bool:
    """Whether a ring turns left only, once round."""
    u = np.diff(r, axis=0)
    v = np.roll(u, -1, axis=0)
    turn = np.arctan2(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], (u * v).sum(axis=1))
    return bool((turn >= 0).all() and (turn < 3.0).all() and turn.sum() < 7)


def _polygon_wkb(shape: list[list[np.ndarray]]) -> bytes | None:
    out = [[[tuple(x) for x in r.tolist()] for r in p] for p in shape]
    return None if not out else write_wkb("Polygon", out[0]) if len(out) == 1 else write_wkb("MultiPolygon", out)


def make_valid(data: bytes) -> bytes | None:
    """Polygons whose rings cross, touch or overlap, as valid ones (by the odd rule); null where no area is left. Other kinds stay."""
    return _polygon_wkb(valid(polygons(data))) if read_wkb(data)[0] in ("Polygon", "MultiPolygon") else data


def inset(data: bytes, by: float, quarter: int = 1) -> bytes | None:
    """Polygons drawn in by a distance, in as many parts as that leaves; null where nothing is left. Corners that point inwards become arcs of `quarter` edges a quarter turn."""
    shape = polygons(data)
    if len(shape) == 1 and len(shape[0]) == 1:
        r = shape[0][0]
        r = r[np.append(True, (r[1:] != r[:-1]).any(axis=1))]
        r = r if len(r) < 4 or area(r) > 0 else r[::-1]
        if len(r) > 3 and _convex(r):
            moved = _moved_in(r, by)
            return None if moved is None else _polygon_wkb([[moved]])
    return _polygon_wkb(drawn_in(shape, by, quarter))


def wkb_of(df: DataFrame, column: str) -> DataFrame:
    """df with geometry: the WKB of a column of well-known text, null where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [from_wkt(t) if t else None for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "geometry"])

    return df.mapInArrow(run, ", ".join([f"`{n}` {k}" for n, k in df.dtypes] + ["geometry binary"]))


def bounds(df: DataFrame, column: str = "geometry") -> DataFrame:
    """df with x0, y0, x1, y1, cx, cy of a WKB column: the box and the centroid; null geometry gives nulls."""
    names = ["x0", "y0", "x1", "y1", "cx", "cy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g in b.column(b.schema.get_field_index(column)).to_pylist():
                pts = [p for poly in polygons(g) for r in poly for p in r.tolist()] if g else []
                pts = pts or (read_wkb(g)[1] if g else [])
                rows.append((min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts), *centroid(g)) if pts else (None,) * 6)
            yield pa.record_batch([*b.columns, *[pa.array([r[i] for r in rows], pa.float64()) for i in range(6)]], [*b.schema.names, *names])

    return df.mapInArrow(run, ", ".join([f"`{n}` {k}" for n, k in df.dtypes] + [f"{n} double" for n in names]))


def made_valid(df: DataFrame, column: str = "geometry") -> DataFrame:
    """df with a WKB column's polygons made valid; null where no area is left."""
    return _each(df, column, make_valid)


def set_srid(df: DataFrame, number: int, column: str = "geometry") -> DataFrame:
    """df with the number of a reference system in the head of each geometry of a WKB column, whatever stood there."""
    return _each(df, column, lambda g: with_srid(g, number))


def transformed(df: DataFrame, target: int, source: int | None = None, column: str = "geometry") -> DataFrame:
    """df with a WKB column's geometries in another reference system, named in their heads.

    Each is taken to be in the system that its head names, or in `source` where it names none; ValueError where there is neither, or a system is
    not known. Null geometries stay.
    """
    _ = between(0.0, 0.0, 4326, target)  # a system that isn't known is told before anything runs

    def one(g: bytes) -> bytes:
        own = srid_of(g) or source
        if own is None:
            raise ValueError("a geometry names no reference system")
        return with_srid(moved(g, lambda x, y: between(x, y, own, target)), target)

    return _each(df, column, one)


def _each(df: DataFrame, column: str, change: Callable[[bytes], bytes | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), pa.array([change(g) if g else None for g in b.column(i).to_pylist()], pa.binary()))

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in df.dtypes))


def centroids(df: DataFrame) -> DataFrame:
    """(id, geometry): each geometry's area centroid as a point, polygons made valid first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([write_wkb("Point", [centroid(make_valid(g) or g)]) if g else None for g in b.column(1).to_pylist()], pa.binary())], ["id", "geometry"])

    rows = df.select("id", "geometry")
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes))


#: Ids of one shape in a row, about.
IDS = 1000


def _shapes(t: DataFrame, side: str) -> tuple[DataFrame, DataFrame | None, bool, float]:
    """(rows (id, geometry) for the join, ids by shape or None, whether ids are unique, rows a shape) of a side. Where shapes occur twice and more on average, each is taken once, its checksum as its id."""
    rows = t.filter("id IS NOT NULL AND geometry IS NOT NULL").select("id", "geometry", F.unhex(F.sha2("geometry", 256)).alias("shape"))
    rows = written(rows, f"shapes-{side}")
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    shapes = rows.select("shape").distinct().count()
    if n < 2 * shapes:
        return rows.select("id", "geometry"), None, ids == n, 1.0
    once = rows.groupBy(F.col("shape").alias("id")).agg(F.first("geometry").alias("geometry"))
    return written(once, f"distinct-{side}"), rows.select("shape", "id"), ids == n, n / max(shapes, 1)


def _with_ids(pairs: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Pairs of shapes with arrays of a side's ids in its shape's place: a row for each IDS of them or so, in as many tasks as set."""
    own, tasks = f"{side}_id", int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(ids.groupBy(F.col("shape").alias(own)).agg(F.ceil(F.count("*") / IDS).cast("int").alias("parts")), "shape-parts")
    listed = ids.withColumnRenamed("shape", own).join(parts, own).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    listed = listed.repartition(tasks, own, "part").groupBy(own, "part").agg(F.collect_set("id").alias("ids"))
    many = pairs.join(parts, own).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(tasks, own, "part")
    return many.join(listed, [own, "part"]).drop(own, "part", "parts").withColumnRenamed("ids", own)


def geometry_join(a: DataFrame, b: DataFrame, size: float = 0.0, shrink: float = 0.0) -> DataFrame:
    """(a_id, b_id) of rows (id, geometry) whose geometries meet; a's polygons may be drawn in first, against touching neighbours.

    size: squares of the tree in which shapes meet are no narrower. Polygons of b are taken as they are; make them valid first where they
    may not be. Equal geometries are drawn in and tested once; their ids come back behind that.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.record_batch([t.column(0), pa.array([inset(g, shrink, 8) if g else None for g in t.column(1).to_pylist()], pa.binary())], t.schema.names)

    (a, *own_a), (b, *own_b) = _shapes(a, "a"), _shapes(b, "b")
    if shrink:
        a = written(a.mapInArrow(drawn, ", ".join(f"`{n}` {k}" for n, k in a.dtypes)), "drawn-a")
    pairs = shape_join(a, b, size)
    # the side with fewer ids a shape first: its arrays are what the other one's shuffle moves
    sides = sorted([(each, side, ids) for side, (ids, _, each) in (("a", own_a), ("b", own_b)) if ids is not None], key=lambda x: x[0])
    if not sides:
        return pairs
    pairs = written(pairs, "shape-pairs")
    for _, side, ids in sides:
        pairs = _with_ids(pairs, ids, side)
    for _, side, _ in sides:
        pairs = pairs.withColumn(f"{side}_id", F.explode(f"{side}_id"))
    pairs = pairs.select("a_id", "b_id")
    return pairs if own_a[1] and own_b[1] else pairs.distinct()


def geodesic_metres(lat1, lon1, lat2, lon2):
    """Distance on the WGS84 spheroid by Vincenty's inverse formula, for arrays of degrees; points opposite each other give NaN."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2, big = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    lam = big
    for _ in range(100):
        with np.errstate(invalid="ignore", divide="ignore"):
            ss = np.sqrt((np.cos(u2) * np.sin(lam)) ** 2 + (np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)) ** 2)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / ss)
            ca = 1 - sa**2
            cm = np.where(ca == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / ca)
            c = f / 16 * ca * (4 + f * (4 - 3 * ca))
            new = big + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm**2)))
        done, lam = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12, new
        if done:
            break
    u = ca * (a * a - b * b) / (b * b)
    k1 = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    k2 = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = k2 * ss * (cm + k2 / 4 * (cs * (-1 + 2 * cm**2) - k2 / 6 * cm * (-3 + 4 * ss**2) * (-3 + 4 * cm**2)))
    return b * k1 * (sigma - d)

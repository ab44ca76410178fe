"""Which shapes meet, by a tree of squares that is finer where shapes have more corners.

Shapes are cut up by the tree's leaves, not copied to each other: a piece of a shape in a leaf is the edges that touch the leaf, and whether
the shape holds the leaf's reference point. That is enough to decide inside the leaf whether two shapes meet there: edges that
cross or touch, an edge of one that lies in the other, or both holding the reference point. A polygon over many leaves without an edge in them is one
short piece in each. A leaf's pieces meet in one group; where there are many, they are dealt out over several groups, each with a part of
either side, so that a group is bounded however many shapes lie on one spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.wkb import kind_of, lines, polygons
from cadastra.sources.tables import written

#: Corners in a leaf, about; leaves across, at most 2 ** DEEPEST; pieces of either side in a group; inner squares, at most about.
CORNERS, DEEPEST, PIECES, INNER = 4000, 14, 1000, 20_000
#: Where a leaf's reference point lies in it: off any line that data are likely to lie on.
_AT = np.array([0.4142135623730951, 0.5857864376269049 - 0.0123456789])


@dataclass
class Tree:
    """The square that holds all shapes, and the inner squares: a child of one that isn't one itself is a leaf. A square's number is four times its parent's plus its place; the first is 1."""

    x: float
    y: float
    wide: float
    inner: frozenset[int]


def _edges(data: bytes) -> list[tuple[np.ndarray, bool]]:
    """The parts of a geometry: edges (x0, y0, x1, y1) and whether they enclose area. Edges without length go, but for single points."""
    if kind_of(data) in ("Polygon", "MultiPolygon"):
        rings = [[np.hstack([r[:-1], r[1:]]) for r in p if len(r) > 1] for p in polygons(data)]
        parts = [(p[0] if len(p) == 1 else np.vstack(p), True) for p in rings if p]
    else:
        parts = [(np.hstack([x[:-1], x[1:]]), False) for x in lines(data) if len(x) > 1]
    out = []
    for e, encloses in parts:
        moving = (e[:, :2] != e[:, 2:]).any(axis=1)
        out.append((e[moving] if moving.any() else e[:1], encloses))
    return out


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        every = [e for g in b.column(0).to_pylist() for e, _ in _edges(g)]
        if every:
            e = np.vstack(every)
            x, y = e[:, [0, 2]], e[:, [1, 3]]
            yield pa.record_batch([pa.array([v]) for v in (x.min(), y.min(), x.max(), y.max())], ["x0", "y0", "x1", "y1"])


def _counted(x: float, y: float, wide: float, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 << depth
        for b in batches:
            every = [e[:, :2] for g in b.column(0).to_pylist() for e, _ in _edges(g)]
            if every:
                at = np.clip(((np.vstack(every) - (x, y)) / wide * n).astype(np.int64), 0, n - 1)
                code, count = np.unique(_numbers(at[:, 0], at[:, 1], depth), return_counts=True)
                yield pa.record_batch([pa.array(code), pa.array(count)], ["code", "n"])

    return run


def _numbers(ix: np.ndarray, iy: np.ndarray, depth: int) -> np.ndarray:
    """The numbers of squares of a depth by their column and row."""
    code = np.ones_like(ix)
    for k in range(depth - 1, -1, -1):
        code = code * 4 + ((iy >> k) & 1) * 2 + ((ix >> k) & 1)
    return code


def plant(shapes: list[DataFrame], narrowest: float = 0.0, corners: int = CORNERS) -> Tree | None:
    """The tree over the geometries of several tables; None if there are none. A square with more than `corners` corners is inner, unless its children would be narrower than `narrowest`.

    Corners are counted in the finest squares, map-side first, then summed up by depth. Over INNER times `corners` corners in all the leaves take more
    of them, so that there are no more than INNER inner squares in a depth.
    """
    spark = shapes[0].sparkSession
    rows = shapes[0].select("geometry")
    for more in shapes[1:]:
        rows = rows.unionByName(more.select("geometry"))
    rows = rows.filter("geometry IS NOT NULL")
    box = rows.mapInArrow(_boxed, "x0 double, y0 double, x1 double, y1 double").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if box[0] is None:
        return None
    wide = max(box[2] - box[0], box[3] - box[1]) * 1.000001 or 1.0
    depth = DEEPEST
    while depth and wide / (1 << depth) < narrowest:
        depth -= 1
    cells = rows.mapInArrow(_counted(box[0], box[1], wide, depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    cells = written(cells, "cells")  # read for the total and for the sums
    ups = cells.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda k: F.struct(F.expr("1L").alias("_"), k.alias("k")))).alias("_k"), "code", "n")
    sums = ups.select(F.expr("shiftright(code, 2 * _k.k)").alias("code"), "n").filter("code > 0").groupBy("code").agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    inner = sums.filter(F.col("n") > max(corners, total // INNER)).select("code").collect() if depth else []
    return Tree(box[0], box[1], wide, frozenset(r["code"] for r in inner))


def _crossed(e: np.ndarray, o: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the way from o to a target crosses an edge: for each edge with one target, for targets by edges with several."""
    px, py, qx, qy = e.T
    t = t[..., None, :] if t.ndim > 1 else t
    dx, dy = t[..., 0] - o[0], t[..., 1] - o[1]
    a, b = dx * (py - o[1]) - dy * (px - o[0]) > 0, dx * (qy - o[1]) - dy * (qx - o[0]) > 0
    ex, ey = qx - px, qy - py
    return (a != b) & ((ex * (o[1] - py) - ey * (o[0] - px) > 0) != (ex * (t[..., 1] - py) - ey * (t[..., 0] - px) > 0))


def _holds(e: np.ndarray, o: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each target in t whether the way there from o crosses an odd number of the edges."""
    return _crossed(e, o, t).sum(axis=1) % 2 == 1 if len(e) else np.zeros(len(t), bool)


def _touching(e: np.ndarray, x: float, y: float, wide: float) -> np.ndarray:
    """Which edges touch a square: their boxes do, and its corners aren't all on one side of them."""
    at = np.flatnonzero((np.minimum(e[:, 0], e[:, 2]) <= x + wide) & (np.maximum(e[:, 0], e[:, 2]) >= x) & (np.minimum(e[:, 1], e[:, 3]) <= y + wide) & (np.maximum(e[:, 1], e[:, 3]) >= y))
    e = e[at]
    d = e[:, 2:] - e[:, :2]
    side = np.stack([d[:, 0] * (cy - e[:, 1]) - d[:, 1] * (cx - e[:, 0]) for cx in (x, x + wide) for cy in (y, y + wide)])
    return at[(side.min(axis=0) <= 0) & (side.max(axis=0) >= 0)]


def pieces_of(tree: Tree, parts: list[tuple[np.ndarray, bool]]) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(part, leaf, the edges that touch it, whether the part holds its reference point) of all parts, for leaves in which they have anything.

    All parts go down the tree together. Whether a part holds a square's reference point follows from that of the square around it and
    the edges between the two points, which touch that square.
    """
    if not parts:
        return
    edges, of = np.vstack([e for e, _ in parts]), np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
    encloses = np.array([x for _, x in parts])

    def flipped(e: np.ndarray, part: np.ndarray, o: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The parts that hold just one of two points."""
        odd = np.bincount(part[_crossed(e, o, t)], minlength=len(parts)) % 2 == 1
        return np.flatnonzero(odd & encloses)

    outside, first = np.array([tree.x - tree.wide, tree.y - 0.7182818 * tree.wide]), np.array([tree.x, tree.y]) + tree.wide * _AT
    todo = [(1, tree.x, tree.y, tree.wide, np.arange(len(edges)), flipped(edges, of, outside, first))]
    while todo:
        code, x, y, wide, own, holds = todo.pop()
        if code in tree.inner:
            half, o, e, part = wide / 2, np.array([x, y]) + wide * _AT, edges[own], of[own]
            for k in range(4):
                cx, cy = x + half * (k & 1), y + half * (k >> 1)
                now = np.setxor1d(holds, flipped(e, part, o, np.array([cx, cy]) + half * _AT), assume_unique=True) if len(own) else holds
                inside = own[_touching(e, cx, cy, half)] if len(own) else own
                if len(inside) or len(now):
                    todo.append((code * 4 + k, cx, cy, half, inside, now))
            continue
        # edges are in order of their parts
        who, start = np.unique(of[own], return_index=True)
        held = np.isin(who, holds)
        for k, (i, e) in enumerate(zip(who.tolist(), np.split(edges[own], start[1:]) if len(who) else [])):
            yield i, code, e, bool(held[k])
        for i in np.setdiff1d(holds, who, assume_unique=True).tolist():
            yield i, code, edges[:0], True


def _place(tree: Tree, code: int) -> tuple[float, float, float]:
    """A square's lower corner and width."""
    x, y, wide = tree.x, tree.y, tree.wide
    for k in range(code.bit_length() // 2 - 1, -1, -1):
        wide /= 2
        x, y = x + wide * (code >> 2 * k & 1), y + wide * (code >> 2 * k + 1 & 1)
    return x, y, wide


def _cut(tree):
    names = ["id", "leaf", "edges", "encloses", "holds", "box"]

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        of, leaf, edges, encloses, holds, box = zip(*rows)
        return pa.record_batch([ids.take(pa.array(of)), pa.array(leaf, pa.int64()), pa.array(edges, pa.binary()), pa.array(encloses, pa.bool_()), pa.array(holds, pa.bool_()), pa.array(box, pa.binary())], names)

    def some(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = [(i, *part) for i, g in enumerate(b.column(1).to_pylist()) for part in _edges(g)]
        boxes = [np.concatenate([np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)]).tobytes() for _, e, _ in every]
        rows, held = [], 0
        for k, leaf, own, holds in pieces_of(tree.value, [(e, encloses) for _, e, encloses in every]):
            rows.append((every[k][0], leaf, own.tobytes(), every[k][2], holds, boxes[k]))
            held += 128 + own.nbytes
            if held > 8_000_000:
                yield packed(b.column(0), rows)
                rows, held = [], 0
        if rows:
            yield packed(b.column(0), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held = 0, 0
            for i, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):  # about four megabytes of shapes at a time
                held += n
                if held > 4_000_000 or i == b.num_rows - 1:
                    yield from some(b.slice(at, i + 1 - at))
                    at, held = i + 1, 0

    return run


def _inner_points(e: np.ndarray, x: float, y: float, wide: float) -> np.ndarray:
    """A point of each edge inside the square that it touches: the middle of what lies in it."""
    d, low, high = e[:, 2:] - e[:, :2], np.zeros(len(e)), np.ones(len(e))
    for k, lo in ((0, x), (1, y)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sort(np.stack([(lo - e[:, k]) / d[:, k], (lo + wide - e[:, k]) / d[:, k]]), axis=0)
        moves = d[:, k] != 0
        low, high = np.where(moves, np.maximum(low, t[0]), low), np.where(moves, np.minimum(high, t[1]), high)
    return e[:, :2] + d * np.minimum((low + high) / 2, 1.0)[:, None]


def _cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any edge of one touches any of the other."""
    p, q, r, s = a[:, None, :2], a[:, None, 2:], b[None, :, :2], b[None, :, 2:]
    boxes = ((np.minimum(p, q) <= np.maximum(r, s)) & (np.minimum(r, s) <= np.maximum(p, q))).all(axis=-1)
    i, j = np.nonzero(boxes)
    if not len(i):
        return False
    p, q, r, s = a[i, :2], a[i, 2:], b[j, :2], b[j, 2:]
    side = lambda a, b, c: np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    return bool(((side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)).any())


def _meet_in(o: np.ndarray, a: tuple, b: tuple) -> bool:
    """Whether two pieces (edges, inner points, encloses, holds) of one leaf, with its reference point o, meet in it."""
    (ea, pa_, ca, ha), (eb, pb, cb, hb) = a, b
    if ha and hb:
        return True
    step = max(1, 400_000 // max(1, len(eb)))
    for k in range(0, len(ea), step):
        if len(eb) and _cross(ea[k : k + step], eb):
            return True
        if cb and (hb ^ _holds(eb, o, pa_[k : k + step])).any():
            return True
    step = max(1, 400_000 // max(1, len(ea)))
    return bool(ca and any((ha ^ _holds(ea, o, pb[k : k + step])).any() for k in range(0, len(eb), step)))


def _met(tree: Tree, leaf: int, left: pa.Table, right: pa.Table) -> tuple[list[int], list[int]]:
    """The rows of either side's pieces of a leaf that meet in it."""
    x, y, wide = _place(tree, leaf)
    o = np.array([x, y]) + wide * _AT

    def opened(t: pa.Table) -> tuple[list, np.ndarray]:
        every = t["edges"].to_pylist()
        e, ends = np.frombuffer(b"".join(every)).reshape(-1, 4), np.cumsum([0, *(len(d) // 32 for d in every)]).tolist()
        inner = _inner_points(e, x, y, wide)
        pieces = [(e[i:j], inner[i:j], *flags) for i, j, *flags in zip(ends, ends[1:], t["encloses"].to_pylist(), t["holds"].to_pylist())]
        # the boxes of the whole parts
        return pieces, np.frombuffer(b"".join(t["box"].to_pylist())).reshape(-1, 4)

    (others, other), (pieces, boxes) = opened(left), opened(right)
    full = np.array([not len(e) and holds for e, _, _, holds in pieces], bool)  # these hold the whole leaf
    found = ([], [])
    for i, box in enumerate(other):
        near = np.flatnonzero(full | ((boxes[:, 0] <= box[2]) & (boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[3]) & (boxes[:, 3] >= box[1])))
        hits = [j for j in near.tolist() if full[j] or _meet_in(o, others[i], pieces[j])]
        found[0].extend([i] * len(hits))
        found[1].extend(hits)
    return found


def _matched(tree):
    """Rows in order of their groups, one after the other: each group is held as a whole, and no more."""

    def of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(rows)
        left, right = (group.filter(pc.equal(group["side"], k)) for k in (0, 1))
        if left.num_rows and right.num_rows:
            found = _met(tree.value, group["leaf"][0].as_py(), left, right)
            take = lambda t, c, k: t[c].combine_chunks().take(pa.array(found[k], pa.int64()))
            yield pa.record_batch([take(left, "a_id", 0), take(right, "b_id", 1)], ["a_id", "b_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("leaf", "na", "nb")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(starts, starts[1:]):
                if j > i:
                    if held and tuple(keys[i]) != key:
                        yield from of(held)
                        held = []
                    key = tuple(keys[i])
                    held.append(b.slice(i, j - i))
        if held:
            yield from of(held)

    return run


def intersects(a: bytes, b: bytes) -> bool:
    """Whether two geometries share a point: the test of shape_join in one square around both."""
    parts = _edges(a), _edges(b)
    if not parts[0] or not parts[1]:
        return False
    every = np.vstack([e for p in parts for e, _ in p])
    low, high = np.minimum(every[:, :2], every[:, 2:]).min(axis=0), np.maximum(every[:, :2], every[:, 2:]).max(axis=0)
    tree = Tree(*low.tolist(), float((high - low).max()) * 1.000001 or 1.0, frozenset())
    opened = [[(e, _inner_points(e, tree.x, tree.y, tree.wide), p[k][1], holds) for k, _, e, holds in pieces_of(tree, p)] for p in parts]
    return any(_meet_in(np.array([tree.x, tree.y]) + tree.wide * _AT, x, y) for x in opened[0] for y in opened[1])


def shape_join(a: DataFrame, b: DataFrame, narrowest: float = 0.0, corners: int = CORNERS, pieces: int = PIECES) -> DataFrame:
    """(a_id, b_id), each pair once, of rows (id, geometry as WKB) that share a point: crossing or touching lines, or one inside the other.

    Polygons have to be valid (a polygon's inside is by the odd rule, part by part). Null geometries and ids meet nothing. Both tables are read three
    times: for the bounds, the tree and the pieces; they should be written ones.
    """
    spark: SparkSession = a.sparkSession
    kind = {s: dict(t.dtypes)["id"] for s, t in (("a", a), ("b", b))}
    tree = plant([a, b], narrowest, corners)
    if tree is None:
        return spark.createDataFrame([], f"a_id {kind['a']}, b_id {kind['b']}")
    given = spark.sparkContext.broadcast(tree)
    cut = lambda t, s: written(t.filter("id IS NOT NULL AND geometry IS NOT NULL").select("id", "geometry").mapInArrow(_cut(given), f"id {kind[s]}, leaf long, edges binary, encloses boolean, holds boolean, box binary"), f"pieces-{s}")
    pa_, pb = cut(a, "a"), cut(b, "b")
    # leaves with pieces of both sides, and over how many groups these are dealt; at most as many rows as the tree has leaves
    parts = lambda t, n: t.groupBy("leaf").agg(F.ceil(F.count("*") / pieces).cast("int").alias(n))
    both = written(parts(pa_, "na").join(parts(pb, "nb"), "leaf"), "leaves")

    def dealt(t: DataFrame, own: str, other: str, side: int) -> DataFrame:
        placed = t.join(F.broadcast(both), "leaf").withColumn(own, F.pmod(F.xxhash64("id", F.length("edges")), own).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ids = [(F.col("id") if s == "ab"[side] else F.lit(None)).cast(kind[s]).alias(f"{s}_id") for s in "ab"]
        return placed.select("leaf", "na", "nb", F.lit(side).alias("side"), *ids, "edges", "encloses", "holds", "box")

    # as many tasks as set: the pieces are small, the work on them isn't
    every = dealt(pa_, "na", "nb", 0).unionByName(dealt(pb, "nb", "na", 1)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "leaf", "na", "nb").sortWithinPartitions("leaf", "na", "nb")
    return every.mapInArrow(_matched(given), f"a_id {kind['a']}, b_id {kind['b']}").distinct()

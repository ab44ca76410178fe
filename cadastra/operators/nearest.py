"""The nearest place of each group for every point, by trees of boxes that are cut where places are dense.

A tree is cut at medians of a bounded sample of a group's places; its leaves get the boxes of the places that really lie in them. A
point goes down the tree by distances: a box that begins further away than another one ends can't hold the nearest place. What is left are a few
leaves for each point, however far its places are, in which it is held against the places, again by a tree where there are many. Points and places
of a leaf meet by one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.sources.tables import written

#: Places in a leaf, about; places in the sample, about; of the sample in a leaf, at least; points that look into a leaf in one salt.
LEAF, SAMPLE, FEW, SALTED = 2048, 200_000, 8, 200_000


class Boxes:
    """A tree over places in the plane: inner nodes cut a dimension at a value (what is no greater goes left), leaves have numbers."""

    def __init__(self, x: np.ndarray, most: int):
        """Cut until leaves have `most` places or all in one spot; order lists the places by leaf, starts says where each leaf's begin."""
        dim, at, kids, leaf, order, starts = [], [], [], [], [], [0]
        todo = [(np.arange(len(x)), None)]
        while todo:
            own, link = todo.pop()
            node = len(dim)
            if link:
                kids[link[0]][link[1]] = node
            spread = np.ptp(x[own], axis=0) if len(own) else np.zeros(2)
            d = int(np.argmax(spread))
            dim.append(d)
            kids.append([node, node])
            if len(own) <= most or spread[d] == 0:
                leaf.append(len(starts) - 1)
                at.append(0.0)
                order.append(own)
                starts.append(starts[-1] + len(own))
                continue
            v = x[own, d]
            cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if cut == v.max():
                cut = v[v < cut].max()
            leaf.append(-1)
            at.append(float(cut))
            todo += [(own[v > cut], (node, 1)), (own[v <= cut], (node, 0))]
        self.dim, self.at, self.kids, self.leaf = np.array(dim), np.array(at), np.array(kids), np.array(leaf)
        self.order, self.starts = np.concatenate(order), np.array(starts)
        self.fit(np.array([[*x[o].min(axis=0), *x[o].max(axis=0)] if len(o) else [np.inf, np.inf, -np.inf, -np.inf] for o in order]))

    def fit(self, boxes: np.ndarray) -> None:
        """Take the leaves' boxes (x0, y0, x1, y1), of which empty ones begin at infinity, and give each inner node that of its children."""
        self.box = np.zeros((len(self.dim), 4))
        self.box[self.leaf >= 0] = boxes[self.leaf[self.leaf >= 0]]
        for i in range(len(self.dim) - 1, -1, -1):  # children come behind their parents
            if self.leaf[i] < 0:
                a, b = self.box[self.kids[i]]
                self.box[i] = [*np.minimum(a[:2], b[:2]), *np.maximum(a[2:], b[2:])]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the leaves in which points lie."""
        node = np.zeros(len(x), int)
        while (self.leaf[node] < 0).any():
            node = self.kids[node, (x[np.arange(len(x)), self.dim[node]] > self.at[node]).astype(int)]
        return self.leaf[node]

    def near(self, x: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(points, leaves): for each point the leaves that may hold its nearest place, or one no more than `slack` further away."""
        who, node, bound = np.arange(len(x)), np.zeros(len(x), int), np.full(len(x), np.inf)
        while True:
            box, at = self.box[node], x[who]
            out = np.maximum(np.maximum(box[:, :2] - at, at - box[:, 2:]), 0)
            far = np.maximum(np.abs(at - box[:, :2]), np.abs(at - box[:, 2:]))
            full = np.isfinite(box[:, 0])
            begins, ends = np.where(full, np.hypot(*out.T), np.inf), np.where(full, np.hypot(*far.T), np.inf)
            np.minimum.at(bound, who, ends * (1 + 1e-12) + slack)
            keep = full & (begins * (1 - 1e-12) <= bound[who])
            who, node = who[keep], node[keep]
            inner = self.leaf[node] < 0
            if not inner.any():
                return who, self.leaf[node]
            who = np.concatenate([who[~inner], np.repeat(who[inner], 2)])
            node = np.concatenate([node[~inner], self.kids[node[inner]].ravel()])


def _slack(digits: int | None) -> float:
    """How far apart distances may be that round to one value, with room for errors of arithmetic."""
    return 0.0 if digits is None else 2 * 10.0**-digits


def _rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances to so many decimals, halves up."""
    if digits is None:
        return d
    v = d * 10.0**digits
    low = np.floor(v)
    return np.where(np.isfinite(v), (low + (v - low >= 0.5)) / 10.0**digits, d)


def _best(x: np.ndarray, places: np.ndarray, ids: np.ndarray, tree: Boxes, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each point the id of its nearest place, of several the smallest, and the distance."""
    dist, best = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
    who, leaf = tree.near(x, _slack(digits))
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    for k, start in zip(*np.unique(leaf, return_index=True)):
        own = tree.order[tree.starts[k] : tree.starts[k + 1]]
        asking = who[start : start + np.searchsorted(leaf[start:], k, "right")]
        for some in np.array_split(asking, max(1, len(asking) * len(own) // 1_000_000)):
            d = _rounded(np.sqrt(((x[some, None] - places[None, own]) ** 2).sum(axis=2)), digits)
            least = d.min(axis=1)
            first = np.where(d == least[:, None], ids[None, own], np.iinfo(np.int64).max).min(axis=1)
            better = (least < dist[some]) | ((least == dist[some]) & (first < best[some]))
            dist[some[better]], best[some[better]] = least[better], first[better]
    return best, dist


def _xy(b: pa.RecordBatch, x: str, y: str) -> np.ndarray:
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (x, y)], axis=1).astype(float)


def nearest(points: DataFrame, places: DataFrame, group: str, leaf: int = LEAF, digits: int | None = None) -> DataFrame:
    """(id, group, place_id, distance): for each point the nearest place of each group; ties by place_id.

    digits: distances are rounded to so many decimals first, and those that are equal then are ties; places as far on either side of a point
    may else differ in the last bit.
    points: id, x, y; places: place_id (a number), x, y, group. Places on one spot count as the one with the smallest id. Points and places without a
    coordinate, and places without a group, are left out. Groups are few (as hospitals, schools, stations): their names and trees are broadcast, with a
    sample of SAMPLE places in all and a thousand a group at most.
    """
    spark = points.sparkSession
    kinds, kept = dict(points.dtypes), dict(places.dtypes)
    out = f"id {kinds['id']}, `{group}` {kept[group]}, place_id long, distance double"
    own = places.select(F.col(group).alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("place_id").cast("long").alias("place_id")).na.drop()
    own = written(own.groupBy("g", "x", "y").agg(F.min("place_id").alias("place_id")), "places")
    sizes = {r["g"]: r["count"] for r in own.groupBy("g").count().collect()}
    if not sizes:
        return spark.createDataFrame([], out)
    total, names = sum(sizes.values()), sorted(sizes)
    # each group has its share of the sample, a small one up to a thousand places
    share = spark.createDataFrame([(g, min(1.0, max(SAMPLE / total, 1000 / n))) for g, n in sizes.items()], f"g {kept[group]}, share double")
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(7), "x", "y"), 11) / F.lit(float(1 << 53))
    some: dict = {g: [] for g in names}
    for r in own.join(F.broadcast(share), "g").filter(chance < F.col("share")).select("g", "x", "y").collect():
        some[r["g"]].append((r["x"], r["y"]))
    trees, first = [], [0]
    for g in names:
        x = np.array(some[g]).reshape(-1, 2)
        trees.append(Boxes(x, max(FEW, int(leaf * len(x) / sizes[g]))))
        first.append(first[-1] + len(trees[-1].starts) - 1)
    given = spark.sparkContext.broadcast((trees, first, {g: k for k, g in enumerate(names)}))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first, number = given.value
        for b in batches:
            of, x, leaf = np.array([number[g] for g in b.column(0).to_pylist()], int), _xy(b, "x", "y"), np.zeros(b.num_rows, np.int64)
            for k in np.unique(of):
                leaf[of == k] = first[k] + trees[k].leaf_of(x[of == k])
            yield pa.record_batch([pa.array(leaf), b.column(1), b.column(2), b.column(3)], ["leaf", "x", "y", "place_id"])

    lying = written(own.mapInArrow(placed, "leaf long, x double, y double, place_id long"), "places-placed")
    boxes = np.full((first[-1], 4), [np.inf, np.inf, -np.inf, -np.inf])
    for r in lying.groupBy("leaf").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect():
        boxes[r[0]] = r[1:]
    for k, tree in enumerate(trees):
        tree.fit(boxes[first[k] : first[k + 1]])
    fitted = spark.sparkContext.broadcast((trees, first))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, first = fitted.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _xy(part, "x", "y")
                for k, tree in enumerate(trees):
                    who, leaf = tree.near(x, _slack(digits))
                    rows = part.take(pa.array(who))
                    yield pa.record_batch([*rows.columns, pa.array(leaf + first[k])], ["id", "x", "y", "leaf"])

    asked = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop()
    asked = written(asked.mapInArrow(asking, f"id {kinds['id']}, x double, y double, leaf long"), "places-asked")
    salts = written(asked.groupBy("leaf").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")), "places-salts")  # a row a leaf at most
    salted = lambda t: t.join(F.broadcast(salts), "leaf")
    here = salted(lying).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    look = salted(asked).withColumn("salt", F.pmod(F.xxhash64("x", "y"), "salts").cast("int"))
    both = here.select("leaf", "salt", F.lit(0).alias("side"), F.lit(None).cast(kinds["id"]).alias("id"), "x", "y", "place_id").unionByName(look.select("leaf", "salt", F.lit(1).alias("side"), "id", "x", "y", F.lit(None).cast("long").alias("place_id")))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by leaf and salt, places before points: places are held, points go through."""
        held, tree, key = [], None, None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(starts, starts[1:]):
                if j == i:
                    continue
                part, now = b.slice(i, j - i), tuple(keys[i, :2])
                if now != key:
                    held, tree, key = [], None, now
                if keys[i, 2] == 0:
                    held.append((_xy(part, "x", "y"), part.column(6).to_numpy()))
                    continue
                if tree is None:
                    at, ids = np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
                    tree = Boxes(at, 64)
                best, dist = _best(_xy(part, "x", "y"), at, ids, tree, digits)
                g = names[int(np.searchsorted(first, now[0], "right")) - 1]
                yield pa.record_batch([part.column(3), pa.array([g] * part.num_rows), pa.array(best), pa.array(dist)], ["id", "g", "place_id", "distance"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(tasks, "leaf", "salt").sortWithinPartitions("leaf", "salt", "side").mapInArrow(matched, f"id {kinds['id']}, g {kept[group]}, place_id long, distance double")
    best = found.groupBy("id", "g").agg(F.min(F.struct("distance", "place_id")).alias("b"))
    return best.select("id", F.col("g").alias(group), "b.place_id", "b.distance")

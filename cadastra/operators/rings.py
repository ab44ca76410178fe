"""Polygons put together again from crossing edges: made valid, and drawn in by a distance so that they may fall apart.

Edges are cut where they meet. Of the pieces those stay that have the inside on one side only, which winding numbers tell; followed so
that the inside stays on the left, they give rings that neither cross nor run over a corner twice.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

#: Steps across a shape's width to which corners are rounded, and most pairs of edges or rays and edges at a time.
GRID, PAIRS = 2.0**32, 1 << 21


def _pairs(lo: np.ndarray, hi: np.ndarray):
    """Blocks of pairs (i, j) of intervals, in order of lo, that overlap."""
    last = np.searchsorted(lo, hi, "right")
    count = np.maximum(last - np.arange(len(lo)) - 1, 0)
    ends, at = np.cumsum(count), 0
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _noded(e: np.ndarray) -> np.ndarray:
    """Edges (x0, y0, x1, y1) on whole numbers cut at every point that they share with another."""
    e = e[np.argsort(np.minimum(e[:, 0], e[:, 2]), kind="stable")]
    p, d = e[:, :2], e[:, 2:] - e[:, :2]
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    cuts = [(np.arange(len(e)), np.zeros(len(e)), e[:, :2]), (np.arange(len(e)), np.ones(len(e)), e[:, 2:])]
    for i, j in _pairs(low[:, 0], high[:, 0]):
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        i, j = i[meet], j[meet]
        turn = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        w = p[j] - p[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[j, 1] - w[:, 1] * d[j, 0]) / turn
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / turn
        ok = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        x = np.rint(p[i[ok]] + t[ok, None] * d[i[ok]])
        cuts += [(i[ok], t[ok], x), (j[ok], u[ok], x)]
        # ends that lie on the other edge: within half a step of it
        for a, b, ends in ((i, j, (e[j, :2], e[j, 2:])), (j, i, (e[i, :2], e[i, 2:]))):
            long = (d[a] ** 2).sum(axis=1)
            for x in ends:
                v = x - p[a]
                along = (v * d[a]).sum(axis=1) / long
                off = np.abs(v[:, 0] * d[a, 1] - v[:, 1] * d[a, 0]) <= 0.5 * np.sqrt(long)
                ok = off & (along > 0) & (along < 1)
                cuts.append((a[ok], along[ok], x[ok]))
    of, t, x = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts]), np.concatenate([c[2] for c in cuts])
    order = np.lexsort((t, of))
    of, x = of[order], x[order]
    same = (of[1:] == of[:-1]) & (x[1:] != x[:-1]).any(axis=1)
    return np.hstack([x[:-1][same], x[1:][same]])


def _beyond(e: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each point the sum of n over the edges, upwards +, that a ray to the right crosses. Points are looked at in strips of their height."""
    out = np.zeros(len(at))
    low, high, up = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3]), np.sign(e[:, 3] - e[:, 1])
    order = np.argsort(at[:, 1], kind="stable")
    for some in np.array_split(order, min(1024, len(at) // 16 + 1)):
        near = np.flatnonzero((low <= at[some[-1], 1]) & (high >= at[some[0], 1]) & (up != 0))
        for part in np.array_split(some, max(1, len(some) * len(near) // PAIRS)):
            x, y, f = at[part, 0, None], at[part, 1, None], e[near]
            over = (f[None, :, 1] <= y) != (f[None, :, 3] <= y)
            side = (f[None, :, 2] - f[None, :, 0]) * (y - f[None, :, 1]) - (f[None, :, 3] - f[None, :, 1]) * (x - f[None, :, 0])
            out[part] = (over & (side * up[None, near] > 0)) @ (n[near] * up[near])
    return out


def _bounds_of_inside(e: np.ndarray, odd: bool) -> np.ndarray:
    """The pieces of edges with the inside on their left only: where the winding number is positive, or odd."""
    for _ in range(8):  # rounding may make new meetings
        before, e = len(e), _noded(e)
        if len(e) == before:
            break
    back = (e[:, 2] < e[:, 0]) | ((e[:, 2] == e[:, 0]) & (e[:, 3] < e[:, 1]))
    e = np.where(back[:, None], e[:, [2, 3, 0, 1]], e)
    e, of = np.unique(e, axis=0, return_inverse=True)
    n = np.bincount(of.ravel(), weights=np.where(back, -1.0, 1.0) if not odd else None, minlength=len(e))
    n = n % 2 if odd else n
    e, n = e[n != 0], n[n != 0]
    flat, middle = e[:, 1] == e[:, 3], (e[:, :2] + e[:, 2:]) / 2
    left, right = np.zeros(len(e)), np.zeros(len(e))
    # all go to the right or straight up: what goes down has its left side to the right, and what is flat is looked at from below
    right_of = _beyond(e, n, middle[~flat]) if (~flat).any() else np.zeros(0)
    up = e[~flat, 3] > e[~flat, 1]
    own = n[~flat]
    right[~flat], left[~flat] = np.where(up, right_of, right_of - own), np.where(up, right_of + own, right_of)
    if flat.any():
        turned = np.stack([e[:, 1], -e[:, 0], e[:, 3], -e[:, 2]], axis=1)  # a quarter turn: up is right
        left[flat] = _beyond(turned, n, np.stack([middle[flat, 1], -middle[flat, 0]], axis=1))
        right[flat] = left[flat] - n[flat]
    within = (lambda w: np.abs(w) % 2 == 1) if odd else (lambda w: w > 0)
    left, right = within(left), within(right)
    return np.vstack([e[left & ~right], e[right & ~left][:, [2, 3, 0, 1]]])


def _traced(e: np.ndarray) -> list[np.ndarray]:
    """Rings of edges: each goes on with the first edge clockwise from where it came, and is cut where it returns to a corner."""
    leaving = defaultdict(list)
    for a, b, c, d in e.tolist():
        leaving[a, b].append((math.atan2(d - b, c - a), (c, d)))
    rings = []
    for start in list(leaving):
        while leaving[start]:
            path, seen, here = [start], {start: 0}, leaving[start].pop()[1]
            while True:
                if here in seen:
                    k = seen[here]
                    rings.append(np.array([*path[k:], here]))
                    for x in path[k + 1 :]:
                        del seen[x]
                    path = path[: k + 1]
                    if not k:
                        break
                else:
                    seen[here] = len(path)
                    path.append(here)
                if not leaving[here]:
                    break  # an end that rounding has left open
                came = path[-2]
                back = math.atan2(came[1] - here[1], came[0] - here[0])
                turn = [(back - angle) % (2 * math.pi) or 2 * math.pi for angle, _ in leaving[here]]
                here = leaving[here].pop(int(np.argmin(turn)))[1]
    return rings


def area(r: np.ndarray) -> float:
    """A ring's area, positive against the clock."""
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(r: np.ndarray, x: float, y: float) -> bool:
    (x0, y0), (x1, y1) = r[:-1].T, r[1:].T
    over = (y0 > y) != (y1 > y)
    return bool((x < (x1 - x0)[over] * (y - y0[over]) / (y1 - y0)[over] + x0[over]).sum() % 2)


def rebuilt(rings: list[np.ndarray], odd: bool) -> list[list[np.ndarray]]:
    """Valid polygons, rings of points with the inside on their left, of what closed rings enclose: positively, or an odd number of times."""
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return []
    every = np.vstack(rings)
    corner, wide = every.min(axis=0), float(np.ptp(every, axis=0).max())
    step = wide / GRID if wide > 0 else 1.0
    whole = [np.rint((r - corner) / step) for r in rings]
    e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in whole])
    e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
    if not len(e):
        return []
    found = [(area(r), r) for r in _traced(_bounds_of_inside(e, odd)) if len(r) > 3]
    shells = sorted(((a, r, []) for a, r in found if a > 0), key=lambda x: x[0])
    for a, r in found:
        if a < 0:
            x, y = ((r[0] + r[1]) / 2).tolist()
            home = next((s for s in shells if s[0] > -a and _holds(s[1], x, y)), None)
            if home:
                home[2].append(r)
    # corners that were there before are given back as they were, new ones from the grid
    given = {tuple(a): b for a, b in zip(np.vstack(whole).tolist(), every.tolist())}
    exact = lambda r: np.array([given.get(tuple(x)) or (np.array(x) * step + corner).tolist() for x in r.tolist()])
    return [[exact(r) for r in (shell, *holes)] for _, shell, holes in shells]


def valid(shape: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Polygons whose rings may cross or run over each other, as valid ones: each by the odd rule over its rings, then all together."""
    parts = [rebuilt(p, odd=True) for p in shape]
    if len(parts) == 1:
        return parts[0]
    return rebuilt([r for p in parts for q in p for r in q], odd=False)


def _raw_inset(r: np.ndarray, by: float, quarter: int) -> np.ndarray:
    """A ring's edges moved to its left, joined by arcs where they part, and by way of the old corner where they cross."""
    r = r[:-1]
    u = np.roll(r, -1, axis=0) - r
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    left, before = np.stack([-u[:, 1], u[:, 0]], axis=1) * by, np.roll(u, 1, axis=0)
    out = []
    for k in range(len(r)):
        was = np.array([-before[k, 1], before[k, 0]]) * by
        turn = math.atan2(before[k, 0] * u[k, 1] - before[k, 1] * u[k, 0], float(before[k] @ u[k]))
        if turn >= 0:
            out += [r[k] + was, r[k], r[k] + left[k]]
        else:
            n = max(1, math.ceil(-turn / (math.pi / 2) * quarter - 1e-9))
            angles = [turn * i / n for i in range(n + 1)]
            out += [r[k] + np.array([was[0] * math.cos(a) - was[1] * math.sin(a), was[0] * math.sin(a) + was[1] * math.cos(a)]) for a in angles]
    return np.array([*out, out[0]])


def drawn_in(shape: list[list[np.ndarray]], by: float, quarter: int) -> list[list[np.ndarray]]:
    """Valid polygons of the points that lie `by` or more inside of the polygons, made valid first; arcs have `quarter` edges in a quarter turn."""
    return rebuilt([_raw_inset(r, by, quarter) for p in valid(shape) for r in p], odd=False)

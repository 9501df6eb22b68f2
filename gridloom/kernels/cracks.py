"""Borders of a region map: unit cracks between cells, arcs between junctions, walks around faces, and their proof.

Corners (v, u) count from the page's upper left one; u grows to the right, v downwards. A dart is a crack with a direction
(east, south, west, north); its left and right regions are those on its two sides, -1 outside the page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridloom.kernels.maps import OUT, settle

#: Steps of the four directions.
DV, DU = np.array([0, 1, 0, -1]), np.array([1, 0, -1, 0])


@dataclass
class Arc:
    """A chain of cracks with the same regions on its sides, from corner to corner."""

    left: int
    right: int
    closed: bool  # a loop without a junction
    points: np.ndarray  # (n, 2) corners (v, u); a loop ends where it began


@dataclass
class Face:
    region: int
    outer: list[tuple[int, bool]]  # (arc, whether it runs backwards)
    holes: list[list[tuple[int, bool]]]


def quads(regions: np.ndarray) -> np.ndarray:
    """The four cells around every corner: (north-west, north-east, south-west, south-east)."""
    pad = np.pad(regions, 1, constant_values=OUT)
    return np.stack([pad[:-1, :-1], pad[:-1, 1:], pad[1:, :-1], pad[1:, 1:]])


def junctions(regions: np.ndarray) -> np.ndarray:
    """Where three regions or more meet (outside counts as one), and the page's four corners."""
    q = quads(regions)
    kinds = 1 + sum(np.logical_and.reduce([q[i] != q[j] for j in range(i)]).astype(int) for i in (1, 2, 3))
    kinds[[0, 0, -1, -1], [0, -1, 0, -1]] = 3
    return kinds >= 3


class Darts:
    """The cracks that leave each corner, and the regions at their sides."""

    def __init__(self, regions: np.ndarray):
        q = quads(regions)
        self.wide = q.shape[2]
        # left and right cell of the dart east, south, west, north of a corner, as places in the quad
        sides = ((1, 3), (3, 2), (2, 0), (0, 1))
        self.left = np.stack([q[a] for a, _ in sides], -1).reshape(-1, 4)
        self.right = np.stack([q[b] for _, b in sides], -1).reshape(-1, 4)
        self.free = self.left != self.right
        self.step = (DV * self.wide + DU).tolist()

    def pairs(self) -> np.ndarray:
        """Number of cracks of the page."""
        return int(self.free[:, :2].sum())


def _raw_arcs(darts: Darts, stop: np.ndarray) -> list[tuple[int, int, bool, list[int]]]:
    """Arcs from junctions first, then loops; at a crossing of two regions the walk keeps left."""
    free, step = darts.free.copy(), darts.step
    live = [row for row in free.tolist()]
    stop = stop.ravel().tolist()
    out = []

    def walk(corner: int, d: int) -> list[int]:
        path, begin = [corner], corner
        while True:
            live[corner][d] = False
            corner += step[d]
            live[corner][d ^ 2] = False
            path.append(corner)
            if stop[corner] or corner == begin:
                return path
            row = live[corner]
            d = next(t for t in ((d + 3) & 3, d, (d + 1) & 3) if row[t])

    for anchors, loops in ((np.flatnonzero(stop), False), (np.flatnonzero(free.any(1)), True)):
        for c in anchors.tolist():
            for d in range(2 if loops else 4):
                while live[c][d]:
                    left, right = int(darts.left[c, d]), int(darts.right[c, d])
                    path = walk(c, d)
                    out.append((left, right, loops, path))
    return out


def arcs(regions: np.ndarray) -> list[Arc]:
    """All arcs, each in its canonical direction, in order of (least v, least u), sides, and first two corners.

    An open arc begins with the lesser of its two ends (end corner, then the one next to it); a loop begins at its least
    corner and goes on to the side that gives the lesser sequence.
    """
    darts = Darts(regions)
    found = []
    for left, right, closed, path in _raw_arcs(darts, junctions(regions)):
        if closed:
            ring = path[1:-1]
            turn = len(ring) > 1 and ring[::-1] < ring
        else:
            turn = (path[-1], path[-2]) < (path[0], path[1])
        if turn:
            left, right, path = right, left, path[::-1]
        points = np.column_stack(np.divmod(np.array(path), darts.wide))
        found.append(((int(points[:, 0].min()), int(points[:, 1].min()), left, right, path[0], path[1]), Arc(left, right, closed, points)))
    return [a for _, a in sorted(found, key=lambda f: f[0])]


def proof(regions: np.ndarray, found: list[Arc]) -> dict[str, int]:
    """Counts that must be 0: cracks without an arc or with two, wrong sides, and V - A + F - 1 - C."""
    darts = Darts(regions)
    h, w = regions.shape
    a = np.concatenate([x.points[:-1] for x in found])
    b = np.concatenate([x.points[1:] for x in found])
    n = np.array([len(x.points) - 1 for x in found])
    d = np.select([b[:, 1] > a[:, 1], b[:, 0] > a[:, 0], b[:, 1] < a[:, 1]], [0, 1, 2], 3)
    corner = a[:, 0] * (w + 1) + a[:, 1]
    wrong = (darts.left[corner, d] != np.repeat([x.left for x in found], n)) | (darts.right[corner, d] != np.repeat([x.right for x in found], n))
    low = np.minimum(a, b)
    crack = (low[:, 0] * (w + 1) + low[:, 1]) * 2 + (d & 1)
    once = len(np.unique(crack))
    stops = np.flatnonzero(junctions(regions))
    at = {c: i for i, c in enumerate(stops.tolist())}
    ends = np.array([[at[int(p[0]) * (w + 1) + int(p[1])] for p in (x.points[0], x.points[-1])] for x in found if not x.closed]).reshape(-1, 2)
    loops = sum(x.closed for x in found)
    parts = len(np.unique(settle(len(stops), ends[:, 0], ends[:, 1]))) + loops
    euler = len(stops) + loops - len(found) + int(regions.max()) + 2 - 1 - parts
    return {"twice": len(crack) - once, "missing": darts.pairs() - once, "wrong_sides": int(wrong.sum()), "euler": euler}


def ring(walk: list[tuple[int, bool]], points: list[np.ndarray]) -> np.ndarray:
    """The corners along a walk, the first one once."""
    return np.concatenate([(points[a][::-1] if back else points[a])[:-1] for a, back in walk])


def signed_area(xy: np.ndarray) -> float:
    """Of a ring of (v, u) or (y, x): positive where the region lies left of the walk."""
    y, x = xy[:, 0], xy[:, 1]
    return float((y * np.roll(x, -1) - np.roll(y, -1) * x).sum()) / 2


def faces(found: list[Arc], n_regions: int) -> list[Face]:
    """The outer walk and the holes (by least corner) of each region; the outside is checked and left out.

    A walk keeps its region on the left; at a junction it takes the sharpest left turn that does.
    """
    heading = lambda p, q: int(0 if q[1] > p[1] else 1 if q[0] > p[0] else 2 if q[1] < p[1] else 3)
    leaves, come = {}, {}
    for i, a in enumerate(found):
        if not a.closed:
            for back in (False, True):
                p, region = (a.points[::-1], a.right) if back else (a.points, a.left)
                leaves[tuple(p[0].tolist()), region, heading(p[0], p[1])] = (i, back)
                come[i, back] = tuple(p[-1].tolist()), region, heading(p[-2], p[-1])
    walks: dict[int, list[list[tuple[int, bool]]]] = {}
    done = set()
    for start in come:
        if start in done:
            continue
        half, walk = start, []
        while True:
            done.add(half)
            walk.append(half)
            corner, region, d = come[half]
            half = next(leaves[k] for t in ((d + 3) & 3, d, (d + 1) & 3) if (k := (corner, region, t)) in leaves)
            if half == start:
                break
        least = walk.index(min(walk))
        walks.setdefault(region, []).append(walk[least:] + walk[:least])
    for i, a in enumerate(found):
        if a.closed:
            walks.setdefault(a.left, []).append([(i, False)])
            walks.setdefault(a.right, []).append([(i, True)])
    points, out = [a.points for a in found], []
    for region in range(n_regions):
        outer, holes = [], []
        for walk in walks.get(region, []):
            corners = ring(walk, points)
            if signed_area(corners) > 0:
                outer.append(walk)
            else:
                holes.append((tuple(corners.min(0).tolist()), walk))
        if len(outer) != 1:
            raise ValueError(f"region {region} has {len(outer)} outer walks")
        out.append(Face(region, outer[0], [w for _, w in sorted(holes, key=lambda x: x[0])]))
    return out


def face_area(face: Face, points: list[np.ndarray]) -> float:
    return sum(signed_area(ring(w, points)) for w in [face.outer, *face.holes])

"""Label maps as arrays: components, region graphs, majority filter, opening of small areas, holes, merging, folding.

A cell outside the page, or without a label, is -1. Everything is vectorised over cells; Python loops run over regions only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

OUT = -1


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under the links (a, b): minimum hooking and pointer jumping."""
    top = np.arange(n)
    while len(a):
        ra, rb = top[a], top[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        low = np.minimum(ra, rb)
        np.minimum.at(top, np.maximum(ra, rb), low)
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up
    return top


def components(labels: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """4-connected (or 8-connected) components of equal label, numbered by first cell in raster order; OUT stays OUT."""
    h, w = labels.shape
    if not labels.size:
        return np.zeros((h, w), np.int64)
    head = np.ones((h, w), bool)
    head[:, 1:] = labels[:, 1:] != labels[:, :-1]
    run = np.cumsum(head.ravel()).reshape(h, w) - 1
    n = int(run[-1, -1]) + 1
    pairs = []
    for step in (0, 1, -1) if diagonal else (0,):
        up, down = slice(max(0, -step), w - max(0, step)), slice(max(0, step), w - max(0, -step))
        alike = labels[:-1, up] == labels[1:, down]
        pairs.append(np.stack((run[:-1, up][alike], run[1:, down][alike])))
    links = np.unique(np.concatenate(pairs, axis=1), axis=1)
    top = settle(n, links[0], links[1])
    there = labels.ravel()[np.flatnonzero(head.ravel())] != OUT
    names = np.full(n, OUT, np.int64)
    roots = np.unique(top[there])
    names[roots] = np.arange(len(roots))
    return np.where(labels == OUT, OUT, names[top][run])


def borders(regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, length) of adjacent regions a < b in order, and the cell sides of each region on the page's edge."""
    n = int(regions.max()) + 1
    pad = np.pad(regions, 1, constant_values=OUT)
    sides = [(pad[1:-1, :-1], pad[1:-1, 1:]), (pad[:-1, 1:-1], pad[1:, 1:-1])]
    p, q = (np.concatenate([s[k].ravel() for s in sides]) for k in (0, 1))
    p, q = np.minimum(p, q), np.maximum(p, q)
    edge = np.bincount(q[(p == OUT) & (q != OUT)], minlength=n)
    inner = (p != OUT) & (p != q)
    code, length = np.unique(p[inner] * n + q[inner], return_counts=True)
    return code // n, code % n, length, edge


def records(regions: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of each region: label and place of its first cell, area, box (inclusive), centroid, perimeter."""
    n = int(regions.max()) + 1
    y, x = np.nonzero(regions != OUT)
    r = regions[y, x]
    _, first = np.unique(r, return_index=True)
    area = np.bincount(r, minlength=n)
    out = {"label": labels[y[first], x[first]], "area": area, "seed_y": y[first], "seed_x": x[first], "cy": np.bincount(r, y, n) / area, "cx": np.bincount(r, x, n) / area}
    for name, at, low in (("r0", y, True), ("c0", x, True), ("r1", y, False), ("c1", x, False)):
        v = np.full(n, at.max() if low else 0)
        (np.minimum if low else np.maximum).at(v, r, at)
        out[name] = v
    a, b, length, edge = borders(regions)
    out["border"], out["perimeter"] = edge, edge + np.bincount(a, length, n).astype(np.int64) + np.bincount(b, length, n).astype(np.int64)
    return out


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """a moved so that cell (y, x) holds a[y + dy, x + dx]."""
    h, w = a.shape
    out = np.full_like(a, fill)
    ys, xs = slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx))
    yt, xt = slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx))
    out[ys, xs] = a[yt, xt]
    return out


def majority(labels: np.ndarray, delta: np.ndarray | None = None, rounds: int = 1) -> np.ndarray:
    """3x3 majority, repeated until nothing changes or the rounds are spent.

    Ties go to the label nearest in colour to the cell's own (delta[own, other]; without it all others are equally far),
    then to the lowest. Nine shifted copies are compared, so the cost doesn't grow with the number of labels.
    """
    for _ in range(rounds):
        around = np.stack([shifted(labels, dy, dx, OUT) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        best, key = labels.copy(), None
        for cand in around:
            n = (around == cand).sum(0)
            far = (cand != labels) * 1.0 if delta is None else delta[labels, cand]
            mine = np.where(cand == OUT, -1, n), -far, -cand
            if key is None:
                key, best = mine, np.where(cand == OUT, best, cand)
                continue
            better = (mine[0] > key[0]) | ((mine[0] == key[0]) & ((mine[1] > key[1]) | ((mine[1] == key[1]) & (mine[2] > key[2]))))
            key = tuple(np.where(better, m, k) for m, k in zip(mine, key, strict=True))
            best = np.where(better, cand, best)
        best = np.where(labels == OUT, OUT, best)
        if np.array_equal(best, labels):
            break
        labels = best
    return labels


def open_small(labels: np.ndarray, threshold: float, delta: np.ndarray | None = None) -> np.ndarray:
    """Components below threshold take the label of a neighbour: one that isn't small first, then the longest border, the least
    colour difference, the lowest label, the lowest id. Chains of small ones end where the last one does; members of a cycle
    keep their labels."""
    regions = components(labels)
    rec = records(regions, labels)
    a, b, length, _ = borders(regions)
    one, two, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((length, length))
    small = rec["area"] < threshold
    use = small[one]
    one, two, w = one[use], two[use], w[use]
    far = (rec["label"][one] != rec["label"][two]) * 1.0 if delta is None else delta[rec["label"][one], rec["label"][two]]
    order = np.lexsort((two, rec["label"][two], far, -w, small[two], one))
    who, first = np.unique(one[order], return_index=True)
    into = np.arange(len(small))
    into[who] = two[order][first]
    end = into
    for _ in range(max(1, int(len(small)).bit_length())):
        end = end[end]
    end = np.where(into[end] == end, end, np.arange(len(end)))
    return np.where(regions == OUT, OUT, rec["label"][end][regions])


def fill_holes(labels: np.ndarray, most: float) -> np.ndarray:
    """Components off the page's edge, with one neighbour and at most this area, take its label (judged on the given map)."""
    regions = components(labels)
    rec = records(regions, labels)
    a, b, _, _ = borders(regions)
    one, two = np.concatenate((a, b)), np.concatenate((b, a))
    n = np.bincount(one, minlength=len(rec["area"]))
    near = np.zeros(len(n), np.int64)
    near[one] = two
    hole = (n == 1) & (rec["border"] == 0) & (rec["area"] <= most)
    return np.where(regions == OUT, OUT, np.where(hole, rec["label"][near], rec["label"])[regions])


def contract(label: np.ndarray, area: np.ndarray, rim: np.ndarray, edges: tuple, cost: Callable, floor: float, spared: Callable | None = None) -> np.ndarray:
    """The region that each region ends in: the smallest (area, id) below floor merges first, into its neighbour of least
    (cost(own label, other label, border, own perimeter), -area, id). spared(label, labels of neighbours): it stays."""
    n = len(label)
    area, rim = area.tolist(), rim.tolist()
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in zip(*(e.tolist() for e in edges), strict=True):
        near[a][b] = near[b][a] = w
    into = list(range(n))
    heap = [(s, r) for r, s in enumerate(area) if s < floor]
    heapq.heapify(heap)
    while heap:
        s, r = heapq.heappop(heap)
        if into[r] != r or area[r] != s or not near[r] or (spared and spared(label[r], [label[m] for m in near[r]])):
            continue
        t = min(near[r], key=lambda m: (cost(label[r], label[m], near[r][m], rim[r]), -area[m], m))  # noqa: B023
        into[r] = t
        area[t] += s
        rim[t] += rim[r] - 2 * near[r][t]
        for m, w in near[r].items():
            del near[m][r]
            if m != t:
                near[m][t] = near[t][m] = near[t].get(m, 0) + w
        near[r] = {}
        if area[t] < floor:
            heapq.heappush(heap, (area[t], t))
    end = np.array(into, np.int64)
    while not np.array_equal(end, end[end]):
        end = end[end]
    return end


def merge_tiny(labels: np.ndarray, lab: np.ndarray, delta: np.ndarray, floor: float, weight: float = 15.0, dark: float = 0.0, lighter: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(regions, label of each region in the new palette, new number of each old label, -1 if it is gone).

    The cost is the colour difference less weight * border / perimeter. A region darker than `dark` whose neighbours are all
    lighter by `lighter` or more stays. Labels without cells leave the palette, unless fewer than two would be left.
    """
    regions = components(labels)
    if floor >= regions.size:
        raise ValueError("the least area exceeds the page")
    rec = records(regions, labels)
    a, b, w, _ = borders(regions)
    own = rec["label"]
    spared = None
    if dark > 0:
        spared = lambda k, around: lab[k, 0] < dark and all(lab[m, 0] - lab[k, 0] >= lighter for m in around)
    end = contract(own, rec["area"], rec["perimeter"], (a, b, w), lambda k, m, border, rim: delta[k, m] - weight * border / rim, floor, spared)
    alive = np.flatnonzero(end == np.arange(len(end)))
    name = np.full(len(end), OUT)
    name[alive] = np.arange(len(alive))
    regions = np.where(regions == OUT, OUT, name[end][regions])
    cover = np.bincount(own[alive], np.bincount(end, rec["area"], len(end))[alive], len(lab))
    kept = np.flatnonzero(cover > 0)
    new = np.arange(len(lab))
    if len(kept) >= 2:
        new = np.full(len(lab), OUT)
        new[kept] = np.arange(len(kept))
    return regions, new[own[alive]], new


def fold(labels: np.ndarray, tiny: Callable[[dict[str, np.ndarray]], np.ndarray], rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(regions, label of each): regions that tiny(records) marks join a neighbour, until none does or the rounds are spent.

    The neighbour: the same label first, then the largest area, the longest border, the lowest id; two that choose each
    other, and chains, become one region with the label of its largest member.
    """
    regions = components(labels)
    rec = records(regions, labels)
    own = rec["label"]
    for _ in range(rounds):
        mark = tiny(rec)
        a, b, w, _ = borders(regions)
        one, two, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
        use = mark[one]
        if not use.any():
            break
        one, two, w = one[use], two[use], w[use]
        order = np.lexsort((two, -w, -rec["area"][two], own[two] != own[one], one))
        who, first = np.unique(one[order], return_index=True)
        top = settle(len(own), who, two[order][first])
        big = np.lexsort((np.arange(len(own)), -rec["area"], top))
        roots, lead = np.unique(top[big], return_index=True)
        name = np.full(len(own), OUT)
        name[roots] = np.arange(len(roots))
        regions = np.where(regions == OUT, OUT, name[top][regions])
        own = own[big][lead]
        rec = records(regions, np.where(regions == OUT, OUT, own[regions]))
    return regions, own

"""Image filters on arrays: area resize, bilateral and guided smoothing, local contrast, grey morphology, ink lines, skeletons, distances."""

from __future__ import annotations

import math

import numpy as np

from gridloom.kernels import colours, maps


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets within the radius."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def resize_area(img: np.ndarray, most: int) -> np.ndarray:
    """Area averages so that the longer side is `most`; smaller images stay. Sides round half to even."""
    h, w = img.shape[:2]
    f = min(1.0, most / max(h, w))
    th, tw = max(1, round(h * f)), max(1, round(w * f))

    def weights(n: int, t: int) -> np.ndarray:
        # of target i: the overlap of [i n, (i + 1) n) with source j's [j t, (j + 1) t), in units of 1 / (n t)
        i, j = np.arange(t)[:, None], np.arange(n)[None, :]
        return np.maximum(0, np.minimum((i + 1) * n, (j + 1) * t) - np.maximum(i * n, j * t)) / n

    if f == 1.0:
        return img
    return np.einsum("ij,jkc,lk->ilc", weights(h, th), img, weights(w, tw), optimize=True)


def bilateral(img: np.ndarray, sigma_color: float = 0.08, sigma_space: float = 5.0, passes: int = 2) -> np.ndarray:
    """Means of the neighbours in a disk of radius ceil(2 sigma_space), by nearness and by sum of channel differences; borders mirror."""
    r = math.ceil(2 * sigma_space)
    h, w = img.shape[:2]
    for _ in range(passes):
        pad = np.pad(img, ((r, r), (r, r), (0, 0)), mode="reflect" if min(h, w) > r else "symmetric")
        total, weight = np.zeros_like(img), np.zeros((h, w, 1), img.dtype)
        for dy, dx in disk(r):
            near = pad[r + dy : r + dy + h, r + dx : r + dx + w]
            d = np.abs(near - img).sum(2, keepdims=True)
            g = np.exp(-(d * d) / (2 * sigma_color**2) - (dy * dy + dx * dx) / (2 * sigma_space**2))
            total += g * near
            weight += g
        img = total / weight
    return img


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1)-squares; borders repeat mirrored with the edge."""
    p = np.pad(a, r, mode="symmetric").astype(float)
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def guided(img: np.ndarray, r: int = 8, eps: float = 1e-3, passes: int = 2) -> np.ndarray:
    """Guided filter (He, Sun and Tang 2013) with the mean of the channels as guide."""
    for _ in range(passes):
        g = img.mean(2)
        mg = box(g, r)
        spread = box(g * g, r) - mg * mg + eps
        out = []
        for c in range(img.shape[2]):
            p = img[:, :, c]
            mp = box(p, r)
            a = (box(g * p, r) - mg * mp) / spread
            out.append(box(a, r) * g + box(mp - a * mg, r))
        img = np.clip(np.stack(out, -1), 0, 1)
    return img


def local_contrast(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of lightness alone (CLAHE): histograms of 256 bins in tiles x tiles, blended bilinearly."""
    lab = colours.lab_of(img)
    v = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(int)
    h, w = v.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(v, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
    curve = np.zeros((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            over = np.maximum(n - limit, 0).sum()
            curve[i, j] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: curve[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], v]
    lab[..., 0] = np.clip((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1)), 0, 255) / 2.55
    return colours.rgb_of(lab)


def edge_density(img: np.ndarray, threshold: float = 0.1) -> float:
    """Share of pixels whose 3x3 Sobel magnitude on L/100 exceeds the threshold; borders mirror without the edge row."""
    p = np.pad(colours.lab_of(img)[..., 0] / 100, 1, mode="reflect")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    cols = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return float((np.hypot(rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]) > threshold).mean())


def image_stats(img: np.ndarray) -> dict[str, float]:
    """Colourfulness, entropy of 64 lightness bins, edge density, means and deviations."""
    lab = colours.lab_of(img)
    rg, yb = (img[..., 0] - img[..., 1]) * 255, ((img[..., 0] + img[..., 1]) / 2 - img[..., 2]) * 255
    n = np.bincount(np.minimum(63, (np.clip(lab[..., 0], 0, 100) / 100 * 64).astype(int)).ravel(), minlength=64) / lab[..., 0].size
    own = {f"{k}_{c}": float(f(lab[..., i])) for i, c in enumerate("lab") for k, f in (("mean", np.mean), ("std", np.std))}
    return own | {
        "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())), "entropy_bits": float(-(n[n > 0] * np.log2(n[n > 0])).sum()),
        "edge_density": edge_density(img), "saturation": float(np.hypot(lab[..., 1], lab[..., 2]).mean()),
    }


def grey_morph(a: np.ndarray, offsets: list[tuple[int, int]], grow: bool) -> np.ndarray:
    """Maximum (grow) or minimum over the offsets; nothing counts beyond the border."""
    fill = -np.inf if grow else np.inf
    out = np.full(a.shape, fill)
    for dy, dx in offsets:
        out = (np.maximum if grow else np.minimum)(out, maps.shifted(a.astype(float), dy, dx, fill))
    return out


def ink_lines(img: np.ndarray, labels: np.ndarray, palette_l: np.ndarray, px_a_mm: float, width_mm: float = 0.6, contrast: float = 8.0, dark: float = 55.0, survived: float = 25.0, length_mm: float = 2.0) -> np.ndarray:
    """Cells of thin dark lines: darker than their closing by `contrast` and than `dark`, lost by quantisation (their colour's lightness is
    `survived` or more), no part of a disk as wide as width_mm, in 8-connected pieces of length_mm cells or more."""
    if px_a_mm <= 0:
        return np.zeros(labels.shape, bool)
    light = colours.lab_of(img)[..., 0]
    line = disk(max(1, math.ceil(width_mm / 2 * px_a_mm)))
    found = (grey_morph(grey_morph(light, line, True), line, False) - light > contrast) & (light < dark) & (palette_l[labels] >= survived)
    wide = disk(max(1, math.ceil(width_mm * px_a_mm)))
    blob = grey_morph(np.where(grey_morph(found, wide, False) > 0.5, 1.0, 0.0), wide, True) > 0.5
    found &= ~blob
    pieces = maps.components(np.where(found, 0, maps.OUT), diagonal=True)
    if not found.any():
        return found
    size = np.bincount(pieces[found])
    return found & (size[pieces] >= max(1, round(length_mm * px_a_mm)))


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Centre lines one cell wide (Zhang and Suen 1984)."""
    m = mask.copy()
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        before = m.copy()
        for first in (True, False):
            p = [maps.shifted(m, dy, dx, False) for dy, dx in ring]
            n = sum(q.astype(int) for q in p)
            turns = sum((~p[i] & p[(i + 1) % 8]).astype(int) for i in range(8))
            a = (p[0] & p[2] & p[4], p[2] & p[4] & p[6]) if first else (p[0] & p[2] & p[6], p[0] & p[4] & p[6])
            m = m & ~(m & (n >= 2) & (n <= 6) & (turns == 1) & ~a[0] & ~a[1])
        if np.array_equal(before, m):
            return m


def skeleton_lines(mask: np.ndarray) -> list[np.ndarray]:
    """Chains (y, x) of a skeleton between its ends and forks, then its loops; each link of neighbouring cells is in one chain."""
    sk = skeleton(mask)
    ring = ((0, 1), (1, 0), (0, -1), (-1, 0), (-1, 1), (1, 1), (1, -1), (-1, -1))
    near: dict[tuple[int, int], list[tuple[int, int]]] = {}
    cells = {(int(y), int(x)) for y, x in np.argwhere(sk)}
    for y, x in cells:
        side = [(y + dy, x + dx) for dy, dx in ring[:4] if (y + dy, x + dx) in cells]
        # a diagonal link only where no two straight ones join the same cells
        cross = [(y + dy, x + dx) for dy, dx in ring[4:] if (y + dy, x + dx) in cells and (y + dy, x) not in cells and (y, x + dx) not in cells]
        near[y, x] = side + cross
    used: set[tuple] = set()
    out = []

    def run(a, b):
        line = [a, b]
        used.update(((a, b), (b, a)))
        while len(near[b]) == 2 and b != line[0]:
            c = next((n for n in near[b] if (b, n) not in used), None)
            if c is None:
                break
            used.update(((b, c), (c, b)))
            line.append(c)
            b = c
        out.append(np.array(line))

    for a in sorted(cells, key=lambda c: (len(near[c]) == 2, c)):
        for b in near[a]:
            if (a, b) not in used:
                run(a, b)
    return out


def distance(feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distance, y, x of the nearest feature cell; ties: the least y, then x); -1 where there is no feature at all.

    Columns first, by running extremes; then growing steps along the rows until no step can be nearer.
    """
    h, w = feature.shape
    if not feature.any():
        none = np.full((h, w), -1, np.int64)
        return none, none.copy(), none.copy()
    y = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(feature, y, -(10 * (h + w))), 0)
    down = np.minimum.accumulate(np.where(feature, y, 10 * (h + w))[::-1], 0)[::-1]
    near = np.where(y - up <= down - y, up, down)
    return row_distance((near - y) ** 2, np.where((near >= 0) & (near < h), near, -1))


def row_distance(g: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the squared distance inside each column and the row it leads to (-1: none): the same over all columns of the row."""
    h, w = g.shape
    big = np.int64(4) * (h + w + int(near.max(initial=0)) + 2) ** 2
    d = np.where(near < 0, big, g.astype(np.int64))
    at_y, at_x = near.copy(), np.broadcast_to(np.arange(w), (h, w)).copy()
    base = d.copy()
    k = 1
    while k < w and (np.int64(k) * k <= d.max()):
        for step in (-k, k):
            cand = maps.shifted(base, 0, step, big) + k * k
            cy, cx = maps.shifted(near, 0, step, -1), np.arange(w)[None, :] + step
            better = (cand < d) | ((cand == d) & ((cy < at_y) | ((cy == at_y) & (cx < at_x)))) & (cy >= 0)
            d, at_y, at_x = np.where(better, cand, d), np.where(better, cy, at_y), np.where(better, cx, at_x)
        k += 1
    none = at_y < 0
    return np.where(none, -1, d), at_y, np.where(none, -1, at_x)

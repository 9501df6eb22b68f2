"""Quantisation of colours: seeded k-means, median cut, merging of close centres, exact means."""

from __future__ import annotations

import hashlib

import numpy as np

from gridloom.kernels import colours

RESTARTS, STILL, BLOCK = 4, 0.05, 65536


def stage_seed(seed: int, stage: str = "quantize", mark: str = "\x1f") -> int:
    """The first 8 bytes of SHA-256 over seed, mark and stage name."""
    return int.from_bytes(hashlib.sha256(f"{seed}{mark}{stage}".encode()).digest()[:8], "big")


def stride_sample(rows: np.ndarray, most: int) -> np.ndarray:
    """Rows 0, s, 2s, ..., exactly `most` of them (all if there are fewer)."""
    return rows if len(rows) <= most else rows[:: len(rows) // most][:most]


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, by one matrix product."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the nearest centre (ties: the lowest) in blocks."""
    return np.concatenate([squares(x[i : i + BLOCK], centres).argmin(1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])


def spread_seeds(x: np.ndarray, k: int, stream: int) -> np.ndarray:
    """k-means++: the first row by the stream's number, each other one by chance in proportion to its squared distance."""
    rng = np.random.Generator(np.random.PCG64(stream))
    chosen = [x[stream % len(x)]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and far.sum() > 0:
        chosen.append(x[int(rng.choice(len(x), p=far / far.sum()))])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen + [chosen[0]] * (k - len(chosen)))


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int = 50, still: float = STILL) -> tuple[np.ndarray, float, int]:
    """(centres, inertia, rounds used): means of the nearest rows until no centre moves by `still`; an empty class starts again at the
    row farthest from its centre."""
    used = 0
    for used in range(1, rounds + 1):  # noqa: B007
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, c], len(centres)) for c in range(x.shape[1])], 1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = ((x - new[at]) ** 2).sum(1)
            for c in empty:
                worst = int(far.argmax())
                new[c], far[worst] = x[worst], 0
        moved = float(np.sqrt(((new - centres) ** 2).sum(1)).max())
        centres = new
        if moved < still and not len(empty):
            break
    return centres, float(squares(x, centres).min(1).sum()), used


def kmeans(x: np.ndarray, k: int, base: int, rounds: int = 50, restarts: int = RESTARTS) -> np.ndarray:
    """The centres of least inertia over the restarts (ties: the first)."""
    tries = [lloyd(x, spread_seeds(x, k, base + r), rounds) for r in range(restarts)]
    return min(tries, key=lambda t: t[1])[0]


def median_cut(x: np.ndarray, k: int) -> np.ndarray:
    """Means of k boxes: the box with the widest axis is halved at that axis' median (in stable order) each time."""
    boxes = [x]
    while len(boxes) < k:
        width = [np.ptp(b, axis=0) if len(b) > 1 else np.zeros(x.shape[1]) for b in boxes]
        i = int(np.argmax([w.max() for w in width]))
        if width[i].max() <= 0:
            break
        b = boxes[i][np.argsort(boxes[i][:, int(width[i].argmax())], kind="stable")]
        boxes[i : i + 1] = [b[: len(b) // 2], b[len(b) // 2 :]]
    return np.array([b.mean(0) for b in boxes])


def merge_close(centres: np.ndarray, labels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest centres (CIEDE2000; ties: first in order) become their weighted mean while nearer than `least` and more than two are left."""
    n = np.bincount(labels, minlength=len(centres)).astype(float)
    into = np.arange(len(centres))
    live = list(range(len(centres)))
    centres = centres.copy()
    while len(live) > 2:
        d = colours.table(centres[live])
        np.fill_diagonal(d, np.inf)
        i, j = sorted(divmod(int(d.argmin()), len(live)))
        if d[i, j] >= least:
            break
        a, b = live[i], live[j]
        if n[a] + n[b] > 0:
            centres[a] = (centres[a] * n[a] + centres[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        into[into == b] = a
        live.remove(b)
    place = np.zeros(len(centres), np.int64)
    place[live] = np.arange(len(live))
    return centres[live], place[into][labels]


def ranked(x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, counts, labels): exact means; classes in falling count, ties by their means."""
    n = np.bincount(labels, minlength=k)
    means = np.stack([np.bincount(labels, x[:, c].astype(float), k) for c in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None]
    order = np.lexsort((*means.T[::-1], -n))
    rank = np.empty(k, np.int64)
    rank[order] = np.arange(k)
    return means[order], n[order], rank[labels]


def quantise(rgb: np.ndarray, n_colors: int = 16, merge_delta_e: float = 7.0, sample_px: int = 100_000, max_iter: int = 50, impl: str = "labkmeans", seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label map, palette in CIELAB, counts) of an image (h, w, 3) in [0, 1]. A flat image gets two colours half a step apart."""
    if not 2 <= n_colors <= 64:
        raise ValueError(f"n_colors must be 2 to 64, not {n_colors}")
    flat = colours.lab_of(rgb).astype(np.float32).reshape(-1, 3)
    x = stride_sample(flat, max(sample_px, 100 * n_colors)).astype(float)
    if impl not in ("labkmeans", "mediancut"):
        raise ValueError(f"no quantiser {impl}")
    centres = kmeans(x, n_colors, stage_seed(seed), max_iter) if impl == "labkmeans" else median_cut(x, n_colors)
    centres, labels = merge_close(centres, nearest(flat, centres.astype(np.float32)), merge_delta_e)
    if len(centres) < 2 or not np.ptp(centres, axis=0).max() > 0:
        mid = centres[0]
        centres = mid + np.array([[0.5, 0, 0], [-0.5, 0, 0]])
        labels = (flat[:, 0] < mid[0]).astype(np.int64)
    means, n, labels = ranked(flat, labels, len(centres))
    return labels.reshape(rgb.shape[:2]), means, n

"""Kernels against plain definitions: maps, cracks, clusters, filters, curves, labels, pages, conversion."""

import math
import struct
import zlib

import numpy as np
import pytest

from gridloom.kernels import checks, cluster, colours, cracks, curves, filters, maps, page, place
from gridloom.plans import config, convert
from gridloom.sources import images
from tests.test_grid import flood


@pytest.fixture(scope="module")
def maps_():
    r = np.random.default_rng(5)
    return [r.integers(0, r.integers(1, 5), (int(r.integers(1, 9)), int(r.integers(1, 9)))) for _ in range(120)]


def around(m, y, x):
    return [(y + dy, x + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= y + dy < m.shape[0] and 0 <= x + dx < m.shape[1]]


def test_components_records_and_borders(maps_):
    for m in maps_:
        reg = maps.components(m)
        assert np.array_equal(reg, flood(m))
        rec = maps.records(reg, m)
        for k in range(reg.max() + 1):
            y, x = np.nonzero(reg == k)
            assert (rec["area"][k], rec["seed_y"][k], rec["r1"][k], rec["c0"][k]) == (len(y), y[0], y.max(), x.min())
            sides = sum(4 - sum(reg[c] == k for c in around(m, a, b)) for a, b in zip(y, x, strict=True))
            assert rec["perimeter"][k] == sides and math.isclose(rec["cy"][k], y.mean())
    diagonal = maps.components(np.array([[0, -1, 0], [-1, 0, -1]]), diagonal=True)
    assert diagonal.max() == 0 and (diagonal == -1).sum() == 3


def plain_majority(m, delta):
    out = m.copy()
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            n = {}
            for a in range(max(0, y - 1), min(m.shape[0], y + 2)):
                for b in range(max(0, x - 1), min(m.shape[1], x + 2)):
                    n[m[a, b]] = n.get(m[a, b], 0) + 1
            out[y, x] = max(n, key=lambda c: (n[c], -delta[m[y, x], c], -c))
    return out


def plain_opening(m, least, delta):
    reg = flood(m)
    area, label = np.bincount(reg.ravel()), {int(k): int(m[np.unravel_index((reg == k).argmax(), m.shape)]) for k in range(reg.max() + 1)}
    border = {}
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            for c in around(m, y, x):
                if reg[c] != reg[y, x]:
                    border[reg[y, x], reg[c]] = border.get((reg[y, x], reg[c]), 0) + 1
    into = {}
    for k in label:
        near = [b for a, b in border if a == k]
        if area[k] < least and near:
            into[k] = min(near, key=lambda b: (area[b] < least, -border[k, b], delta[label[k], label[b]], label[b], b))
    end = {}
    for k in label:
        seen, at = [], k
        while at in into and at not in seen:
            seen.append(at)
            at = into[at]
        end[k] = k if at in seen else at
    return np.vectorize(lambda k: label[end[int(k)]])(reg)


def test_majority_opening_and_holes(maps_):
    r = np.random.default_rng(1)
    delta = np.abs(r.random((5, 5)))
    delta = delta + delta.T
    np.fill_diagonal(delta, 0)
    for m in maps_:
        one = plain_majority(m, delta)
        assert np.array_equal(maps.majority(m, delta, 1), one)
        assert np.array_equal(maps.majority(m, delta, 2), plain_majority(one, delta))
        assert np.array_equal(maps.open_small(m, 3, delta), plain_opening(m, 3, delta))
    ring = np.zeros((5, 5), int)
    ring[1:4, 1:4] = 1
    ring[2, 2] = 2
    assert maps.fill_holes(ring, 1)[2, 2] == 1 and maps.fill_holes(ring, 0.5)[2, 2] == 2 and maps.fill_holes(ring, 9)[1, 1] == 1


def test_merging_spares_dark_dots_and_compacts(maps_):
    lab = np.array([[90.0, 0, 0], [70, 0, 0], [20, 0, 0], [50, 0, 0]])
    m = np.zeros((8, 8), int)
    m[2, 2], m[5, 5] = 2, 1
    regions, label, new = maps.merge_tiny(m, lab, colours.table(lab), 4.0)
    assert regions.max() == 0 and label.tolist() == [0] and new.tolist() == [0, 1, 2, 3]  # fewer than two colours: all stay
    regions, label, new = maps.merge_tiny(m, lab, colours.table(lab), 4.0, dark=48, lighter=16)
    assert regions.max() == 1 and label.tolist() == [0, 1] and new.tolist() == [0, -1, 1, -1]
    for k in maps_:
        if k.size > 6:
            regions, label, _ = maps.merge_tiny(k, np.vstack((lab, lab)), colours.table(np.vstack((lab, lab))), 5.0)
            n = np.bincount(regions.ravel())
            assert n.sum() == k.size and (len(n) == 1 or n.min() >= 5) and len(label) == len(n)


def test_folding():
    m = np.array([[0, 0, 0, 1], [0, 2, 2, 1], [3, 3, 1, 1]])
    regions, label = maps.fold(m, lambda rec: rec["area"] <= 2)
    assert np.bincount(regions.ravel()).sum() == m.size and np.bincount(regions.ravel()).min() > 2 and set(label) <= {0, 1}


def test_arcs_and_faces_are_proved(maps_):
    for m in maps_:
        reg = maps.components(m)
        arcs = cracks.arcs(reg)
        assert not any(cracks.proof(reg, arcs).values())
        faces = cracks.faces(arcs, reg.max() + 1)
        assert [cracks.face_area(f, [a.points for a in arcs]) for f in faces] == np.bincount(reg.ravel()).tolist()
        stop = cracks.junctions(reg)
        pad = np.pad(reg, 1, constant_values=-1)
        for v in range(stop.shape[0]):
            for u in range(stop.shape[1]):
                corner = v in (0, reg.shape[0]) and u in (0, reg.shape[1])
                assert stop[v, u] == (corner or len(set(pad[v : v + 2, u : u + 2].ravel().tolist())) >= 3)
        keys = []
        for a in arcs:
            ends = tuple(a.points[0].tolist()), tuple(a.points[-1].tolist())
            assert a.closed == (ends[0] == ends[1] and not stop[ends[0]])
            assert a.closed or (ends[0], tuple(a.points[1].tolist())) <= (ends[1], tuple(a.points[-2].tolist()))
            assert not a.closed or ends[0] == min(map(tuple, a.points.tolist()))
            keys.append((a.points[:, 0].min(), a.points[:, 1].min(), a.left, a.right))
        assert keys == sorted(keys)
    broken = cracks.arcs(maps.components(np.array([[0, 1]])))
    broken[0].left, broken[0].right = broken[0].right, broken[0].left
    assert cracks.proof(np.array([[0, 1]]), broken)["wrong_sides"] > 0
    assert cracks.proof(np.array([[0, 1]]), broken[1:])["missing"] > 0


def test_quantiser():
    r = np.random.default_rng(2)
    x = np.concatenate([c + r.normal(0, 0.5, (60, 3)) for c in ((20, 0, 0), (60, 30, 0), (80, 0, 40))])
    centres = cluster.kmeans(x, 3, cluster.stage_seed(0))
    assert sorted(np.round(centres[:, 0] / 20).tolist()) == [1, 3, 4]
    start = cluster.spread_seeds(x, 3, 11)
    last = np.inf
    for rounds in range(1, 6):
        got, inertia, _ = cluster.lloyd(x, start, rounds)
        assert inertia <= last + 1e-9
        last = inertia
    at = cluster.nearest(x, got)
    assert np.array_equal(at, ((x[:, None] - got[None]) ** 2).sum(2).argmin(1))
    # an empty class starts again at the farthest row
    got, _, _ = cluster.lloyd(x, np.array([[50.0, 10, 10], [1e6, 0, 0], [1e6, 1, 0]]), 8)
    assert len(set(cluster.nearest(x, got).tolist())) == 3
    boxes = cluster.median_cut(x, 3)
    assert len(boxes) == 3 and np.ptp(boxes[:, 0]) > 20
    assert len(cluster.median_cut(np.zeros((5, 3)), 4)) == 1
    merged, labels = cluster.merge_close(np.array([[50.0, 0, 0], [51, 0, 0], [90, 0, 0]]), np.array([0, 0, 0, 1, 2]), 7.0)
    assert np.allclose(merged, [[50.25, 0, 0], [90, 0, 0]]) and labels.tolist() == [0, 0, 0, 0, 1]
    flat, lab, n = cluster.quantise(np.full((4, 5, 3), 0.5), 4)
    assert len(lab) == 2 and n.sum() == 20 and flat.shape == (4, 5)
    img = r.random((30, 20, 3))
    for impl in ("labkmeans", "mediancut"):
        labels, lab, n = cluster.quantise(img, 6, impl=impl)
        flat = colours.lab_of(img).reshape(-1, 3)
        assert (np.diff(n) <= 0).all() and n.sum() == 600
        assert all(np.allclose(lab[k], flat[labels.ravel() == k].mean(0), atol=1e-3) for k in range(len(lab)))
    assert np.array_equal(cluster.quantise(img, 6, seed=3)[0], cluster.quantise(img, 6, seed=3)[0])
    assert cluster.stride_sample(np.arange(10), 3).tolist() == [0, 3, 6] and len(cluster.stride_sample(np.arange(10), 20)) == 10


def test_colour_differences_agree_with_published_pairs():
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082), ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0011), 7.2195), ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669)]
    for p, q, want in pairs:
        assert abs(colours.delta_e_2000(np.array(p), np.array(q)) - want) < 1e-4


def test_filters():
    r = np.random.default_rng(3)
    img = r.random((14, 11, 3))
    got = filters.bilateral(img, 0.3, 0.5, 1)
    pad, want = np.pad(img, ((1, 1), (1, 1), (0, 0)), mode="reflect"), np.zeros_like(img)
    for y in range(14):
        for x in range(11):
            total, weight = 0, 0
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if dy * dy + dx * dx <= 1:
                        p = pad[y + 1 + dy, x + 1 + dx]
                        g = math.exp(-(np.abs(p - img[y, x]).sum() ** 2) / (2 * 0.09) - (dy * dy + dx * dx) / 0.5)
                        total, weight = total + g * p, weight + g
            want[y, x] = total / weight
    assert np.allclose(got, want)
    step = np.zeros((20, 20, 3))
    step[:, 10:] = 1
    assert np.abs(filters.bilateral(step)[:, :9]).max() < 1e-6  # edges stay
    assert filters.guided(img).std() < img.std() and np.allclose(filters.guided(np.full((9, 9, 3), 0.4)), 0.4)
    b = filters.box(img[..., 0], 2)
    p = np.pad(img[..., 0], 2, mode="symmetric")
    assert np.allclose(b[5, 6], p[5:10, 6:11].mean())
    grey = np.full((40, 40, 3), 0.5) + r.normal(0, 0.01, (40, 40, 1))
    assert filters.local_contrast(grey).std() > grey.std()
    small = filters.resize_area(img, 7)
    assert small.shape == (7, 6, 3) and math.isclose(small.mean(), img.mean(), rel_tol=1e-9) and filters.resize_area(img, 50) is img
    f = r.random((13, 17)) < 0.05
    f[4, 4] = True
    d, ny, nx = filters.distance(f)
    where = [(int(a), int(c)) for a, c in np.argwhere(f)]
    for y in range(13):
        for x in range(17):
            assert (d[y, x], ny[y, x], nx[y, x]) == min(((a - y) ** 2 + (c - x) ** 2, a, c) for a, c in where)
    assert (filters.distance(np.zeros((3, 3), bool))[0] == -1).all()


def test_ink_and_skeletons():
    img = np.full((60, 60, 3), 0.9)
    img[30, 5:55] = 0.05
    img[5:15, 5:15] = 0.05
    mask = filters.ink_lines(img, np.zeros((60, 60), int), np.array([95.0]), 2.0, width_mm=1.5, length_mm=4)
    assert mask[30, 10:50].all() and not mask[6:14, 6:14].any()
    assert not filters.ink_lines(img, np.zeros((60, 60), int), np.array([10.0]), 2.0, width_mm=1.5).any()  # the colour is dark already
    assert not filters.ink_lines(img, np.zeros((60, 60), int), np.array([95.0]), 0.0).any()
    bar = np.zeros((20, 40), bool)
    bar[8:13, 5:35] = True
    sk = filters.skeleton(bar)
    assert 20 <= sk.sum() <= 30 and maps.components(np.where(sk, 0, -1), diagonal=True).max() == 0
    lines = filters.skeleton_lines(bar)
    assert len(lines) == 1 and len(lines[0]) == sk.sum()


def test_simplifying_and_cleaning():
    r = np.random.default_rng(4)

    def plain(xy, tolerance, closed):
        kept = list(range(len(xy)))
        while len(kept) > (4 if closed else 2):
            best = None
            for i in range(1, len(kept) - (0 if closed else 1)):
                a, b, c = xy[kept[i - 1]], xy[kept[i]], xy[kept[(i + 1) % len(kept)]]
                s = abs((a[0] - b[0]) * (c[1] - b[1]) - (a[1] - b[1]) * (c[0] - b[0])) / 2
                if best is None or s < best[0]:
                    best = s, i
            if best[0] >= tolerance**2:
                break
            del kept[best[1]]
        return kept

    for _ in range(60):
        xy = r.random((int(r.integers(2, 14)), 2)) * 4
        for closed in (False, True):
            assert curves.simplify(xy, 0.7, closed).tolist() == plain(xy, 0.7, closed)
    line = np.array([(0, 0), (0.001, 0), (1, 0), (2, 0), (2.0005, 0)], float)
    assert np.allclose(curves.drop_doubles(line, 0.01), [(0, 0), (1, 0), (2.0005, 0)])
    spike = np.array([(0, 0), (1, 0), (1.01, 0.02), (1.0, 0.001), (2, 0)], float)
    assert len(curves.drop_spikes(spike, 0.05)) < 5


def test_curves():
    t = np.linspace(0, 2 * np.pi, 90)
    xy = np.column_stack((10 * np.cos(t), 6 * np.sin(t)))
    cubics = curves.fit(xy, 0.05)
    fine = np.concatenate([curves.bernstein(np.linspace(0, 1, 3000)) @ c for c in cubics])
    assert len(cubics) < 20 and max(np.hypot(*(fine - p).T).min() for p in xy) < 0.051
    for impl in curves.FITTERS:
        c = curves.fit(xy, 0.05, impl)
        assert np.allclose(c[0, 0], xy[0]) and np.allclose(c[-1, 3], xy[-1]) and np.allclose(c[1:, 0], c[:-1, 3])
    corner = np.array([(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)], float)
    assert curves.corner_cuts(corner) == [2] and curves.corner_cuts(corner, 120) == []
    assert curves.even_cuts(np.array([(0, 0), (100, 0), (100.1, 0.4), (100.2, 0.3), (101, 2)], float))
    flat = curves.flatten(curves.fit(corner, 0.1), 0.1)
    assert np.allclose(flat[[0, -1]], corner[[0, -1]])
    r = np.random.default_rng(6)
    a = r.random((70, 2))
    b = a + r.random((70, 2)) * 0.4 - 0.2
    want = set()
    for i in range(70):
        for j in range(i + 1, 70):
            p, q, w = b[i] - a[i], b[j] - a[j], a[j] - a[i]
            det = p[0] * q[1] - p[1] * q[0]
            if 0 < (w[0] * q[1] - w[1] * q[0]) / det < 1 and 0 < (w[0] * p[1] - w[1] * p[0]) / det < 1:
                want.add((i, j))
    assert set(map(tuple, curves.crossings(a, b).tolist())) == want


def test_labels():
    square = place.Rings([np.array([(0, 0), (20, 0), (20, 20), (0, 20)], float), np.array([(8, 8), (8, 12), (12, 12), (12, 8)], float)])
    c, r = place.pole(square, 0.05)
    grid = np.stack(np.meshgrid(np.linspace(0, 20, 101), np.linspace(0, 20, 101)), -1).reshape(-1, 2)
    assert r >= square.distances(grid).max() - 0.06 and square.inside(np.array([c]))[0] and not square.inside(np.array([(10.0, 10.0)]))[0]
    thin = place.Rings([np.array([(40, 0), (41, 0), (41, 20), (40, 20)], float)])
    kept, blank, bad = place.place([square, thin], [1, 2], 12.0)
    assert [k.leader for k in kept] == [False, True] and not blank and not bad
    kept, blank, _ = place.place([square, thin], [1, 2], 12.0, micro_ids={1})
    assert blank == {1} and len(kept) == 1
    kept, blank, _ = place.place([square, thin], [1, 2], 12.0, skip={0}, micro_ids={1}, keep={1})
    assert [k.region for k in kept] == [1] and kept[0].size == place.MICRO_MIN
    assert place.overlap((0, 0, 2, 2), (1, 1, 3, 3)) and not place.overlap((0, 0, 2, 2), (2, 0, 3, 2))
    assert place.legend(4, 0, 0, 300, 20, 4, 60, 10) == [(0, 0, 64, 0), (94, 0, 158, 0), (188, 0, 252, 0), (0, 30, 64, 30)]
    assert place.salient(np.array([100, 100]), np.array([40, 120]), 10000).tolist() == [True, False]


def test_scanlines_and_numbers():
    r = np.random.default_rng(8)
    for _ in range(20):
        tri = r.random((3, 2)) * 12
        got = page.scanlines([tri], 12, 12)
        rings = place.Rings([tri])
        centres = np.stack(np.meshgrid(np.arange(12) + 0.5, np.arange(12) + 0.5), -1).reshape(-1, 2)
        assert np.array_equal(got.ravel(), rings.inside(centres))
    assert page.number(0.0625) == "0.062" and page.number(-0.0001) == "0.000" and page.number(1.0005) == "1.000" and page.number(-2.5) == "-2.500"


def picture(seed=1, n=96, k=7):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n]
    p, c = r.random((k, 2)) * n, r.random((k, 3))
    return c[((y[..., None] - p[:, 0]) ** 2 + (x[..., None] - p[:, 1]) ** 2).argmin(-1)]


def test_conversion_of_one_image():
    s = convert.settings_of("medium", {"preprocess": {"smooth_passes": 0}})
    w = convert.convert_pixels(picture(), s)
    assert page.check_svg(w.svg, len(w.arcs)) is None and page.check_pdf(w.pdf, (215.9, 279.4)) is None
    assert abs(sum(checks.face_area(r) for r in w.rings) / w.scale**2 - 96 * 96) < 1 and w.metrics["min_face_label_agreement"] > 0.99
    assert {b.region for b in w.labels} | w.blank | w.skip == set(range(len(w.region_label)))
    again = convert.convert_pixels(picture(), s)
    assert again.svg == w.svg and again.pdf == w.pdf and page.fingerprint(w.svg) == page.fingerprint(again.svg)
    assert images.decode(w.solved_png).shape == (1650, 1275, 3)
    other = convert.convert_pixels(picture(2), s)
    assert page.fingerprint(other.svg) != page.fingerprint(w.svg)
    for bad, why in ((w.svg.replace(b"arc-0", b"arc-9"), "arc"), (w.svg.replace(b'id="ink"', b'id="inks"'), "layers"), (b"<svg", "well-formed"), (w.svg.replace(b'mm"', b'"'), "mm")):
        assert why in page.check_svg(bad, len(w.arcs))
    assert page.check_pdf(w.pdf, (100, 100)) and page.check_pdf(b"no", (215.9, 279.4))


def test_findings():
    s = convert.settings_of("easy", {"preprocess": {"smooth_passes": 0}})
    w = convert.convert_pixels(picture(), s, until="labels")
    w["flat"] = [p.copy() for p in w.flat]
    w["labels"] = w.labels[1:]
    found, measures = checks.gates(w, s)
    assert any(f["validator"] == "printability" and f["severity"] == "fatal" for f in found) and measures["label_coverage_pct"] < 100
    w["rings"] = [r if i else [q * 0.5 for q in r] for i, r in enumerate(w.rings)]
    found, _ = checks.gates(w, s)
    assert any("lost" in f["message"] for f in found)


def test_settings_are_checked():
    with pytest.raises(config.ConfigError):
        convert.settings_of("medium", {"quantize": {"n_colors": 65}})
    with pytest.raises(config.ConfigError):
        convert.settings_of("medium", {"quantise": {}})
    with pytest.raises(config.ConfigError):
        convert.settings_of("none")
    assert convert.settings_of("partial")["mask"]["enabled"] and convert.settings_of("dense")["merge"]["protect_dark_l"] == 48


def filtered_png(px, kind, bits=8, form=2):
    """A PNG file whose lines all use one filter."""
    h = px.shape[0]
    raw = px.reshape(h, -1).astype(int)
    step = px.shape[2]
    out = b""
    for y in range(h):
        line = []
        for i in range(raw.shape[1]):
            a, b = raw[y, i - step] if i >= step else 0, raw[y - 1, i] if y else 0
            c = raw[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((raw[y, i] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", px.shape[1], h, bits, form, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_decoders():
    r = np.random.default_rng(9)
    px = r.integers(0, 256, (9, 7, 3))
    for kind in range(5):
        assert np.allclose(images.read_png(filtered_png(px, kind)), px / 255)
    grey = r.integers(0, 256, (5, 6, 2))
    a = grey[..., 1:] / 255
    assert np.allclose(images.read_png(filtered_png(grey, 4, form=4)), np.repeat(grey[..., :1] / 255 * a + 1 - a, 3, 2))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    # 2-bit palette with transparency, 3 x 5
    idx = r.integers(0, 4, (3, 5))
    rows = b"".join(b"\0" + np.packbits(np.unpackbits(line.astype(np.uint8)[:, None], axis=1)[:, 6:].ravel()).tobytes() for line in idx)
    table = r.integers(0, 256, (4, 3)).astype(np.uint8)
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 3, 2, 3, 0, 0, 0)) + chunk(b"PLTE", table.tobytes()) + chunk(b"tRNS", b"\0") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    want = table / 255.0
    want[0] = 1.0
    assert np.allclose(images.read_png(data), want[idx])
    # interlaced grey
    g = r.integers(0, 256, (11, 13))
    body = b"".join(b"".join(b"\0" + line.astype(np.uint8).tobytes() for line in g[y::dy, x::dx]) for x, y, dx, dy in images.PASSES)
    data = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 11, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert np.allclose(images.read_png(data)[..., 0], g / 255)
    # Exif: turned by a quarter
    exif = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + b"\0\0\0\0"
    with_exif = filtered_png(px, 0).replace(chunk(b"IEND", b""), chunk(b"eXIf", exif) + chunk(b"IEND", b""))
    assert np.allclose(images.read_png(with_exif), np.rot90(px / 255, -1))
    for how in range(1, 9):
        assert images.oriented(px, how).shape[:2] == ((9, 7) if how < 5 else (7, 9))
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 9 * 24, 0, 54, 40, 7, 9, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(line[:, ::-1].astype(np.uint8).tobytes() + b"\0\0\0" for line in px[::-1])
    assert np.allclose(images.decode(bmp, least_side=1), px / 255)
    assert np.allclose(images.decode(b"P6 # note\n7 9\n255\n" + px.astype(np.uint8).tobytes(), least_side=1), px / 255)
    import base64

    uri = "data:image/png;base64," + base64.b64encode(filtered_png(np.where(np.indices((4, 4)).sum(0)[..., None] % 2, 255, 0) * np.ones((1, 1, 3), int), 1)).decode()
    assert images.mask_grid(uri, 8, 8)[::2, ::2].tolist() == (np.indices((4, 4)).sum(0) % 2 == 1).tolist()
    for bad in (b"", b"GIF89a", images.SIGNATURE, bmp[:60], b"P6 7 9 255\n", filtered_png(px, 0)[:60]):
        with pytest.raises(ValueError):
            images.decode(bad, least_side=1)
    with pytest.raises(ValueError, match="outside"):  # judged from the header, before anything is inflated
        images.decode(images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 60000, 60000, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x"))

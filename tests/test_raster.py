import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import raster


def cells(spark, images):
    rows = [(k, y, x, float(m[y, x])) for k, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "image string, y int, x int, v double")


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(1)
    return {"a": r.integers(0, 256, (9, 13)), "b": r.integers(0, 256, (16, 8)), "c": np.zeros((3, 2)), "d": np.full((1, 1), 250)}


def test_distance_and_dilation(spark, images):
    d = cells(spark, images)
    mark = F.col("v") > 230
    far = {(r.image, r.y, r.x): (r.d2, r.near_y, r.near_x) for r in raster.distance_transform(d, mark).collect()}
    grown = {(r.image, r.y, r.x): r.grown for r in raster.dilate(d, mark, 2).collect()}
    assert len(far) == len(grown) == sum(m.size for m in images.values())
    for k, m in images.items():
        on = [tuple(map(int, p)) for p in np.argwhere(m > 230)]
        for y, x in np.ndindex(*m.shape):
            assert far[k, y, x] == min((((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in on), default=(None, None, None))
            assert grown[k, y, x] == any(abs(y - a) + abs(x - b) <= 2 for a, b in on)


def test_resize_area(spark, images):
    got = {(r.image, r.y, r.x): r.v for r in raster.resize_area(cells(spark, images), 5, ["v"]).collect()}
    want = {}
    for k, m in images.items():
        h, w = m.shape
        f = min(1.0, 5 / max(h, w))
        th, tw = max(1, round(h * f)), max(1, round(w * f))
        big = np.kron(m, np.ones((th, tw)))
        want |= {(k, y, x): big[y * h : (y + 1) * h, x * w : (x + 1) * w].mean() for y in range(th) for x in range(tw)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ssim(spark, images):
    other = {k: np.clip(m[: max(1, m.shape[0] - 1)] + 9 * (np.arange(m.shape[1]) % 2), 0, 255) for k, m in images.items()}
    first, second = cells(spark, images), cells(spark, other)
    got = {r.image: r.ssim for r in raster.ssim(first, second, "v").collect()}
    same = {r.image: r.ssim for r in raster.ssim(first, first, "v").collect()}
    assert got["c"] is None and got["d"] is None
    for k in ("a", "b"):
        a, b = images[k][: other[k].shape[0]], other[k]
        each = []
        for y in range(a.shape[0] - 6):
            for x in range(a.shape[1] - 6):
                p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
                c = np.cov(p, q)
                each.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
        assert abs(got[k] - np.mean(each)) < 1e-9
        assert abs(same[k] - 1) < 1e-9
    empty = first.where("false")
    assert raster.ssim(empty, empty, "v").count() == raster.resize_area(empty, 5, ["v"]).count() == raster.distance_transform(empty, F.col("v") > 0).count() == 0

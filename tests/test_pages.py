"""Operators over many images: tiles, hard rows, arcs and faces, conversion, streams."""

import numpy as np
import pytest

from gridloom.functions import layout
from gridloom.kernels import cracks, filters, maps
from gridloom.operators import boundary, geometry, grid, raster, stats
from gridloom.plans import convert, page_queries
from gridloom.sources import fixtures, images
from gridloom.streaming import pages
from tests.test_grid import cells, flood
from tests.test_kernels import filtered_png, picture, plain_majority, plain_opening


@pytest.fixture(scope="module")
def many():
    r = np.random.default_rng(11)
    out = {f"m{i}": r.integers(0, 3, (int(r.integers(1, 12)), int(r.integers(1, 12)))) for i in range(6)}
    spiral = np.zeros((17, 17), int)
    for k in range(0, 16, 4):
        spiral[k, k : 17 - k], spiral[k : 17 - k, 16 - k], spiral[16 - k, k + 2 : 17 - k] = 1, 1, 1
    return out | {"spiral": spiral, "big": np.kron(r.integers(0, 2, (6, 5)), np.ones((4, 4), int))}


def test_components_over_tiles(spark, many):
    """Tiles of 4 x 4: components cross many of them; the numbers are those of a flood fill of the whole image."""
    got = {}
    for r in grid.components(cells(spark, many), tile=4).collect():
        got[r.image, r.y, r.x] = r.region
    for k, m in many.items():
        want = flood(m)
        assert all(got[k, y, x] == want[y, x] for y, x in np.ndindex(m.shape)), k


def test_hard_cells(spark, many):
    """Repeated cells count once (least label), null labels, images and places are left out, an empty table gives an empty one."""
    schema = "image string, y int, x int, label int"
    rows = [("a", 0, 0, 1), ("a", 0, 0, 1), ("a", 0, 0, 7), ("a", 0, 1, 1), ("a", 0, 1, 1), ("a", 1, 0, None), ("a", None, 0, 1), (None, 0, 0, 1), ("a", 1, 1, 1), ("b", 0, 0, None)]
    df = spark.createDataFrame(rows, schema)
    for tile in (1, 512):
        got = sorted(tuple(r) for r in grid.components(df, tile=tile).collect())
        assert got == [("a", 0, 0, 1, 0), ("a", 0, 1, 1, 0), ("a", 1, 1, 1, 0)], tile
    assert [(r.area, r.label) for r in grid.region_records(grid.components(df)).collect()] == [(3, 1)]
    empty = spark.createDataFrame([], schema)
    c = grid.components(empty)
    e = grid.region_edges(c)
    for out in (c, e, grid.region_records(c), grid.page_border(c), grid.perimeters(c, e), grid.modal_filter(empty), grid.corners(c), grid.cracks(empty), boundary.arcs(c), boundary.faces(c), grid.fill_holes(c, e, 3), grid.open_areas(c, grid.region_records(c), e, 3)):
        assert out.count() == 0


def test_neighbourhoods_over_tiles(spark, many, monkeypatch):
    """Every operator with a ring, on tiles of 4 x 4, against the whole array."""
    from gridloom.operators import tiles

    monkeypatch.setattr(tiles.over_tiles, "__defaults__", (0, 4))
    df = cells(spark, many)
    c = grid.components(df, tile=4).cache()
    delta = np.abs(np.subtract.outer(np.arange(3), np.arange(3))) * 1.5
    modal, grown, corner, border, edges = {}, {}, {}, {}, {}
    for r in grid.modal_filter(df, delta, 2).collect():
        modal[r.image, r.y, r.x] = r.label
    for r in raster.dilate(df, df.label == 1, 3).collect():
        grown[r.image, r.y, r.x] = r.grown
    for r in grid.corners(c).collect():
        assert corner.setdefault((r.image, r.v, r.u), 0) == 0
        corner[r.image, r.v, r.u] += 1
    for r in grid.page_border(c).collect():
        border[r.image, r.region] = r.border
    for r in grid.region_edges(c).collect():
        edges[r.image, r.a, r.b] = r.w
    crack = [tuple(r) for r in grid.cracks(df).collect()]
    for k, m in many.items():
        reg = flood(m)
        want = plain_majority(plain_majority(m, delta), delta)
        stop = cracks.junctions(reg)
        assert {(v, u) for i, v, u in corner if i == k} == set(map(tuple, np.argwhere(stop).tolist()))
        a, b, w, rim = maps.borders(reg)
        assert {(p, q): n for (i, p, q), n in edges.items() if i == k} == dict(zip(zip(a.tolist(), b.tolist(), strict=True), w.tolist(), strict=True))
        assert all(border[k, i] == n for i, n in enumerate(rim.tolist()))
        assert len([c for c in crack if c[0] == k]) == len({c for c in crack if c[0] == k}) == int(w.sum() + rim.sum())
        for y, x in np.ndindex(m.shape):
            assert modal[k, y, x] == want[y, x]
            near = any(abs(y - p) + abs(x - q) <= 3 for p, q in np.argwhere(m == 1))
            assert grown[k, y, x] == near
    img = np.random.default_rng(0).random((13, 9, 3))
    df = spark.createDataFrame([("i", y, x, *map(float, img[y, x])) for y, x in np.ndindex(13, 9)], "image string, y int, x int, r double, g double, b double")
    assert abs(stats.edge_density(stats.with_lab(df)).collect()[0].edge_density - filters.edge_density(img)) < 1e-12


def test_distances_in_bands(spark, many):
    got = {}
    df = cells(spark, many)
    for r in raster.distance_transform(df, df.label == 1, band=3).collect():
        got[r.image, r.y, r.x] = (r.d2, r.near_y, r.near_x)
    for k, m in many.items():
        spots = [tuple(map(int, s)) for s in np.argwhere(m == 1)]
        for y, x in np.ndindex(m.shape):
            assert got[k, y, x] == (min(((p - y) ** 2 + (q - x) ** 2, p, q) for p, q in spots) if spots else (None, None, None))


def test_opening_follows_chains(spark, many):
    c = grid.components(cells(spark, many))
    delta = np.abs(np.subtract.outer(np.arange(3), np.arange(3))) * 2.0
    table = spark.createDataFrame([(a, b, float(delta[a, b])) for a in range(3) for b in range(3)], "label int, cand int, de double")
    got = {(r.image, r.y, r.x): r.label for r in grid.open_areas(c, grid.region_records(c), grid.region_edges(c), 4, table).collect()}
    for k, m in many.items():
        want = plain_opening(m, 4, delta)
        assert all(got[k, y, x] == want[y, x] for y, x in np.ndindex(m.shape)), k


def test_arcs_faces_and_proofs(spark, many):
    c = grid.components(cells(spark, many)).cache()
    assert all(tuple(r)[1:] == (0, 0, 0, 0) for r in boundary.topology_proof(c).collect())
    area = {(r.image, r.region): r["sum(area)"] for r in boundary.faces(c).groupBy("image", "region").sum("area").collect()}
    assert area == {(r.image, r.region): float(r.area) for r in grid.region_records(c).collect()}


def test_lloyd_against_the_kernel(spark):
    from gridloom.kernels import cluster

    r = np.random.default_rng(3)
    x = np.round(np.concatenate([c + r.normal(0, 1, (50, 2)) for c in ((0, 0), (9, 0), (0, 9))]), 6)
    start = x[[0, 1, 2]]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = stats.lloyd(df, "v", start.tolist()).orderBy("centre").collect()
    centres, inertia, _ = cluster.lloyd(x, start)
    assert [g.n for g in got] == np.bincount(cluster.nearest(x, centres), minlength=3).tolist()
    assert abs(sum(g.inertia for g in got) - inertia) < 1e-3 and all(g.settled for g in got)


def test_numbers_print_as_in_c(spark):
    r = np.random.default_rng(4)
    values = [0.0625, -0.0625, 0.1875, 1.0005, 2.0005, -0.0001, 0.0, -0.0, 0.0005, 0.00049999999999999, 999.9995, 123456.0625, 1e-30, *(r.normal(0, 100, 500)).tolist(), *(r.integers(-9999, 9999, 200) / 16).tolist(), *(r.integers(-9999, 9999, 200) / 2000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", layout.fixed(df.v).alias("t")).collect():
        want = f"{row.v:.3f}"
        assert row.t == ("0.000" if want == "-0.000" else want), row


def test_conversion_of_many_images(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.png").write_bytes(filtered_png(np.rint(picture(i, 70, 4) * 255).astype(int), i))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "small.png").write_bytes(images.write_png(np.zeros((5, 5, 3), np.uint8)))
    over = {"preprocess": {"smooth_passes": 0}}
    listed = images.files(spark, f"file://{tmp_path}")
    assert listed.count() == 5  # Spark leaves empty files out
    nothing = spark.createDataFrame([("/empty.png", bytearray())], "image string, content binary")
    out = convert.convert(listed.select("image", "content").unionByName(nothing), "easy", over).cache()
    rows = {r.image.rsplit("/", 1)[1]: r for r in out.collect()}
    assert len(rows) == 6 and all(rows[f"p{i}.png"].error is None and rows[f"p{i}.png"].svg.startswith("<?xml") for i in range(3))
    assert "not a PNG" in rows["bad.png"].error and "empty" in rows["empty.png"].error and "outside" in rows["small.png"].error and not rows["bad.png"].accepted
    w = convert.convert_pixels(images.decode((tmp_path / "p1.png").read_bytes()), convert.settings_of("easy", over))
    assert rows["p1.png"].svg.encode() == w.svg
    for name in ("palette", "regions", "edges", "arcs", "faces", "labels", "legend", "findings", "metrics", "seconds"):
        assert convert.rows(out, name).where("image is null").count() == 0
    total = {r.image: r.s for r in convert.rows(out, "regions").groupBy("image").agg({"area": "sum"}).withColumnRenamed("sum(area)", "s").collect()}
    assert set(total.values()) == {70 * 70}
    q = pages(spark, f"file://{tmp_path}", "easy", over).select("image", "error").writeStream.format("memory").queryName("converted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("converted").count() == 5 and spark.table("converted").where("error is null").count() == 3


def test_fixtures(spark):
    m = fixtures.label_maps(spark)
    sizes = {r.image: r["count"] for r in m.groupBy("image").count().collect()}
    assert sizes == {f[0]: f[4] * f[5] for f in fixtures.CATALOGUE}
    assert fixtures.manifest(m).select("sha256").distinct().count() == len(sizes)


def test_simplifying_rings_and_nulls(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 2.0, 0.0], [0.0, 0.01, 0.0, 2.0, 2.0]), (2, None, None), (3, [], [])], "id long, xs array<double>, ys array<double>")
    got = {r.id: r.xs for r in geometry.simplify(df, "id", 0.5, closed=True).collect()}
    assert got[1] == [0.0, 2.0, 2.0, 0.0] and not got[2] and not got[3]


def test_every_query_runs(spark):
    for name, q in page_queries.QUERIES.items():
        out = q(spark, "/root/testdata/sf0.001")
        assert out.columns and out.count() >= 0, name

"""Boundary arcs of region maps and label places: walks whose order matters, one task for each image or face."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.kernels import cracks, place
from gridloom.plans.shipping import ship

#: Cells of the largest image that one task traces (about 2 GB there); larger ones raise.
MOST_CELLS = 30_000_000


def dense(table: pa.Table, name: str) -> np.ndarray:
    """The named column of one image's rows as an array; cells without a row are -1."""
    y, x, v = (table.column(c).to_numpy() for c in ("y", "x", name))
    shape = int(y.max()) + 1, int(x.max()) + 1
    if shape[0] * shape[1] > MOST_CELLS:
        raise ValueError(f"{shape[1]} x {shape[0]} cells are more than one task traces")
    grid = np.full(shape, -1, np.int64)
    grid[y, x] = v
    return grid


def arcs(cells: DataFrame) -> DataFrame:
    """(image, arc, left_region, right_region, closed, vs, us) from cells with region; one task an image, at most MOST_CELLS."""
    ship(cells.sparkSession)

    def run(key, table):
        found = cracks.arcs(dense(table, "region"))
        return pa.table({
            "image": pa.array([key[0].as_py()] * len(found), pa.string()), "arc": pa.array(range(len(found)), pa.int32()),
            "left_region": pa.array([a.left for a in found], pa.int32()), "right_region": pa.array([a.right for a in found], pa.int32()), "closed": pa.array([a.closed for a in found], pa.bool_()),
            "vs": pa.array([a.points[:, 0].astype(np.int32) for a in found], pa.list_(pa.int32())), "us": pa.array([a.points[:, 1].astype(np.int32) for a in found], pa.list_(pa.int32())),
        })

    return cells.select("image", "y", "x", "region").groupBy("image").applyInArrow(run, "image string, arc int, left_region int, right_region int, closed boolean, vs array<int>, us array<int>")


def faces(cells: DataFrame) -> DataFrame:
    """(image, region, part, hole, arcs, backwards, vs, us, area): the outer walk (part 0) and the holes of every region, on the corner grid."""
    ship(cells.sparkSession)
    schema = "image string, region int, part int, hole boolean, arcs array<int>, backwards array<boolean>, vs array<int>, us array<int>, area double"

    def run(key, table):
        regions = dense(table, "region")
        found = cracks.arcs(regions)
        points, rows = [a.points for a in found], []
        for f in cracks.faces(found, int(regions.max()) + 1):
            for k, walk in enumerate([f.outer, *f.holes]):
                p = cracks.ring(walk, points)
                rows.append((f.region, k, k > 0, [a for a, _ in walk], [b for _, b in walk], p[:, 0].astype(np.int32), p[:, 1].astype(np.int32), cracks.signed_area(p)))
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64()]
        names = ["region", "part", "hole", "arcs", "backwards", "vs", "us", "area"]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), *columns], names=["image", *names])

    return cells.select("image", "y", "x", "region").groupBy("image").applyInArrow(run, schema)


def topology_proof(cells: DataFrame) -> DataFrame:
    """(image, twice, missing, wrong_sides, euler): what must be 0 for each image's arcs."""
    ship(cells.sparkSession)

    def run(key, table):
        regions = dense(table, "region")
        return pa.table({"image": [key[0].as_py()], **{k: pa.array([v], pa.int32()) for k, v in cracks.proof(regions, cracks.arcs(regions)).items()}})

    return cells.select("image", "y", "x", "region").groupBy("image").applyInArrow(run, "image string, twice int, missing int, wrong_sides int, euler int")


def poles(rings: DataFrame, key: str, precision: float = 0.5) -> DataFrame:
    """(key, x, y, clearance): the largest empty circle of rings given as (key, xs, ys); each ring on its own, without a shuffle."""
    ship(rings.sparkSession)
    kind = dict(rings.dtypes)[key]

    def run(batches):
        for b in batches:
            xs, ys = b.column(1), b.column(2)
            size = xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.column_stack((xs.flatten().to_numpy(), ys.flatten().to_numpy()))
            begin = np.cumsum(size) - size
            got = [place.pole(place.Rings([flat[i : i + n]]), precision) if n > 2 else (np.full(2, np.nan), np.nan) for i, n in zip(begin.tolist(), size.tolist(), strict=True)]
            columns = [[g[0][0] for g in got], [g[0][1] for g in got], [g[1] for g in got]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64(), from_pandas=True) for c in columns]], [key, "x", "y", "clearance"])

    return rings.select(key, F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>")).mapInArrow(run, f"{key} {kind}, x double, y double, clearance double")

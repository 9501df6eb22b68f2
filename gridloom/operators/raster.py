"""Neighbourhood operators over dense grids (image, y, x, ...): distances, dilation, area resize, structural similarity.

Every step is partitioned by a row, a column, a band or a tile of one image, never by a whole image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.kernels import filters
from gridloom.kernels.maps import shifted
from gridloom.operators.tiles import Patch, over_tiles
from gridloom.plans.shipping import ship


def distance_transform(cells: DataFrame, feature: Column, band: int = 64) -> DataFrame:
    """(image, y, x, d2, near_y, near_x): squared Euclidean distance to the nearest cell where feature holds.

    Ties go to the smallest (near_y, near_x); all three are null in an image without such cells. The nearest one of each
    column is found by two running windows, then bands of rows look along their rows, each band in one task.
    """
    ship(cells.sparkSession)
    col = W.partitionBy("image", "x").orderBy("y")
    at = F.when(feature, F.col("y"))
    both = cells.select(
        "image", "y", "x", F.last(at, True).over(col.rowsBetween(W.unboundedPreceding, 0)).alias("up"),
        F.first(at, True).over(col.rowsBetween(0, W.unboundedFollowing)).alias("down"),
    )
    near = F.when(F.col("down").isNull() | (F.col("y") - F.col("up") <= F.col("down") - F.col("y")), F.col("up")).otherwise(F.col("down"))
    rows = both.select("image", "y", "x", F.coalesce(near, F.lit(-1)).alias("n"), F.floor(F.col("y") / band).alias("band"))

    def run(key, table):
        y, x, n = (table.column(c).to_numpy() for c in ("y", "x", "n"))
        low = int(y.min())
        grid = np.full((int(y.max()) - low + 1, int(x.max()) + 1), -1, np.int64)
        there = np.zeros(grid.shape, bool)
        grid[y - low, x], there[y - low, x] = n, True
        d, ny, nx = filters.row_distance((grid - (np.arange(len(grid)) + low)[:, None]) ** 2, grid)
        py, px = np.nonzero(there)
        none = d[py, px] < 0
        out = [pa.array(v, mask=none) for v in (d[py, px], ny[py, px].astype(np.int32), nx[py, px].astype(np.int32))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(py), pa.string()), pa.array((py + low).astype(np.int32)), pa.array(px.astype(np.int32)), *out], names=["image", "y", "x", "d2", "near_y", "near_x"])

    return rows.groupBy("image", "band").applyInArrow(run, "image string, y int, x int, d2 long, near_y int, near_x int")


def dilate(cells: DataFrame, feature: Column, steps: int) -> DataFrame:
    """(image, y, x, grown): feature holds there or within this many 4-neighbour steps."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        m = p.values["f"] == 1
        for _ in range(steps):
            m = m | np.logical_or.reduce([shifted(m, dy, dx, False) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))])
        return p.rows({"grown": m})

    return over_tiles(cells.select("image", "y", "x", feature.cast("int").alias("f")), ["f"], run, "y int, x int, grown boolean", reach=steps)


def resize_area(pixels: DataFrame, most: int, values: list[str]) -> DataFrame:
    """(image, y, x, values): area averages on a grid whose longer side is `most`; smaller images stay as they are.

    Sides are rounded half to even. Weights are whole numbers: overlaps in units of 1 / (source side x target side).
    """
    size = pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    f = F.least(F.lit(1.0), most / F.greatest("h", "w"))
    size = size.select("image", "h", "w", *[F.greatest(F.lit(1), F.bround(F.col(s) * f).cast("int")).alias(f"t{s}") for s in ("h", "w")])

    def hits(at: str, side: str, target: str) -> Column:
        return F.expr(
            f"transform(sequence(bigint({at} * {target} div {side}), bigint((({at} + 1) * {target} - 1) div {side})), "
            f"t -> struct(int(t) as t, least((t + 1) * {side}, ({at} + 1) * {target}) - greatest(t * {side}, {at} * {target}) as n))"
        )

    d = pixels.select("image", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x")], *values).join(size, "image")
    d = d.withColumn("i", F.explode(hits("y", "h", "th"))).withColumn("j", F.explode(hits("x", "w", "tw")))
    n = F.col("i.n") * F.col("j.n")
    return d.groupBy("image", F.col("i.t").alias("y"), F.col("j.t").alias("x")).agg(*[(F.sum(F.col(v) * n) / F.sum(n)).alias(v) for v in values])


def ssim(first: DataFrame, second: DataFrame, value: str, span: float = 255.0, side: int = 7) -> DataFrame:
    """(image, ssim): mean structural similarity over uniform windows, on the part both images cover.

    Sample covariances, constants 0.01 and 0.03; only windows that lie inside count, null if none does. Windows are summed
    along rows, then along columns.
    """
    d = first.select("image", "y", "x", F.col(value).cast("double").alias("a")).join(second.select("image", "y", "x", F.col(value).cast("double").alias("b")), ["image", "y", "x"])
    half, parts = side // 2, {"a": "a", "b": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b", "n": "1D"}
    row, col = (W.partitionBy("image", p).orderBy(o).rowsBetween(-half, half) for p, o in (("y", "x"), ("x", "y")))
    d = d.select("image", "y", "x", *[F.sum(F.expr(e)).over(row).alias(k) for k, e in parts.items()])
    d = d.select("image", *[F.sum(k).over(col).alias(k) for k in parts])
    n = float(side * side)
    ma, mb = F.col("a") / n, F.col("b") / n
    va, vb, cov = ((F.col(k) / n - m) * (n / (n - 1)) for k, m in (("aa", ma * ma), ("bb", mb * mb), ("ab", ma * mb)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return d.groupBy("image").agg(F.avg(F.when(F.col("n") == n, s)).alias("ssim"))

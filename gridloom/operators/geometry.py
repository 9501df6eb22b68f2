"""Rings, polylines and Bézier segments, as window expressions or per-row array work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.kernels import curves
from gridloom.plans.shipping import ship


def ring_measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, perimeter) of rings given as rows (keys, ord, x, y); counter-clockwise areas are positive."""
    w = W.partitionBy(*keys).orderBy("ord")
    first = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in "xy")
    p = points.withColumn("nx", nx).withColumn("ny", ny)
    return p.groupBy(*keys).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"))


def turning_energy(points: DataFrame, keys: list[str], most_degrees: float = 60.0) -> DataFrame:
    """(keys, energy): squared turning angles up to most_degrees, summed over open polylines and divided by their length."""
    w = W.partitionBy(*keys).orderBy("ord")
    d = points.withColumn("ux", F.col("x") - F.lag("x").over(w)).withColumn("uy", F.col("y") - F.lag("y").over(w))
    d = d.withColumn("vx", F.lead("ux").over(w)).withColumn("vy", F.lead("uy").over(w))
    turn = F.atan2(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx"), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))
    return d.withColumn("t", turn).groupBy(*keys).agg((F.sum(F.when(F.abs(F.degrees("t")) <= most_degrees, F.col("t") * F.col("t"))) / F.nullif(F.sum(F.hypot("ux", "uy")), F.lit(0.0))).alias("energy"))


def flatten_cubic(segments: DataFrame, keys: list[str], samples: Column) -> DataFrame:
    """(keys, k, x, y): points of cubic segments (x0, y0, ..., x3, y3) at k / (samples - 1)."""
    s = segments.withColumn("_n", samples).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("k") / (F.col("_n") - 1)
    u = 1 - t
    at = lambda c: u * u * u * F.col(f"{c}0") + 3 * u * u * t * F.col(f"{c}1") + 3 * u * t * t * F.col(f"{c}2") + t * t * t * F.col(f"{c}3")
    return s.select(*keys, "k", at("x").alias("x"), at("y").alias("y"))


def proper_crossing(a, b, c, d, guard: float = 1e-9) -> Column:
    """Whether segments ab and cd cross inside both; points are (x, y) Columns."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    det = rx * sy - ry * sx
    qx, qy = c[0] - a[0], c[1] - a[1]
    safe = F.nullif(det, F.lit(0.0))
    t, u = (qx * sy - qy * sx) / safe, (qx * ry - qy * rx) / safe
    inside = lambda v: (v > guard) & (v < 1 - guard)
    return F.coalesce((F.abs(det) > guard) & inside(t) & inside(u), F.lit(False))


#: Ids of equal boxes that one row holds.
BLOCK = 256
_BOX = ("x0", "y0", "x1", "y1")


def _dealt(boxes: DataFrame, cell: float) -> DataFrame:
    """Each box once for every grid cell (gx, gy) that it covers."""
    at = lambda c: F.floor(F.col(c) / cell)
    return boxes.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))


def box_blocks(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values, block, ids): boxes that are equal in all columns but id, up to BLOCK ascending ids a row. Boxes with nulls meet nothing and go."""
    values = [c for c in boxes.columns if c not in (*keys, "id")]
    place = F.row_number().over(W.partitionBy(*keys, *values).orderBy("id"))
    numbered = boxes.dropna(subset=[*keys, "id", *_BOX]).withColumn("block", F.floor((place - 1) / BLOCK))
    return numbered.groupBy(*keys, *values, "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def box_overlaps(boxes: DataFrame, cell: float, keys: list[str], holds: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(keys, a, b): pairs a < b of boxes (keys, id, x0, y0, x1, y1, further values) that overlap (touching counts).

    holds(s, t) is a further condition on a pair's values: those of the smaller id are the columns with prefix s_, those of
    the larger one with prefix t_.

    Equal boxes go as blocks of ids. Blocks are dealt to the grid cells they cover; two blocks meet, each as the one of the
    smaller id, in the one cell that holds their overlap's least corner, so no distinct is needed. Pairs of blocks are dealt
    anew before they become pairs of ids, so boxes that lie in one place are no single task.
    """
    spark = boxes.sparkSession
    blocks = box_blocks(boxes, keys)
    values = [c for c in blocks.columns if c not in (*keys, "ids")]
    spread = _dealt(blocks, cell)
    side = lambda s: spread.select(*keys, "gx", "gy", *[F.col(c).alias(f"{s}_{c}") for c in (*values, "ids")])
    own = (F.col("gx") == F.floor(F.greatest("a_x0", "b_x0") / cell)) & (F.col("gy") == F.floor(F.greatest("a_y0", "b_y0") / cell))
    met = side("a").join(side("b"), [*keys, "gx", "gy"]).where("a_x0 <= b_x1 and b_x0 <= a_x1 and a_y0 <= b_y1 and b_y0 <= a_y1").where(own)
    met = met.where("a_ids[0] < b_ids[size(b_ids) - 1]").where(holds("a", "b") if holds else F.lit(True)).select(*keys, "a_ids", "b_ids")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = met.repartition(tasks, F.col("a_ids")[0], F.col("b_ids")[0], F.size("a_ids"), F.size("b_ids"))
    return met.select(*keys, F.explode("a_ids").alias("a"), "b_ids").select(*keys, "a", F.explode("b_ids").alias("b")).where("a < b")


def overlapping(boxes: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """(keys, id): the ids whose boxes (keys, id, x0, y0, x1, y1) overlap the inside of a box of another id; each once.

    Only different boxes meet, with their least and largest id: a box overlaps another id's if either is not its own.
    """
    box = [*keys, *_BOX]
    ids = boxes.dropna(subset=[*box, "id"]).select(*box, "id")
    spread = _dealt(ids.groupBy(*box).agg(F.min("id").alias("low"), F.max("id").alias("high")), cell)
    a = spread.select(*keys, "gx", "gy", *_BOX)
    b = spread.select(*keys, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in (*_BOX, "low", "high")])
    met = a.join(b, [*keys, "gx", "gy"]).where("x0 < b_x1 and b_x0 < x1 and y0 < b_y1 and b_y0 < y1").groupBy(*box).agg(F.min("b_low").alias("low"), F.max("b_high").alias("high"))
    return ids.join(met, box).where("low < id or id < high").select(*keys, "id").distinct()


def simplify(polylines: DataFrame, key: str, tolerance: float, closed: bool = False) -> DataFrame:
    """(key, xs, ys) with simplified coordinate arrays; each polyline (or ring) on its own, in Arrow batches without a shuffle."""
    ship(polylines.sparkSession)
    kind = dict(polylines.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(1), b.column(2)
            if not b.num_rows:
                continue
            size = xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.column_stack((xs.flatten().to_numpy(), ys.flatten().to_numpy()))
            begin = np.cumsum(size) - size
            kept = [i + curves.simplify(flat[i : i + n], tolerance, closed) for i, n in zip(begin.tolist(), size.tolist(), strict=True)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32))
            at = np.concatenate(kept).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.ListArray.from_arrays(offsets, pa.array(flat[at, c])) for c in (0, 1)]], [key, "xs", "ys"])

    return polylines.select(key, F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>")).mapInArrow(run, f"{key} {kind}, xs array<double>, ys array<double>")

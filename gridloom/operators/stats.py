"""Statistics of images and quantisation steps, as aggregates over pixel rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import color
from gridloom.operators.tiles import Patch, over_tiles

BINS = 64


def with_lab(pixels: DataFrame) -> DataFrame:
    """pixels (r, g, b in [0, 1]) with CIELAB as cl, ca and cb; column names ignore case, so L, a, b would hide b."""
    l, a, b = color.lab_of(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    return pixels.withColumn("cl", l).withColumn("ca", a).withColumn("cb", b)


def image_stats(lab: DataFrame) -> DataFrame:
    """Colourfulness, LAB mean and deviation, brightness, contrast, saturation for each image; one pass."""
    rg, yb = (F.col("r") - F.col("g")) * 255, ((F.col("r") + F.col("g")) / 2 - F.col("b")) * 255
    spread = F.hypot(F.stddev_pop(rg), F.stddev_pop(yb)) + 0.3 * F.hypot(F.avg(rg), F.avg(yb))
    own = [f(c).alias(f"{n}_{c[1]}") for c in ("cl", "ca", "cb") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return lab.groupBy("image").agg(spread.alias("colorfulness"), *own, F.avg(F.hypot("ca", "cb")).alias("saturation"))


def luminance_histogram(lab: DataFrame, bins: int = BINS) -> DataFrame:
    """(image, bin, n); the last bin holds 100."""
    at = F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("cl"))) / 100 * bins)).cast("int")
    return lab.groupBy("image", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy_bits(histogram: DataFrame) -> DataFrame:
    p = F.col("n") / F.sum("n").over(W.partitionBy("image"))
    return histogram.select("image", p.alias("p")).groupBy("image").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"))


def edge_density(lab: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of pixels whose 3x3 Sobel magnitude on L/100 exceeds threshold; borders mirror without the edge row."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        v = p.values["cl"] / 100
        h, w = v.shape
        # a ring row that isn't there is the row on the other side
        side = lambda own, n, size: (int(own.start == 0), int(own.stop >= size))
        rows, cols = (side(o, o.start, n) for o, n in zip(p.own, (h, w), strict=True))
        v = np.pad(v, (rows, cols), mode="reflect" if min(h, w) > 1 else "edge")
        smooth_y = v[:-2] + 2 * v[1:-1] + v[2:]
        smooth_x = v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]
        m = np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2])
        return {"strong": np.array([int((m > threshold).sum())]), "n": np.array([m.size])}

    each = over_tiles(lab, ["cl"], run, "strong long, n long", reach=1)
    return each.groupBy("image").agg((F.sum("strong") / F.sum("n")).alias("edge_density"))


def palette_proposal(stats: DataFrame, k_min: int = 8, k_max: int = 30) -> DataFrame:
    """(image, n_colors, smooth_passes) from colourfulness, edge_density and entropy_bits; null passes: keep the default."""
    k = F.bround(6 + 0.12 * F.col("colorfulness") + 6 * F.col("edge_density") + 0.8 * F.col("entropy_bits")).cast("int")
    return stats.select("image", F.greatest(F.lit(k_min), F.least(F.lit(k_max), k)).alias("n_colors"), F.when(F.col("edge_density") > 0.25, 3).when(F.col("edge_density") < 0.05, 1).alias("smooth_passes"))


def stride_sample(rows: DataFrame, rank: Column, sample: int) -> DataFrame:
    """Rows 0, s, 2s, ... of rank, `sample` of them (all if there are fewer); the count is one row, joined by the plan itself."""
    total = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / sample)).alias("_step"))
    return rows.join(F.broadcast(total), F.lit(True)).where((rank % F.col("_step") == 0) & (rank < F.col("_step") * sample)).drop("_step")


def nearest(vector: Column, centres: list[list[float]]) -> Column:
    """The index of the nearest centre (ties: the lowest), as one expression without a join."""
    return _nearest(vector, centres)["i"]


def _nearest(vector: Column, centres: list[list[float]]) -> Column:
    each = F.array(*[F.struct(F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.array_min(each)


def lloyd(rows: DataFrame, vector: str, centres: list[list[float]], still: float = 0.05, rounds: int = 50) -> DataFrame:
    """(centre, n, inertia, moved) after Lloyd's iterations: means of the nearest rows until no centre moves by `still` or more.

    Each round is one aggregate of the rows; the driver holds the centres alone (their number times the dimensions). A class
    without rows starts again at the row farthest from its centre.
    """
    spark = rows.sparkSession
    moved = 0.0
    for _ in range(rounds):
        near = rows.select(vector, _nearest(F.col(vector), centres).alias("m"))
        each = near.select(F.col("m.i").alias("i"), F.posexplode(vector).alias("d", "v")).groupBy("i", "d").agg(F.avg("v").alias("v"))
        new = [list(c) for c in centres]
        seen = set()
        for r in each.collect():
            new[r.i][r.d] = r.v
            seen.add(r.i)
        empty = [k for k in range(len(centres)) if k not in seen]
        if empty:
            for k, r in zip(empty, near.orderBy(F.col("m.d").desc(), vector).limit(len(empty)).collect(), strict=False):
                new[k] = list(r[0])
        moved = max(math.dist(a, b) for a, b in zip(centres, new, strict=True))
        centres = new
        if moved < still and not empty:
            break
    near = rows.select(_nearest(F.col(vector), centres).alias("m"))
    sizes = near.groupBy(F.col("m.i").alias("centre")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m.d"), 6).alias("inertia"))
    every = spark.range(len(centres)).select(F.col("id").cast("int").alias("centre"))
    return every.join(sizes, "centre", "left").select("centre", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("inertia", F.lit(0.0)).alias("inertia"), F.lit(moved < still).alias("settled"))


def class_means(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(old, label, n, means): classes renumbered by falling count, ties by their means in order."""
    agg = rows.groupBy(F.col(label).alias("old")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in columns])
    return agg.withColumn("label", (F.row_number().over(W.orderBy(F.col("n").desc(), *columns)) - 1).cast("int"))


def size_distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, extremes, mean, median, population deviation, and the 10th and 90th percentiles (linear)."""
    p = F.expr(f"percentile({value}, array(0.1, 0.5, 0.9))")
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("std"), p.alias("p"),
    ).select(*by, "n", "low", "high", "mean", "std", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p10", "median", "p90"))])


def engine_score(dimensions: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, score): 100 times the weighted geometric mean of (key, name, value); a missing dimension counts as 1."""
    w = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("name"))
    total = math.fsum(weights.values())
    return dimensions.where(F.col("name").isin(*weights)).groupBy(key).agg(F.round(100 * F.exp(F.sum(w * F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.col("value"))))) / total), 6).alias("score"))


def regressions(now: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """now(keys, value, lo, hi, gate) against baseline(keys, base, tolerance): gates by band, others by relative change (absolute where the base is 0)."""
    moved = F.when(F.col("base") == 0, F.abs("value")).otherwise(F.abs((F.col("value") - F.col("base")) / F.nullif("base", F.lit(0.0))))
    ok = F.when(F.col("gate"), F.col("value").between(F.col("lo"), F.col("hi"))).when(F.col("base").isNull(), True).otherwise(moved <= F.col("tolerance"))
    return now.join(baseline, keys, "left").select(*keys, "value", ok.alias("passed"))

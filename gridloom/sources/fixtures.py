"""Synthetic label maps for tests and benchmarks, made by Spark from ranges and small literal tables; a catalogue and a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalogue: id, category, tier, kind, height, width, number.
CATALOGUE = (
    ("checkerboard", "geometry", "smoke", "checker", 64, 64, 8), ("bands", "geometry", "smoke", "bands", 48, 80, 6), ("blobs", "organic", "full", "seeds", 96, 96, 24),
    ("portrait", "portrait", "full", "ellipses", 96, 72, 5), ("horizon", "landscape", "full", "horizon", 64, 96, 7), ("blocks", "architecture", "full", "blocks", 80, 80, 16),
    ("wedges", "geometry", "full", "wedges", 72, 72, 12), ("flat", "degenerate", "full", "flat", 64, 64, 1), ("noise", "degenerate", "full", "noise", 64, 64, 4), ("lines", "line_art", "full", "lines", 64, 64, 2),
)


def catalogue(spark: SparkSession) -> DataFrame:
    """(fixture, category, tier, kind, h, w, k); smoke fixtures run first, full ones are all of them."""
    return spark.createDataFrame(list(CATALOGUE), "fixture string, category string, tier string, kind string, h int, w int, k int")


def _seed(i: Column, salt: int, size: Column) -> Column:
    """A pseudo-random place below size, from a multiplicative hash of small whole numbers (the same in any engine)."""
    return (i * 7919 + salt * 104729).cast("bigint") * 48271 % 2147483647 % size


def label_maps(spark: SparkSession, fixtures: DataFrame | None = None) -> DataFrame:
    """(image, y, x, label) of all fixtures; cells come from a range, so any size is made in parallel."""
    f = catalogue(spark) if fixtures is None else fixtures
    y, x, h, w, k = (F.col(c) for c in ("y", "x", "h", "w", "k"))
    cells = f.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    near = F.expr(
        "array_min(transform(sequence(0, k - 1), i -> struct(pow(y - bigint(i * 7919 + 104729) * 48271 % 2147483647 % h, 2) + pow(x - bigint(i * 7919 + 209458) * 48271 % 2147483647 % w, 2) as d, i))).i"
    )
    ring = F.floor(F.sqrt(F.pow((2 * y - h + 1) / h, F.lit(2.0)) + F.pow((2 * x - w + 1) / w, F.lit(2.0))) * k / 1.5)
    angle = F.floor((F.atan2((2 * y - h + 1).cast("double"), (2 * x - w + 1).cast("double")) + 3.141592653589793) * k / 6.283185307179587)
    label = (
        F.when(F.col("kind") == "checker", (F.floor(y / k) + F.floor(x / k)) % 2).when(F.col("kind") == "bands", F.floor(x * k / w)).when(F.col("kind") == "seeds", near)
        .when(F.col("kind") == "ellipses", F.least(ring, k - 1)).when(F.col("kind") == "horizon", F.floor(y * k / h)).when(F.col("kind") == "blocks", F.floor(y / k) * 7 % 5 + F.floor(x / k) % 3)
        .when(F.col("kind") == "wedges", F.least(angle, k - 1)).when(F.col("kind") == "noise", _seed(F.floor(y / 4) * 1000 + F.floor(x / 4), 3, k)).when(F.col("kind") == "lines", ((y % 9 == 0) | (x % 13 == 0)).cast("int"))
        .otherwise(0)
    )
    return cells.select(F.col("fixture").alias("image"), "y", "x", label.cast("int").alias("label"))


def manifest(maps: DataFrame) -> DataFrame:
    """(image, cells, sha256): a hash of each fixture's labels in raster order."""
    return maps.groupBy("image").agg(F.count(F.lit(1)).alias("cells"), F.array_sort(F.collect_list(F.struct("y", "x", "label"))).alias("l")).select(
        "image", "cells", F.sha2(F.array_join(F.transform("l", lambda c: c["label"].cast("string")), ",").cast("binary"), 256).alias("sha256")
    )

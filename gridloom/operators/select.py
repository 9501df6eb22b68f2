"""Choices and measures over regions, faces, labels and colours, as joins and aggregates of their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def both_ways(edges: DataFrame) -> DataFrame:
    """(image, region, near, w) of edges (image, a, b, w)."""
    return edges.select("image", F.col("a").alias("region"), F.col("b").alias("near"), "w").union(edges.select("image", "b", "a", "w"))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(image, region, n): adjacent regions."""
    return both_ways(edges).groupBy("image", "region").agg(F.count(F.lit(1)).alias("n"))


def background(borders: DataFrame) -> DataFrame:
    """(image, region): the region with most of the page's edge; ties: the lowest id."""
    return borders.groupBy("image").agg(F.max_by("region", F.struct("border", -F.col("region"))).alias("region"))


def majority_flags(cells: DataFrame, flag: Column) -> DataFrame:
    """(image, region, flagged): at least half of the region's cells, and one at least, have the flag."""
    n = F.sum(flag.cast("int"))
    return cells.groupBy("image", "region").agg(((n * 2 >= F.count(F.lit(1))) & (n > 0)).alias("flagged"))


def largest(records: DataFrame, share: float) -> DataFrame:
    """(image, region, area): the larger ceil(n * share) regions; ties: the lower id."""
    w = W.partitionBy("image")
    ranked = records.withColumn("k", F.row_number().over(w.orderBy(F.col("area").desc(), "region"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("k") <= F.ceil(F.col("n") * share)).select("image", "region", "area")


def touched(cells: DataFrame, mask: Column) -> DataFrame:
    """(image, region) with any masked cell."""
    return cells.where(mask).select("image", "region").distinct()


def paper(records: DataFrame, borders: DataFrame, palette: DataFrame, light: float = 95.0, share: float = 0.25) -> DataFrame:
    """(image, region) of near-white regions that touch the page's edge or cover this share of it. palette: (label, cl), at most 64 rows."""
    page = F.sum("area").over(W.partitionBy("image"))
    rec = records.select("image", "region", "label", "area", page.alias("page")).join(F.broadcast(palette.select("label", "cl")), "label").where(F.col("cl") >= light)
    return rec.join(borders, ["image", "region"]).where((F.col("border") > 0) | (F.col("area") >= share * F.col("page"))).select("image", "region")


def coverage(records: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(image, label, coverage): cells a colour covers, without the regions of skip (image, region)."""
    rec = records if skip is None else records.join(skip, ["image", "region"], "left_anti")
    return rec.groupBy("image", "label").agg(F.sum("area").alias("coverage"))


def compact_palette(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(image, label, new): colours with cells, renumbered without gaps; all keep their numbers where fewer than two have any.

    labels: (label) of the palette, at most 64 rows.
    """
    used = records.select("image", "label").distinct().withColumn("used", F.lit(True))
    every = records.select("image").distinct().join(F.broadcast(labels.select("label")), F.lit(True)).join(used, ["image", "label"], "left")
    w = W.partitionBy("image")
    n = F.count("used").over(w)
    rank = F.count("used").over(w.orderBy("label").rowsBetween(W.unboundedPreceding, 0)) - 1
    return every.select("image", "label", F.when(n < 2, F.col("label")).when(F.col("used"), rank).otherwise(-1).cast("int").alias("new"))


def drop_masked_colours(records: DataFrame, masked: DataFrame, palette: DataFrame) -> DataFrame:
    """(image, label, new): colours that only masked regions (image, region) use take the number of the nearest one kept (CIE76; ties: the
    lowest); kept ones are renumbered without gaps. palette: (label, cl, ca, cb), at most 64 rows."""
    free = records.join(masked, ["image", "region"], "left_anti").select("image", "label").distinct().withColumn("kept", F.lit(True))
    every = records.select("image", "label").distinct().join(free, ["image", "label"], "left")
    number = F.count("kept").over(W.partitionBy("image").orderBy("label").rowsBetween(W.unboundedPreceding, 0)) - 1
    every = every.withColumn("number", F.when(F.col("kept"), number)).join(F.broadcast(palette), "label")
    kept = every.where("kept").select("image", "number", F.col("label").alias("to"), *[F.col(c).alias(f"{c}2") for c in ("cl", "ca", "cb")])
    far = sum((F.pow(F.col(c) - F.col(f"{c}2"), F.lit(2.0)) for c in ("cl", "ca", "cb")), F.lit(0.0))
    orphan = every.where("kept is null").select("image", "label", "cl", "ca", "cb").join(kept, "image").groupBy("image", "label").agg(F.min_by("number", F.struct(far, "to")).alias("new"))
    return every.where("kept").select("image", "label", F.col("number").alias("new")).unionByName(orphan)


def region_graph(edges: DataFrame, records: DataFrame, delta: DataFrame) -> DataFrame:
    """(image, a, b, w, de): edges with the colour difference of their sides. delta: (label, cand, de), at most 64 x 64 rows."""
    side = lambda s: records.select("image", F.col("region").alias(s), F.col("label").alias(f"{s}_label"))
    met = edges.join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    return met.join(F.broadcast(delta.select(F.col("label").alias("a_label"), F.col("cand").alias("b_label"), "de")), ["a_label", "b_label"]).select("image", "a", "b", "w", "de")


def inradius(distance: DataFrame) -> DataFrame:
    """(image, region, inradius) from each cell's squared distance d2 to its region's border."""
    return distance.groupBy("image", "region").agg(F.sqrt(F.max("d2").cast("double")).alias("inradius"))


def arc_least_area(sides: DataFrame, areas: DataFrame) -> DataFrame:
    """(image, arc, least): the lesser area of an arc's faces. sides: (image, arc, region); areas: (image, region, area)."""
    return sides.join(areas, ["image", "region"]).groupBy("image", "arc").agg(F.min("area").alias("least"))


def inside_rings(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, inside): even-odd test of points (keys, id, x, y) against the segments (keys, x0, y0, x1, y1) of their own face.

    An equi-join on the face; each segment counts once for a point whose ray to the right it crosses.
    """
    over = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    hit = over & (F.col("x") < F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))
    return points.join(segments, keys).groupBy(*keys, "id").agg((F.sum(F.coalesce(hit, F.lit(False)).cast("int")) % 2 == 1).alias("inside"))


def overlap_rate(met: DataFrame, n: DataFrame) -> DataFrame:
    """(image, rate): percentage of rectangles that overlap another one (image, id, each once); n: (image, n)."""
    met = met.groupBy("image").agg(F.count(F.lit(1)).alias("met"))
    return n.join(met, "image", "left").select("image", (100.0 * F.coalesce("met", F.lit(0)) / F.col("n")).alias("rate"))

"""The grid queries over the driver's tables, and the same results as SQL for DuckDB.

part is a grid 50 wide with labels p_size % 4 and colours from p_retailprice and p_size; orders is a grid 150 wide with
labels from o_orderpriority; customer is 50 wide with c_mktsegment.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.functions import color, layout
from gridloom.kernels import colours
from gridloom.operators import boundary, geometry, grid, merge, raster, stats
from gridloom.plans import config
from gridloom.sources import svg


_LAB = ("cl", "ca", "cb")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(spark, sf_dir):
    price = F.floor("p_retailprice").cast("long")
    return grid.lift(
        _read(spark, sf_dir, "part"), "p_partkey", 50, F.col("p_size") % 4, r=(price % 256) / 255, g=(F.floor(price / 3) % 256) / 255, b=((F.col("p_size") * 5) % 256) / 255,
    )


def _orders(spark, sf_dir):
    return grid.lift(_read(spark, sf_dir, "orders"), "o_orderkey", 150, F.substring("o_orderpriority", 1, 1).cast("int") - 1)


def _regions(spark, sf_dir):
    return grid.components(_part(spark, sf_dir).select("image", "y", "x", "label"))


def _lab(spark, sf_dir):
    return stats.with_lab(_part(spark, sf_dir))


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def px_srgb_to_lab(spark, sf_dir):
    return _r6(_lab(spark, sf_dir).select("y", "x", "cl", "ca", "cb"), "cl", "ca", "cb").toDF("y", "x", "lab_l", "lab_a", "lab_b")


def px_lab_roundtrip(spark, sf_dir):
    d = _lab(spark, sf_dir)
    back = color.rgb_of(F.col("cl"), F.col("ca"), F.col("cb"))
    return d.select("y", "x", *[F.round(c, 6).alias(n) for c, n in zip(back, ("r2", "g2", "b2"), strict=True)], color.ink_on(*back).alias("ink"))


def _palette(spark, sf_dir):
    """The mean colour of each size class (at most 16 rows)."""
    return _lab(spark, sf_dir).groupBy((F.round(F.col("b") * 51) % 16).cast("int").alias("idx")).agg(*[F.round(F.avg(c), 6).alias(c) for c in _LAB])


def _palette_pairs(spark, sf_dir):
    p = _palette(spark, sf_dir)
    q = p.select(F.col("idx").alias("j"), *[F.col(c).alias(f"{c}2") for c in _LAB])
    # a table of at most 16 x 16 rows
    return p.withColumnRenamed("idx", "i").join(F.broadcast(q), F.lit(True))


def delta_e76_table(spark, sf_dir):
    d = color.delta_e_76([F.col(c) for c in _LAB], [F.col(f"{c}2") for c in _LAB])
    return _palette_pairs(spark, sf_dir).select("i", "j", F.round(d, 6).alias("de"))


def delta_e00_table(spark, sf_dir):
    d = color.delta_e_2000([F.col(c) for c in _LAB], [F.col(f"{c}2") for c in _LAB])
    return _palette_pairs(spark, sf_dir).select("i", "j", F.round(d, 6).alias("de"))


def palette_gate(spark, sf_dir):
    t = delta_e00_table(spark, sf_dir).where("i <> j").agg(F.min("de").alias("separation"))
    return t.select("separation", F.when(F.col("separation") < 7, "fatal").when(F.col("separation") < 12, "warning").otherwise("pass").alias("severity"))


def image_stats(spark, sf_dir):
    out = stats.image_stats(_lab(spark, sf_dir))
    return _r6(out, *[c for c in out.columns if c != "image"])


def luminance_hist(spark, sf_dir):
    return stats.luminance_histogram(_lab(spark, sf_dir)).drop("image")


def entropy_bits(spark, sf_dir):
    return _r6(stats.entropy_bits(stats.luminance_histogram(_lab(spark, sf_dir))), "entropy_bits")


def sobel_edge_density(spark, sf_dir):
    return _r6(stats.edge_density(_lab(spark, sf_dir)), "edge_density")


def auto_tune(spark, sf_dir):
    lab = _lab(spark, sf_dir)
    s = stats.image_stats(lab).select("image", "colorfulness").join(stats.edge_density(lab), "image").join(stats.entropy_bits(stats.luminance_histogram(lab)), "image")
    return stats.palette_proposal(s)


def stride_sample(spark, sf_dir):
    return stats.stride_sample(_read(spark, sf_dir, "part"), F.col("p_partkey"), 77).select("p_partkey")


def nearest_center_assign(spark, sf_dir):
    centres = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(8)]
    v = F.transform("embedding", lambda x: x.cast("double"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", stats.nearest(v, centres).alias("centre"))


def class_means_renumber(spark, sf_dir):
    return stats.class_means(_lab(spark, sf_dir), "label", list(_LAB)).toDF("old", "n", "lab_l", "lab_a", "lab_b", "label")


def modal_filter_1(spark, sf_dir):
    return grid.modal_filter(_orders(spark, sf_dir)).drop("image")


def crack_edges(spark, sf_dir):
    return grid.cracks(_orders(spark, sf_dir)).select("y", "x", "dir")


def junctions(spark, sf_dir):
    return grid.corners(_regions(spark, sf_dir)).select("v", "u")


def component_map(spark, sf_dir):
    return _regions(spark, sf_dir).select("y", "x", "region")


def components_count(spark, sf_dir):
    return _regions(spark, sf_dir).agg(F.countDistinct("region").alias("n"))


def region_records(spark, sf_dir):
    return grid.region_records(_regions(spark, sf_dir)).drop("image")


def region_edges(spark, sf_dir):
    return grid.region_edges(_regions(spark, sf_dir)).drop("image")


def region_perimeter(spark, sf_dir):
    c = _regions(spark, sf_dir)
    return grid.perimeters(c, grid.region_edges(c)).drop("image")


def boundary_identity(spark, sf_dir):
    c = _regions(spark, sf_dir)
    e = grid.region_edges(c)
    total = grid.perimeters(c, e).agg(F.sum("perimeter").alias("sides"), F.sum("border").alias("border"))
    cracks = grid.cracks(c, "region").agg(F.count(F.lit(1)).alias("cracks"))  # one row
    return total.join(F.broadcast(cracks), F.lit(True)).select("cracks", "border", (F.col("sides") == 2 * F.col("cracks") - F.col("border")).alias("holds"))


def fill_holes(spark, sf_dir):
    c = _regions(spark, sf_dir)
    return grid.fill_holes(c, grid.region_edges(c), 3).drop("image")


def area_opening(spark, sf_dir):
    """Regions of fewer than 4 cells take a neighbour's label; differences of colour are 5 for each step between labels."""
    c = _regions(spark, sf_dir)
    delta = spark.createDataFrame([(a, b, 5.0 * abs(a - b)) for a in range(4) for b in range(4)], "label int, cand int, de double")
    return grid.open_areas(c, grid.region_records(c), grid.region_edges(c), 4, delta).drop("image")


def region_topk_area(spark, sf_dir):
    """The larger half of the regions; ties: the lower id."""
    rec = grid.region_records(_regions(spark, sf_dir))
    w = W.partitionBy("image")
    ranked = rec.withColumn("k", F.row_number().over(w.orderBy(F.col("area").desc(), "region"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("k") <= F.ceil(F.col("n") * 0.5)).select("region", "area")


def palette_compact(spark, sf_dir):
    """Labels with pixels, renumbered without gaps, with coverage."""
    cover = _orders(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("coverage"))
    return cover.select("label", (F.dense_rank().over(W.orderBy("label")) - 1).alias("new"), "coverage")


def size_distribution(spark, sf_dir):
    return stats.size_distribution(grid.region_records(_regions(spark, sf_dir)), ["label"], "area")


def compactness(spark, sf_dir):
    c = _regions(spark, sf_dir)
    rec = grid.region_records(c).join(grid.perimeters(c, grid.region_edges(c)), ["image", "region"])
    return rec.select("region", F.round(layout.compactness(F.col("area"), F.col("perimeter")), 6).alias("compactness"), F.round(layout.compact_area(F.col("area").cast("double"), F.col("perimeter")), 6).alias("compact_area"))


def _boxes(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(
        F.lit("grid").alias("image"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 500).alias("x0"), ((F.col("p_partkey") * 91) % 700).alias("y0"), "p_size",
    ).select("image", "id", "x0", "y0", (F.col("x0") + F.col("p_size") % 7).alias("x1"), (F.col("y0") + F.col("p_size") % 5).alias("y1"))


def bbox_range_join(spark, sf_dir):
    return geometry.box_overlaps(_boxes(spark, sf_dir), 16, ["image"]).select("a", "b")


def _rings(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    pts = F.expr("array(struct(0 as ord, x0 as x, y0 as y), struct(1 as ord, x1 + 1 as x, y0 as y), struct(2 as ord, x1 + 2 as x, y1 + 3 as y), struct(3 as ord, x0 as x, y1 + 1 as y))")
    return b.select("id", F.explode(pts).alias("p")).select("id", "p.ord", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def ring_shoelace(spark, sf_dir):
    return _r6(geometry.ring_measures(_rings(spark, sf_dir), ["id"]), "area", "perimeter")


def curvature_energy(spark, sf_dir):
    return _r6(geometry.turning_energy(_rings(spark, sf_dir), ["id"], 120.0), "energy")


def bezier_flatten(spark, sf_dir):
    b = _boxes(spark, sf_dir).where("image is not null")
    seg = b.select("id", F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.col("x1").alias("ex"), F.col("y1").alias("ey"))
    seg = seg.select("id", F.col("sx").alias("x0"), F.col("sy").alias("y0"), (F.col("sx") + 3).alias("x1"), (F.col("sy") - 2).alias("y1"), (F.col("ex") + 1).alias("x2"), (F.col("ey") + 4).alias("y2"), F.col("ex").alias("x3"), F.col("ey").alias("y3"))
    return _r6(geometry.flatten_cubic(seg, ["id"], F.lit(5)), "x", "y")


def font_fit(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(layout.fitted_size(F.col("p_size") / 2, F.length(F.col("p_size").cast("string"))), 6).alias("font"), F.when(F.col("p_size") <= 36, layout.code_of(F.least(F.col("p_size"), F.lit(36)))).alias("code"))


def letterbox(spark, sf_dir):
    d = _part(spark, sf_dir)
    _, px, py = layout.letterbox(50, 50, 540.0, 720.0, 36.0, 36.0)
    return d.select("y", "x", F.round(px(2 * F.col("x") - 1), 6).alias("pt_x"), F.round(py(2 * F.col("y") - 1), 6).alias("pt_y"))


def legend_layout(spark, sf_dir):
    """Pairs of name box and chip for each size class, as many in a row as fit 300 pt."""
    chip, box, gap, between = 20.0, 60.0, 4.0, 10.0
    row = int((300 + between) // (box + gap + chip + between))
    i = F.col("idx")
    step = box + gap + chip + between
    return _palette(spark, sf_dir).select("idx", ((i % row) * step + box + gap).alias("chip_x"), (F.floor(i / row) * (chip + between)).cast("double").alias("chip_y"), layout.code_of(i + 1).alias("code"))


def regression_check(spark, sf_dir):
    """Order totals since 1995 by status against those of the years before: a gate for status F, monitors for the others."""
    o = _read(spark, sf_dir, "orders").withColumn("late", F.year("o_orderdate") >= 1995)
    now = o.where("late").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 6).alias("value")).withColumn("lo", F.lit(1000.0)).withColumn("hi", F.lit(250000.0)).withColumn("gate", F.col("o_orderstatus") == "F")
    base = o.where("not late").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 6).alias("base")).withColumn("tolerance", F.lit(0.001))
    return stats.regressions(now, base, ["o_orderstatus"])


SCORE_WEIGHTS = {"fidelity": 0.3, "geometry": 0.25, "printability": 0.15, "color": 0.15, "speed": 0.1, "efficiency": 0.05}


def engine_score(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in SCORE_WEIGHTS])
    d = _read(spark, sf_dir, "part").select("p_partkey", F.explode(names).alias("name"), ((F.col("p_size") + F.length("p_name")) / 100).alias("v"))
    return stats.engine_score(d.select("p_partkey", "name", (F.col("v") + F.length("name") / 50).alias("value")), "p_partkey", SCORE_WEIGHTS)


def merge_tiny(spark, sf_dir):
    c = _regions(spark, sf_dir)
    e = grid.region_edges(c)
    lab = np.array([[20.0 * k, 0.0, 0.0] for k in range(4)])
    return merge.merge_tiny(grid.region_records(c), e, grid.perimeters(c, e), lab, colours.table(lab), 6.0).drop("image")


def simplify_vw(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("double")).alias("xs"), "embedding")
    return geometry.simplify(rows.withColumnRenamed("embedding", "ys"), "vec_id", 0.3)


def arc_trace(spark, sf_dir):
    a = boundary.arcs(_regions(spark, sf_dir))
    return a.select("arc", "left_region", "right_region", "closed", (F.size("vs") - 1).alias("length"))


def arc_sides(spark, sf_dir):
    """Border length of every pair of sides, from the traced arcs."""
    a = arc_trace(spark, sf_dir)
    return a.groupBy(F.least("left_region", "right_region").alias("left_region"), F.greatest("left_region", "right_region").alias("right_region")).agg(F.sum("length").alias("w"))


def svg_fingerprint(spark, sf_dir):
    return svg.fingerprint(svg.pages(boundary.arcs(_regions(spark, sf_dir)), 50, 400)).drop("image")


def pole_of_inaccessibility(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    xs, ys = F.expr("array(x0, x1 + 2, x1 + 2, x0)"), F.expr("array(y0, y0, y1 + 2, y1 + 2)")
    return _r6(boundary.poles(b.select("id", xs.alias("xs"), ys.alias("ys")), "id").select("id", "clearance"), "clearance")


def config_resolve(spark, sf_dir):
    """Resolved settings of every preset, with their hash."""
    rows = []
    for name in config.PRESETS:
        c = config.resolve(config.DEFAULTS, config.preset(name), proposals={"quantize": {"n_colors": 99, "sample_px": 100000}})
        rows.append((name, float(c["merge"]["d_min_mm"]), int(c["quantize"]["n_colors"]), int(c["quantize"]["sample_px"]), len(config.config_hash(c))))
    return spark.createDataFrame(rows, "preset string, d_min_mm double, n_colors int, sample_px int, hash_length int")


def lloyd_step(spark, sf_dir):
    """One step of k-means over vectors: nearest of 8 fixed centres, then the means of all dimensions of each class."""
    centres = [[1.0 if i == k else 0.0 for i in range(64)] for k in range(8)]
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _read(spark, sf_dir, "embeddings").select(stats.nearest(v, centres).alias("centre"), "embedding").select("centre", F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("centre", "dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def distance_transform(spark, sf_dir):
    """Distance of every cell to the nearest one with label 0."""
    out = raster.distance_transform(_part(spark, sf_dir), F.col("label") == 0)
    return out.select("y", "x", F.round(F.sqrt("d2"), 6).alias("d"), "near_y", "near_x")


def dilate_mask(spark, sf_dir):
    return raster.dilate(_part(spark, sf_dir), F.col("r") > 0.9, 2).select("y", "x", "grown")


def resize_area(spark, sf_dir):
    return _r6(raster.resize_area(_part(spark, sf_dir), 20, ["r", "g", "b"]).drop("image"), "r", "g", "b")


def ssim(spark, sf_dir):
    """The red channel against the green one."""
    p = _part(spark, sf_dir)
    one, two = (p.select("image", "y", "x", F.round(F.col(c) * 255).alias("v")) for c in ("r", "g"))
    return _r6(raster.ssim(one, two, "v").drop("image"), "ssim")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        px_srgb_to_lab, px_lab_roundtrip, delta_e76_table, delta_e00_table, palette_gate, image_stats, luminance_hist, entropy_bits,
        sobel_edge_density, auto_tune, stride_sample, nearest_center_assign, class_means_renumber, modal_filter_1, crack_edges, junctions,
        component_map, components_count, region_records, region_edges, region_perimeter, boundary_identity, fill_holes, area_opening,
        region_topk_area, palette_compact, size_distribution, compactness, bbox_range_join, ring_shoelace, curvature_energy, bezier_flatten,
        font_fit, letterbox, legend_layout, regression_check, engine_score, merge_tiny, simplify_vw,
        arc_trace, arc_sides, svg_fingerprint, pole_of_inaccessibility, config_resolve, lloyd_step,
        distance_transform, dilate_mask, resize_area, ssim,
    )
}

"""More queries over the driver's tables: page arithmetic, choices of regions, gates, run analytics, fixtures, many images, conversion.

orders is also read as many images ("sheets") of 32 x 32 cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import color, layout
from gridloom.operators import boundary, geometry, grid, raster, runs, select, stats
from gridloom.plans.convert import convert, rows
from gridloom.plans.queries import _boxes, _lab, _orders, _part, _r6, _read, _regions, _rings
from gridloom.plans.scratch import cut
from gridloom.plans.shipping import ship
from gridloom.sources import fixtures, images


def _sheets(spark, sf_dir):
    return grid.lift_sheets(_read(spark, sf_dir, "orders"), "o_orderkey", 32, F.substring("o_orderpriority", 1, 1).cast("int") - 1)


def _sheet_regions(spark, sf_dir):
    return cut(grid.components(_sheets(spark, sf_dir)))


def _steps(spark, n):
    """Colour differences of 5 for each step between labels (n x n rows)."""
    return spark.createDataFrame([(a, b, 5.0 * abs(a - b)) for a in range(n) for b in range(n)], "label int, cand int, de double")


def _label_lab(spark, sf_dir):
    """The mean colour of each of the four labels of the part grid."""
    return _lab(spark, sf_dir).groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("cl", "ca", "cb")])


# --- arithmetic of pages


def fixed_coordinates(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", layout.fixed(F.col("p_retailprice") / 16).alias("x"), layout.fixed(-F.col("p_size") / 16.0).alias("y"), layout.fixed((F.col("p_size") - 25) / 100000.0).alias("z"))


def xml_escape(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", layout.escaped(F.concat(F.lit("<"), "p_name", F.lit(" & "), "p_brand", F.lit(">&amp;"))).alias("text"))


def units(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    x, y, w, h = layout.content_box(215.9, 279.4, 12.7)
    size = F.col("p_size").cast("double")
    return _r6(p.select("p_partkey", layout.mm_to_pt(size).alias("pt"), layout.pt_to_mm(size).alias("mm"), layout.px_a_mm(size - 10).alias("px_mm"), (size / 50 * w + x).alias("at_x"), (size / 50 * h + y).alias("at_y")), "pt", "mm", "px_mm", "at_x", "at_y")


def label_sizes(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    r, n = F.col("p_size") / 7.0, F.length(F.col("p_size").cast("string"))
    w, h = layout.text_box(n, layout.micro_size(r, n))
    return _r6(p.select("p_partkey", layout.fitted_size(r, n).alias("fitted"), layout.micro_size(r, n).alias("micro"), w.alias("w"), h.alias("h")), "fitted", "micro", "w", "h")


def floors(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    d = F.col("p_size") / 10.0
    return _r6(p.select("p_partkey", layout.speck_floor(d, F.lit(6.0)).alias("speck"), layout.tolerance_scale(F.col("p_retailprice") / 10, 1.5).alias("scale")), "scale")


def stage_seeds(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", layout.stage_seed(F.col("p_partkey"), "quantize").alias("quantize"), layout.stage_seed(F.col("p_partkey"), "organic", "|").alias("organic"))


def hex_colours(spark, sf_dir):
    d = _part(spark, sf_dir)
    rgb = [F.col(c) for c in ("r", "g", "b")]
    return d.select("y", "x", color.hex_of(*rgb).alias("hex"), color.ink_on(*rgb).alias("ink"))


# --- choices and measures of regions


def region_neighbours(spark, sf_dir):
    return select.neighbour_counts(grid.region_edges(_regions(spark, sf_dir))).drop("image")


def background_region(spark, sf_dir):
    return select.background(grid.page_border(_sheet_regions(spark, sf_dir)))


def majority_flag(spark, sf_dir):
    c = _regions(spark, sf_dir).join(_part(spark, sf_dir).select("image", "y", "x", "r"), ["image", "y", "x"])
    return select.majority_flags(c, F.col("r") > 0.7).drop("image")


def region_inradius(spark, sf_dir):
    """Distance from a cell to the nearest one that has a neighbour (or the page's edge) across a border; 0 on the border itself."""
    c = cut(_regions(spark, sf_dir))
    e = grid.cracks(c, "region")
    edge = F.col("dir") == "r"
    both = e.select("image", "y", "x").union(e.select("image", F.when(edge, F.col("y")).otherwise(F.col("y") + 1), F.when(edge, F.col("x") + 1).otherwise(F.col("x")))).distinct()
    marked = c.join(both.withColumn("rim", F.lit(True)), ["image", "y", "x"], "left")
    d = raster.distance_transform(marked, F.col("rim").isNotNull())
    return _r6(select.inradius(c.join(d, ["image", "y", "x"])).drop("image"), "inradius")


def white_paper(spark, sf_dir):
    c = _regions(spark, sf_dir)
    return select.paper(grid.region_records(c), grid.page_border(c), _label_lab(spark, sf_dir), 46.0).drop("image")


def labeled_coverage(spark, sf_dir):
    rec = grid.region_records(_regions(spark, sf_dir))
    return select.coverage(rec, select.largest(rec, 0.1).select("image", "region")).drop("image")


def palette_renumber(spark, sf_dir):
    """Sheets keep the labels that some region of four cells or more has; palettes of six colours lose the others."""
    rec = grid.region_records(_sheet_regions(spark, sf_dir)).where("area >= 8")
    return select.compact_palette(rec, spark.range(6).select(F.col("id").cast("int").alias("label")))


def bitmap_regions(spark, sf_dir):
    c = _regions(spark, sf_dir).join(_part(spark, sf_dir).select("image", "y", "x", "r"), ["image", "y", "x"])
    return select.touched(c, F.col("r") > 0.85).drop("image")


def masked_colours(spark, sf_dir):
    """Colours of the part grid's large regions alone; those of the others go to the nearest one."""
    rec = grid.region_records(_regions(spark, sf_dir))
    masked = rec.where("area < 4 or label = 0").select("image", "region")
    return select.drop_masked_colours(rec, masked, _label_lab(spark, sf_dir)).drop("image")


def region_graph(spark, sf_dir):
    c = _regions(spark, sf_dir)
    return select.region_graph(grid.region_edges(c), grid.region_records(c), _steps(spark, 4)).drop("image")


def face_label_palette(spark, sf_dir):
    """Every region with its colour, its number's code and the ink on it."""
    lab = _label_lab(spark, sf_dir)
    rgb = color.rgb_of(F.col("cl"), F.col("ca"), F.col("cb"))
    rec = grid.region_records(_regions(spark, sf_dir)).join(F.broadcast(lab.select("label", color.ink_on(*rgb).alias("ink"), F.round("cl", 3).alias("light"))), "label")  # four rows
    return rec.select("region", "label", layout.code_of(F.col("label") + 1).alias("code"), "ink", "light")


def face_areas(spark, sf_dir):
    """Outer walk less holes, traced on the corner grid, of every region."""
    return boundary.faces(_regions(spark, sf_dir)).groupBy("region").agg(F.sum("area").alias("area"))


def arc_usage_gate(spark, sf_dir):
    """Arcs that border other than one or two sides, and all cracks that the arcs cover."""
    c = cut(_regions(spark, sf_dir))
    used = boundary.faces(c).select(F.explode("arcs").alias("arc")).groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    a = boundary.arcs(c).join(used, "arc", "left")
    return a.agg(F.sum((~F.coalesce("n", F.lit(0)).between(1, 2)).cast("bigint")).alias("bad"), F.sum(F.size("vs") - 1).alias("covered"))


def watertight_gate(spark, sf_dir):
    c = cut(_sheet_regions(spark, sf_dir))
    area = boundary.faces(c).groupBy("image").agg(F.sum("area").alias("area"))
    page = c.groupBy("image").agg(F.count(F.lit(1)).alias("page"))
    return page.join(area, "image").select("image", "page", (F.abs(F.col("area") - F.col("page")) / F.col("page") <= 2e-3).alias("holds"))


def topology_proof(spark, sf_dir):
    return boundary.topology_proof(_sheet_regions(spark, sf_dir))


def border_least_area(spark, sf_dir):
    """For every border of two regions the lesser compact area of its sides."""
    c = cut(_regions(spark, sf_dir))
    e = grid.region_edges(c)
    area = grid.region_records(c).join(grid.perimeters(c, e), ["image", "region"]).select("image", "region", F.round(layout.compact_area(F.col("area").cast("double"), F.col("perimeter")), 6).alias("area"))
    arc = (F.col("a").cast("bigint") * 100000 + F.col("b")).alias("arc")
    sides = e.select("image", arc, F.col("a").alias("region")).union(e.select("image", arc, "b"))
    return select.arc_least_area(sides, area).drop("image")


def mean_compactness(spark, sf_dir):
    c = _sheet_regions(spark, sf_dir)
    rec = grid.region_records(c).join(grid.perimeters(c, grid.region_edges(c)), ["image", "region"])
    return _r6(rec.groupBy("image").agg(F.count(F.lit(1)).alias("regions"), F.avg(layout.compactness(F.col("area"), F.col("perimeter"))).alias("compactness")), "compactness")


def edge_lengths(spark, sf_dir):
    """Mean edge of all rings, and rings a square cm of the page."""
    m = geometry.ring_measures(_rings(spark, sf_dir), ["id"]).crossJoin(_rings(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges")))  # one row
    _, _, w, h = layout.content_box(215.9, 279.4, 12.7)
    cm2 = w * h / (10 * layout.POINTS_A_MM) ** 2
    return _r6(m.agg((F.sum("perimeter") / F.max("edges")).alias("average"), (F.count(F.lit(1)) / F.lit(cm2)).alias("density")), "average", "density")


def label_fit_rate(spark, sf_dir):
    """Rings whose centre's label box lies inside, by its four corners."""
    r = _rings(spark, sf_dir)
    nxt = r.withColumn("ord", (F.col("ord") + 3) % 4).select("id", "ord", F.col("x").alias("x1"), F.col("y").alias("y1"))
    segments = r.join(nxt, ["id", "ord"]).select(F.col("id").alias("face"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    c = r.groupBy(F.col("id").alias("face")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    corner = F.explode(F.expr("array(struct(0 as id, -1.3 as dx, -1.1 as dy), struct(1 as id, 1.3 as dx, -1.1 as dy), struct(2 as id, -1.3 as dx, 1.1 as dy), struct(3 as id, 1.3 as dx, 1.1 as dy))"))
    points = c.withColumn("c", corner).select("face", F.col("c.id").alias("id"), (F.col("cx") + F.col("c.dx").cast("double")).alias("x"), (F.col("cy") + F.col("c.dy").cast("double")).alias("y"))
    inside = select.inside_rings(points, segments, ["face"]).groupBy("face").agg(F.min(F.col("inside").cast("int")).alias("fits"))
    return inside.agg(F.sum("fits").alias("fits"), F.round(100.0 * F.sum("fits") / F.count(F.lit(1)), 6).alias("rate"))


def rect_overlap_rate(spark, sf_dir):
    """Rectangles that overlap another one; touching is none."""
    b = _boxes(spark, sf_dir).select("image", "id", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), (F.col("x1") + 0.5).alias("x1"), (F.col("y1") + 0.5).alias("y1"))
    return _r6(select.overlap_rate(geometry.overlapping(b, 16, ["image"]), b.groupBy("image").agg(F.count(F.lit(1)).alias("n"))).drop("image"), "rate")


def segment_crossings(spark, sf_dir):
    """Pairs of diagonals that cross inside both; boxes that meet are the candidates. The smaller id's diagonal runs from (x0, y0), the other's from (x0, y1)."""
    ends = [F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")]
    b = _boxes(spark, sf_dir).select("image", "id", *[f(f"{c}0", f"{c}1").alias(f"{c}{k}") for k, f in enumerate((F.least, F.greatest)) for c in "xy"], *ends)
    point = lambda s, x, y: (F.col(f"{s}_ex{x}").cast("double"), F.col(f"{s}_ey{y}").cast("double"))
    cross = lambda s, t: geometry.proper_crossing(point(s, 0, 0), point(s, 1, 1), point(t, 0, 1), point(t, 1, 0))
    return geometry.box_overlaps(b, 16, ["image"], cross).select("a", "b")


# --- many images


def sheet_components(spark, sf_dir):
    return _sheet_regions(spark, sf_dir).select("image", "y", "x", "region")


def sheet_records(spark, sf_dir):
    return grid.region_records(_sheet_regions(spark, sf_dir))


def sheet_edges(spark, sf_dir):
    return grid.region_edges(_sheet_regions(spark, sf_dir))


def sheet_holes(spark, sf_dir):
    c = _sheet_regions(spark, sf_dir)
    return grid.fill_holes(c, grid.region_edges(c), 2)


def modal_fixpoint(spark, sf_dir):
    """Three passes of the majority filter with colour differences, or fewer where nothing changes."""
    delta = np.array([[5.0 * abs(a - b) for b in range(5)] for a in range(5)])
    return grid.modal_filter(_orders(spark, sf_dir), delta, 3).drop("image")


def convert_pages(spark, sf_dir):
    """The part grid's colours in sheets of 96 x 96 as PNG files, converted to pages."""
    ship(spark)
    p = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 96).alias("key"), F.col("p_size"), F.col("p_retailprice"))
    tone = p.groupBy("key").agg(F.sum("p_size").alias("s"), F.floor(F.sum("p_retailprice")).alias("c"))
    line = tone.groupBy().agg(F.array_sort(F.collect_list(F.struct("key", "s", "c"))).alias("l"))  # at most 96 rows
    sheets = spark.range(8).select(F.col("id").alias("sheet")).join(F.broadcast(line), F.lit(True))

    def draw(batches):
        for b in batches:
            out = []
            for k, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y, x = np.mgrid[0:96, 0:96]
                seeds = np.array([(m["s"] * (k + 3) % 96, m["c"] * (k + 5) % 96) for m in marks[: 12 + k]])
                colours = np.array([((m["s"] * 37) % 256, (m["c"] * 91) % 256, (m["key"] * 61) % 256) for m in marks[: 12 + k]])
                near = ((y[..., None] - seeds[:, 0]) ** 2 + (x[..., None] - seeds[:, 1]) ** 2).argmin(-1)
                out.append(images.write_png(colours[near].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([f"page{k}" for k in b.column(0).to_pylist()]), pa.array(out, pa.binary())], ["image", "content"])

    files = sheets.select("sheet", "l").repartition(8, "sheet").mapInArrow(draw, "image string, content binary")
    return convert(files, "easy", {"preprocess": {"smooth_passes": 1, "sigma_space": 1.5}})


def page_summary(spark, sf_dir):
    p = convert_pages(spark, sf_dir)
    return p.select("image", "error", "accepted", F.size("palette").alias("colours"), F.size("regions").alias("regions"), F.size("arcs").alias("arcs"), F.size("labels").alias("labels"), F.length("svg").alias("svg_length"), "regions_sha256")


def page_edges(spark, sf_dir):
    return rows(convert_pages(spark, sf_dir), "edges")


# --- analytics over runs


def _checks(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return runs.bands(o.select("o_orderstatus", F.col("o_totalprice").alias("value"), F.lit(1000.0).alias("lo"), F.lit(400000.0).alias("hi")))


def band_check(spark, sf_dir):
    return _checks(spark, sf_dir).groupBy("o_orderstatus", "passed").agg(F.count(F.lit(1)).alias("n"))


def report_acceptance(spark, sf_dir):
    return runs.accepted(_checks(spark, sf_dir), "o_orderstatus")


def triage_counts(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    return runs.triage(li.select(F.col("l_returnflag").alias("validator"), F.col("l_linestatus").alias("severity")))


def golden_compare(spark, sf_dir):
    """Orders by customer's segment and status against those by priority's place in the alphabet: same keys, counts and content or not."""
    o = _read(spark, sf_dir, "orders").withColumn("half", F.year("o_orderdate") % 2 == 0)
    side = lambda v: o.where(F.col("half") == v).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("content"))
    return runs.golden(side(True), side(False), ["o_custkey"], ["n"], "content")


def _snapshots(spark, sf_dir):
    """Seven measures a segment and month."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"), "o_custkey")
    r = lambda c: F.round(c, 6)
    return o.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("region_count"), r(F.avg("o_totalprice") / 1000).alias("boundary_smoothness"), r(F.avg(F.col("c_acctbal") + 1000) / 10000).alias("mean_compactness"),
        r(100 * F.avg((F.col("o_totalprice") > 200000).cast("double"))).alias("tiny_region_pct"), r(F.max("o_totalprice") / 1000).alias("label_density_per_cm2"),
        r(F.min("o_totalprice") / 1000).alias("average_edge_length_mm"), r(F.avg((F.col("o_orderstatus") == "F").cast("double"))).alias("printability_score"),
    )


def preset_snapshot(spark, sf_dir):
    return _snapshots(spark, sf_dir)


def preset_rules(spark, sf_dir):
    return runs.recommendations(_snapshots(spark, sf_dir), "c_mktsegment", "month")


def comparison_report(spark, sf_dir):
    return runs.comparison_report(runs.recommendations(_snapshots(spark, sf_dir), "c_mktsegment", "month"), "c_mktsegment")


def run_times(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return _r6(runs.run_times(e, ["event_type"], "value", "user_id"), "median_s")


def cost_ratio(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("traced", F.col("event_id") % 2 == 0)
    return _r6(runs.cost_ratio(e, "event_type", "traced", "value"), "ratio")


# --- fixtures


def fixture_catalogue(spark, sf_dir):
    return fixtures.catalogue(spark).groupBy("tier", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h") * F.col("w")).alias("cells"))


def fixture_labels(spark, sf_dir):
    return fixtures.label_maps(spark)


def fixture_manifest(spark, sf_dir):
    return fixtures.manifest(fixtures.label_maps(spark))


def fixture_regions(spark, sf_dir):
    """Regions of every fixture: all maps of one call are labelled together."""
    return grid.region_records(grid.components(fixtures.label_maps(spark))).groupBy("image").agg(F.count(F.lit(1)).alias("regions"), F.sum("area").alias("cells"), F.max("area").alias("largest"))


def vector_kmeans(spark, sf_dir):
    """Lloyd's iterations to the stop rule over all vectors, from the unit vectors, on the cluster; sizes and inertia of the classes."""
    e = _read(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return stats.lloyd(e, "v", [[1.0 if i == k else 0.0 for i in range(64)] for k in range(8)], rounds=12)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        fixed_coordinates, xml_escape, units, label_sizes, floors, stage_seeds, hex_colours, region_neighbours, background_region, majority_flag, region_inradius, white_paper,
        labeled_coverage, palette_renumber, bitmap_regions, masked_colours, region_graph, face_label_palette, face_areas, arc_usage_gate, watertight_gate, topology_proof, border_least_area,
        mean_compactness, edge_lengths, label_fit_rate, rect_overlap_rate, segment_crossings, sheet_components, sheet_records, sheet_edges, sheet_holes, modal_fixpoint, page_summary,
        page_edges, band_check, report_acceptance, triage_counts, golden_compare, preset_snapshot, preset_rules, comparison_report, run_times, cost_ratio, fixture_catalogue, fixture_labels,
        fixture_manifest, fixture_regions, vector_kmeans,
    )
}

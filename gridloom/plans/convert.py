"""From image files to numbered pages: every stage of one image in one Arrow call, as many images at once as there are tasks.

An image never leaves its task and nothing is shuffled, so a corpus of any size is as parallel as its files; an image that
fails gives a row with its error. convert() returns one row an image with nested artifacts; rows() unnests one of them.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.functions.layout import POINTS_A_MM
from gridloom.kernels import checks, cluster, colours, cracks, curves, filters, maps, page, place
from gridloom.plans import config
from gridloom.plans.shipping import ship

FLATTEN_MM, REFERENCE_MM, MOST_REPAIRS = 0.1, 2.5, 16

SCHEMA = (
    "image string, source_hash string, config_hash string, error string, accepted boolean, height int, width int, scale double,"
    " palette array<struct<idx:int,l:double,a:double,b:double,hex:string,coverage:bigint>>,"
    " regions array<struct<region:int,label:int,area:bigint,perimeter:bigint,border:bigint,r0:int,c0:int,r1:int,c1:int,cy:double,cx:double>>,"
    " edges array<struct<a:int,b:int,w:bigint,de:double>>, arcs array<struct<arc:int,left:int,right:int,closed:boolean,corners:int,cubics:array<double>>>,"
    " faces array<struct<region:int,label:int,holes:int,area_mm2:double,perimeter_mm:double>>,"
    " labels array<struct<region:int,number:int,x:double,y:double,size:double,leader:boolean,clearance:double>>,"
    " legend array<struct<idx:int,box_x:double,box_y:double,chip_x:double,chip_y:double>>,"
    " findings array<struct<validator:string,severity:string,message:string,location:string>>, metrics map<string,double>, seconds map<string,double>,"
    " svg string, pdf binary, solved_png binary, lines_png binary, palette_png binary, regions_sha256 string"
)


class Work(dict):
    """Artifacts of one image by name, and the seconds each stage took."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError as e:
            raise config.StageError(f"no artifact {name}") from e


def _px_a_mm(w: Work) -> float:
    return POINTS_A_MM / w.scale


def preprocess(w: Work, c: Mapping) -> None:
    s = c["preprocess"]
    img = filters.resize_area(w.pixels, s["max_working_px"])
    if s["impl"] == "bilateral":
        img = filters.bilateral(img.astype(np.float32), s["sigma_color"], s["sigma_space"], s["smooth_passes"]).astype(float)
    elif s["impl"] == "guided":
        img = filters.guided(img, passes=s["smooth_passes"])
    else:
        raise config.ConfigError(f"no smoother {s['impl']}")
    if s["clahe"]:
        img = filters.local_contrast(img, s["clahe_clip"])
    p = c["page"]
    box = [(p[k] - 2 * p["margin_mm"]) * POINTS_A_MM for k in ("width_mm", "height_mm")]
    if min(box) <= 0:
        raise config.ConfigError("the margins leave no page")
    h, v = img.shape[:2]
    w["working"], w["scale"] = img, min(box[0] / v, box[1] / h)
    w["origin"] = tuple(p["margin_mm"] * POINTS_A_MM + (b - w.scale * n) / 2 for b, n in zip(box, (v, h), strict=True))


def analyze(w: Work, c: Mapping) -> None:
    w["stats"] = filters.image_stats(w.working) if c["analyze"]["enabled"] else {}


def quantize(w: Work, c: Mapping) -> None:
    s = c["quantize"]
    w["labels_px"], w["lab"], _ = cluster.quantise(w.working, s["n_colors"], s["merge_delta_e"], s.get("sample_px", 100_000), s["max_iter"], s["impl"], w.seed)


def denoise(w: Work, c: Mapping) -> None:
    delta = colours.table(w.lab)
    labels = maps.majority(w.labels_px, delta, c["denoise"]["max_modal_iters"])
    floor = math.pi * (c["merge"]["d_min_mm"] / 2) ** 2 * _px_a_mm(w) ** 2
    w["labels_px"] = maps.open_small(labels, max(4, int(floor / c["denoise"]["speck_divisor"])), delta)


def fill_holes(w: Work, c: Mapping) -> None:
    if c["fill_holes"]["enabled"]:
        w["labels_px"] = maps.fill_holes(w.labels_px, int(c["fill_holes"]["max_hole_mm2"] * _px_a_mm(w) ** 2))


def ink(w: Work, c: Mapping) -> None:
    s, w["ink_lines"] = c["ink"], []
    if s["enabled"]:
        mask = filters.ink_lines(w.working, w.labels_px, w.lab[:, 0], _px_a_mm(w), s["max_width_mm"], s["contrast_l"], s["darkness_l"], s["survived_l"], s["min_length_mm"])
        w["ink_lines"] = [np.column_stack((w.origin[0] + (p[:, 1] + 0.5) * w.scale, w.origin[1] + (p[:, 0] + 0.5) * w.scale)) for p in filters.skeleton_lines(mask)]


def merge(w: Work, c: Mapping) -> None:
    s = c["merge"]
    floor = math.pi * (s["d_min_mm"] / 2) ** 2 * _px_a_mm(w) ** 2 if s["enabled"] else 0.0
    regions, own, new = maps.merge_tiny(w.labels_px, w.lab, colours.table(w.lab), floor, s["lambda_boundary"], s["protect_dark_l"], s["protect_dark_delta_l"])
    w["regions_px"], w["region_label"], w["lab"] = regions, own, w.lab[new >= 0]
    w["records"] = maps.records(regions, own[regions])
    w["edges"] = maps.borders(regions)[:3]


def mask(w: Work, c: Mapping) -> None:
    """Regions without a number: the paper (near-white, at the page's edge or a quarter of it), and the largest where that is asked for."""
    s, area = c["mask"], w.records["area"]
    paper = (w.lab[w.region_label, 0] >= s["white_l_threshold"]) & ((w.records["border"] > 0) | (area >= 0.25 * w.regions_px.size))
    skip = set(np.flatnonzero(paper).tolist())
    if s["enabled"]:
        order = np.lexsort((np.arange(len(area)), -area))
        skip |= set(order[: math.ceil(len(area) * s["top_area_percentile"])].tolist())
    w["skip"] = skip


def topology(w: Work, c: Mapping) -> None:
    w["arcs"] = cracks.arcs(w.regions_px)
    wrong = {k: v for k, v in cracks.proof(w.regions_px, w.arcs).items() if v}
    if wrong:
        raise config.StageError(f"topology: {wrong}")
    w["faces"] = cracks.faces(w.arcs, len(w.region_label))
    w["lines"] = [np.column_stack((w.origin[0] + a.points[:, 1] * w.scale, w.origin[1] + a.points[:, 0] * w.scale)) for a in w.arcs]


def _tolerances(w: Work, c: Mapping) -> np.ndarray:
    """A factor of at most 1 for each arc: less beside small or thin faces."""
    floor = math.pi * (max(c["merge"]["d_min_mm"], REFERENCE_MM) / 2 * POINTS_A_MM) ** 2
    area, rim = w.records["area"] * w.scale**2, w.records["perimeter"] * w.scale
    even = np.minimum(area, math.pi * (2 * area / np.maximum(rim, 1e-9)) ** 2)
    factor = np.minimum(1, np.sqrt(even / (9 * floor)))
    return np.array([min(factor[r] for r in (a.left, a.right) if r >= 0) for a in w.arcs])


def _crossed(lines: list[np.ndarray]) -> set[int]:
    """Arcs that cross themselves or each other."""
    owner = np.repeat(np.arange(len(lines)), [len(p) - 1 for p in lines])
    hit = curves.crossings(np.concatenate([p[:-1] for p in lines]), np.concatenate([p[1:] for p in lines]))
    return set(owner[hit].ravel().tolist())


def simplify(w: Work, c: Mapping) -> None:
    """Fewer vertices; arcs that would cross go back to what they were, which nothing can cross."""
    raw, base = w.lines, c["simplify"]["tolerance_mm"] * POINTS_A_MM
    w["factor"] = _tolerances(w, c)
    s, out = c["geometry_normalize"], []
    for a, xy, f in zip(w.arcs, raw, w.factor, strict=True):
        p = xy[:-1] if a.closed else xy
        p = p[curves.simplify(p, base * f, a.closed)]
        p = np.vstack((p, p[:1])) if a.closed else p
        if s["enabled"] and len(p) > 4:
            q = curves.drop_spikes(curves.drop_doubles(p, s["duplicate_eps_mm"] * POINTS_A_MM), s["spike_length_mm"] * POINTS_A_MM)
            p = q if len(q) >= (4 if a.closed else 2) else p
        out.append(p)
    locked: set[int] = set()
    for _ in range(MOST_REPAIRS):
        bad = _crossed(out) - locked
        if not bad:
            break
        for i in bad:
            out[i] = raw[i]
        locked |= bad
    w["lines"], w["restored"] = out, len(locked)


def fit(w: Work, c: Mapping) -> None:
    """Cubics; arcs whose curves would cross become straight pieces."""
    s, flat = c["bezier"], FLATTEN_MM * POINTS_A_MM
    out = [curves.fit(p, s["fit_error_mm"] * POINTS_A_MM * f, s["impl"], s["corner_angle_deg"]) for p, f in zip(w.lines, w.factor, strict=True)]
    straight: set[int] = set()
    for _ in range(MOST_REPAIRS):
        bad = _crossed([curves.flatten(k, flat) for k in out]) - straight
        if not bad:
            break
        for i in bad:
            out[i] = np.array([curves.line(a, b) for a, b in zip(w.lines[i][:-1], w.lines[i][1:], strict=True)])
        straight |= bad
    w["cubics"], w["straight"] = out, len(straight)
    w["flat"] = [curves.flatten(k, flat) for k in out]
    w["rings"] = [[cracks.ring(k, w.flat) for k in (f.outer, *f.holes)] for f in w.faces]


def labels(w: Work, c: Mapping) -> None:
    s = c["labels"]
    w["shapes"] = [place.Rings(r) for r in w.rings]
    dark = set(np.flatnonzero(w.lab[w.region_label, 0] < place.KEEP_DARK).tolist())
    keep = dark | set(np.flatnonzero(place.salient(w.records["area"], w.records["perimeter"], w.regions_px.size)).tolist())
    w["labels"], w["blank"], w["conflicts"] = place.place(
        w.shapes, (w.region_label + 1).tolist(), s["leader_ring_mm"] * POINTS_A_MM, s["font_min_pt"], s["font_max_pt"], s["polylabel_precision_pt"], w.skip, None, keep
    )


def legend(w: Work, c: Mapping) -> None:
    s, p = {k: v * POINTS_A_MM if k.endswith("_mm") else v for k, v in c["legend"].items()}, c["page"]
    m, width = p["margin_mm"] * POINTS_A_MM, (p["width_mm"] - 2 * p["margin_mm"]) * POINTS_A_MM
    w["legend"] = place.legend(len(w.lab), m, m, width, s["chip_mm"], s["gap_mm"], s["name_box_mm"], s["pair_gap_mm"])


def validate(w: Work, c: Mapping) -> None:
    w["findings"], w["metrics"] = checks.gates(w, c)


def render(w: Work, c: Mapping) -> None:
    p, s = c["page"], c["legend"]
    mm = (p["width_mm"], p["height_mm"], p["margin_mm"])
    rgb = colours.rgb_of(w.lab)
    number = {b.region: b.number for b in w.labels}
    sides = [tuple(number.get(r, 0) for r in (a.left, a.right)) for a in w.arcs]
    closed = [bool((k[0][0] == k[-1][3]).all()) for k in w.cubics]
    walks = [[f.outer, *f.holes] for f in w.faces]
    sizes = {"chip": s["chip_mm"] * POINTS_A_MM, "box": s["name_box_mm"] * POINTS_A_MM, "font": s["number_font_pt"]}
    w["svg"] = page.svg(mm, w.cubics, sides, closed, walks, w.labels, w.legend, rgb, (), w.ink_lines, w.get("title"), **sizes)
    w["pdf"] = page.pdf(mm, w.cubics, closed, w.labels, w.legend, rgb, **sizes)
    fill = [rgb[k] for k in w.region_label]
    w["solved_png"] = page.solved_png(mm, w.rings, fill, c["png"]["dpi"], w.skip)
    w["lines_png"] = page.solved_png(mm, w.rings, fill, c["png"]["dpi"], lines=True)
    w["palette_png"] = page.palette_png(rgb)
    checks.outputs(w, c)


STAGES: tuple[Callable[[Work, Mapping], None], ...] = (
    preprocess, analyze, quantize, denoise, fill_holes, ink, merge, mask, topology, simplify, fit, labels, legend, validate, render,
)


def convert_pixels(pixels: np.ndarray, settings: Mapping, seed: int = 0, title: str | None = None, until: str | None = None) -> Work:
    """All artifacts of one image (h, w, 3) in [0, 1]; until: the last stage to run."""
    w = Work(pixels=pixels, seed=seed, seconds={}, title=title)
    for stage in STAGES:
        began = time.perf_counter()
        stage(w, settings)
        w.seconds[stage.__name__] = time.perf_counter() - began
        if stage.__name__ == until:
            break
    return w


def settings_of(preset: str = "medium", overrides: Mapping | None = None) -> Mapping:
    """Defaults, the preset, then the caller's settings: checked and frozen."""
    return config.check(config.resolve(config.DEFAULTS, config.preset(preset), overrides or {}))


def _row(image: str, data: bytes, w: Work) -> dict[str, Any]:
    rec, f8, i8 = w.records, float, int
    mm = POINTS_A_MM
    cover = np.bincount(w.region_label, rec["area"], len(w.lab)).astype(np.int64)
    rgb = colours.rgb_of(w.lab)
    a, b, n = w.edges
    delta = colours.table(w.lab)
    return {
        "image": image, "source_hash": hashlib.sha256(data).hexdigest(), "error": None, "accepted": not any(x["severity"] == "fatal" for x in w.findings),
        "height": w.working.shape[0], "width": w.working.shape[1], "scale": w.scale,
        "palette": [{"idx": i, "l": f8(v[0]), "a": f8(v[1]), "b": f8(v[2]), "hex": page.hex_colour(rgb[i]), "coverage": i8(cover[i])} for i, v in enumerate(w.lab)],
        "regions": [{"region": i, "label": i8(k)} | {c: rec[c][i].item() for c in ("area", "perimeter", "border", "r0", "c0", "r1", "c1", "cy", "cx")} for i, k in enumerate(w.region_label)],
        "edges": [{"a": i8(x), "b": i8(y), "w": i8(z), "de": f8(delta[w.region_label[x], w.region_label[y]])} for x, y, z in zip(a, b, n, strict=True)],
        "arcs": [{"arc": i, "left": x.left, "right": x.right, "closed": x.closed, "corners": len(x.points), "cubics": w.cubics[i].ravel().tolist()} for i, x in enumerate(w.arcs)],
        "faces": [{"region": f.region, "label": i8(w.region_label[f.region]), "holes": len(f.holes), "area_mm2": checks.face_area(r) / mm**2, "perimeter_mm": checks.face_rim(r) / mm} for f, r in zip(w.faces, w.rings, strict=True)],
        "labels": [{"region": x.region, "number": i8(x.number), "x": x.x, "y": x.y, "size": x.size, "leader": x.leader, "clearance": x.clearance} for x in w.labels],
        "legend": [dict(zip(("idx", "box_x", "box_y", "chip_x", "chip_y"), (i, *p), strict=True)) for i, p in enumerate(w.legend)],
        "findings": w.findings, "metrics": list(w.metrics.items()), "seconds": list(w.seconds.items()),
        "svg": w.svg.decode(), "pdf": w.pdf, "solved_png": w.solved_png, "lines_png": w.lines_png, "palette_png": w.palette_png,
        "regions_sha256": hashlib.sha256(w.regions_px.astype("<i4").tobytes()).hexdigest(),
    }


def convert(images: DataFrame, preset: str = "medium", overrides: Mapping | None = None, seed: int = 0) -> DataFrame:
    """One row (SCHEMA) for each row of images (image, content). Settings are checked before any job runs.

    A file that can't be read or a stage that fails gives error and nulls; a page that fails its checks gives accepted = false.
    Images above load.max_pixels are refused from their header, so a task's memory is bounded.
    """
    from gridloom.sources.images import decode

    ship(images.sparkSession)
    settings = settings_of(preset, overrides)
    mark = config.config_hash(settings)
    plain = config.plain(settings)  # executors get ordinary dicts
    out = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = dict.fromkeys(out.names) | {"image": image, "config_hash": mark}
                try:
                    pixels = decode(data or b"", plain["load"]["max_pixels"], plain["load"]["least_side"])
                    row |= _row(image, data, convert_pixels(pixels, plain, seed))
                except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                    row |= {"error": f"{type(e).__name__}: {e}", "accepted": False}
                yield pa.RecordBatch.from_pylist([row], schema=out)

    return images.select("image", "content").mapInArrow(run, SCHEMA)


def rows(pages: DataFrame, artifact: str) -> DataFrame:
    """(image, fields of one nested artifact): palette, regions, edges, arcs, faces, labels, legend, findings, metrics or seconds."""
    if artifact in ("metrics", "seconds"):
        return pages.select("image", F.explode(artifact).alias("name", "value"))
    return pages.select("image", F.explode(artifact).alias("r")).select("image", "r.*")

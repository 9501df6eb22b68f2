"""Dense grids as rows (image, y, x, label): neighbours, components, regions and their graph.

Every relation is keyed by image, so many grids are processed at once. What looks at neighbours runs on tiles (tiles.py);
sums leave a tile already added up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.kernels import maps
from gridloom.kernels.maps import OUT, shifted
from gridloom.operators.tiles import TILE, Patch, over_tiles
from gridloom.plans.scratch import cut


def lift(df: DataFrame, key: str, width: int, label: Column, image: Column | str = "grid", **more: Column) -> DataFrame:
    """A table whose key counts from 0 as a grid of this width."""
    k = F.col(key)
    name = F.lit(image) if isinstance(image, str) else image
    return df.select(
        name.alias("image"), F.floor(k / width).cast("int").alias("y"), (k % width).cast("int").alias("x"),
        label.cast("int").alias("label"), *[c.alias(n) for n, c in more.items()],
    )


def lift_sheets(df: DataFrame, key: str, side: int, label: Column, **more: Column) -> DataFrame:
    """The same as many images of side x side cells: sheet k holds the keys from k * side * side on."""
    k, cells = F.col(key), side * side
    return df.select(
        F.concat(F.lit("s"), F.floor(k / cells).cast("string")).alias("image"), F.floor(k % cells / side).cast("int").alias("y"), (k % side).cast("int").alias("x"),
        label.cast("int").alias("label"), *[c.alias(n) for n, c in more.items()],
    )


def cracks(cells: DataFrame, value: str = "label") -> DataFrame:
    """(image, y, x, dir): cells whose right (r) or lower (d) side parts different values, or lies on the page's edge.

    The page's left and upper sides belong to the cells before the first ones: x = -1 and y = -1.
    """

    def run(p: Patch) -> dict[str, np.ndarray]:
        v, parts = np.where(p.there, p.values[value], OUT - 1), []
        for code, dy, dx in ((0, 0, 1), (1, 1, 0)):
            there = shifted(p.there, dy, dx, False)
            got = p.rows({}, p.there & ~(there & (shifted(v, dy, dx, OUT - 1) == v)))
            parts.append((got["y"], got["x"], np.full(len(got["y"]), code)))
            got = p.rows({}, p.there & ~shifted(p.there, -dy, -dx, False))
            parts.append((got["y"] - dy, got["x"] - dx, np.full(len(got["y"]), code)))
        y, x, code = (np.concatenate(c) for c in zip(*parts, strict=True))
        return {"y": y, "x": x, "d": code}

    return over_tiles(cells, [value], run, "y int, x int, d int", reach=1).select("image", "y", "x", F.when(F.col("d") == 0, "r").otherwise("d").alias("dir"))


def _pieces(cells: DataFrame, tile: int) -> DataFrame:
    """(image, y, x, label, fy, fx, k): the first cell of each cell's component inside its tile, and the component's number there."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        labels = np.where(p.there, p.values["label"], OUT)
        regions = maps.components(labels)
        got = p.rows({"label": labels, "k": regions}, regions != OUT)
        _, first = np.unique(got["k"], return_index=True)
        return got | {"fy": got["y"][first][got["k"]], "fx": got["x"][first][got["k"]]}

    return over_tiles(cells, ["label"], run, "y int, x int, label int, fy int, fx int, k int", tile=tile)


def _join_pieces(links: DataFrame, most_rounds: int) -> DataFrame:
    """(image, p, c): the least node reachable from each node of links (image, p, q); minimum labels with pointer jumping."""
    both = cut(links.union(links.select("image", F.col("q").alias("p"), F.col("p").alias("q"))).distinct())
    state = cut(both.groupBy("image", "p").agg(F.min("q").alias("m")).select("image", "p", F.least("p", "m").alias("c")))
    for _ in range(most_rounds):
        near = both.join(state.withColumnRenamed("p", "q"), ["image", "q"]).groupBy("image", "p").agg(F.min("c").alias("n"))
        low = state.join(near, ["image", "p"]).select("image", "p", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        hook = low.groupBy("image", "was").agg(F.min("c").alias("h"))
        low = cut(low.join(hook, ["image", "was"]).select("image", "p", "was", F.least("c", "h").alias("c")))
        up = low.select("image", F.col("p").alias("c"), F.col("c").alias("top"))
        nxt = cut(low.join(up, ["image", "c"]).select("image", "p", "was", F.least("c", "top").alias("c")))
        state = nxt.select("image", "p", "c")
        if not nxt.where("c <> was").limit(1).count():
            return state
    raise RuntimeError("components did not settle")


def components(cells: DataFrame, tile: int = TILE, most_rounds: int = 64) -> DataFrame:
    """(image, y, x, label, region): 4-connected components of equal label, numbered from 0 by their first cell in raster order.

    Tiles are labelled on their own. Only where an image has more than one do the labels along tile sides become links,
    whose components an iterative join finds; its rounds grow as the logarithm of the tiles that a component crosses.

    Defined results: repeated cells count once, with their least label; cells without a label are left out.
    """
    pieces = _pieces(cells, tile)
    size = cells.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    if max(size.y or 0, size.x or 0) < tile:
        return pieces.select("image", "y", "x", "label", F.col("k").alias("region"))
    pieces = cut(pieces)
    at = F.struct("fy", "fx")
    links = None
    for c, other in (("y", "x"), ("x", "y")):
        last = pieces.where(F.col(c) % tile == tile - 1).select("image", (F.col(c) + 1).alias(c), other, "label", at.alias("p"))
        first = pieces.where(F.col(c) % tile == 0).select("image", c, other, "label", at.alias("q"))
        pair = last.join(first, ["image", "y", "x", "label"]).select("image", "p", "q")
        links = pair if links is None else links.union(pair)
    joined = _join_pieces(links.distinct(), most_rounds)
    every = pieces.select("image", at.alias("p")).distinct().join(joined, ["image", "p"], "left").select("image", "p", F.coalesce("c", "p").alias("c"))
    every = cut(every)
    # raster order in two steps, so that no task numbers all regions of an image
    first = every.select("image", "c.fy", "c.fx").distinct()
    row = first.withColumn("k", F.row_number().over(W.partitionBy("image", "fy").orderBy("fx")))
    before = first.groupBy("image", "fy").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("image").orderBy("fy")) - F.col("n")).drop("n")
    name = row.join(before, ["image", "fy"]).select("image", F.struct("fy", "fx").alias("c"), (F.col("before") + F.col("k") - 1).cast("int").alias("region"))
    found = every.join(name, ["image", "c"]).select("image", F.col("p.fy").alias("fy"), F.col("p.fx").alias("fx"), "region")
    return pieces.join(found, ["image", "fy", "fx"]).select("image", "y", "x", "label", "region")


def region_records(cells: DataFrame) -> DataFrame:
    """Area, box, first cell, centroid and label of each region."""
    return cells.groupBy("image", "region").agg(
        F.min_by("label", F.struct("y", "x")).alias("label"), F.count(F.lit(1)).alias("area"),
        F.min("y").alias("r0"), F.min("x").alias("c0"), F.max("y").alias("r1"), F.max("x").alias("c1"),
        F.min(F.struct("y", "x")).alias("seed"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    ).select("image", "region", "label", "area", "r0", "c0", "r1", "c1", F.col("seed.y").alias("seed_y"), F.col("seed.x").alias("seed_x"), F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


def region_edges(cells: DataFrame) -> DataFrame:
    """(image, a, b, w): adjacent regions a < b and the length of their border."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        r = np.where(p.there, p.values["region"], OUT)
        pairs = []
        for dy, dx in ((0, 1), (1, 0)):
            one, two = r[p.own], shifted(r, dy, dx, OUT)[p.own]
            use = (one != two) & (one != OUT) & (two != OUT)
            pairs.append(np.stack((np.minimum(one, two)[use], np.maximum(one, two)[use])))
        both, n = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True)
        return {"a": both[0], "b": both[1], "w": n}

    return over_tiles(cells, ["region"], run, "a int, b int, w long", reach=1).groupBy("image", "a", "b").agg(F.sum("w").alias("w"))


def page_border(cells: DataFrame) -> DataFrame:
    """(image, region, border): cell sides without a cell beyond."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        sides = sum((~shifted(p.there, dy, dx, False)).astype(np.int64) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        got = p.rows({"region": p.values["region"], "n": sides})
        which, at = np.unique(got["region"], return_inverse=True)
        return {"region": which, "n": np.bincount(at, got["n"], len(which)).astype(np.int64)}

    return over_tiles(cells, ["region"], run, "region int, n long", reach=1).groupBy("image", "region").agg(F.sum("n").alias("border"))


def perimeters(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(image, region, border, perimeter)."""
    both = edges.select("image", F.col("a").alias("region"), "w").union(edges.select("image", "b", "w")).groupBy("image", "region").agg(F.sum("w").alias("w"))
    return page_border(cells).join(both, ["image", "region"], "left").select("image", "region", "border", (F.col("border") + F.coalesce("w", F.lit(0))).alias("perimeter"))


def modal_filter(cells: DataFrame, delta: np.ndarray | None = None, rounds: int = 1) -> DataFrame:
    """(image, y, x, label) after up to `rounds` passes of the 3x3 majority; ties go to the label nearest in colour, then to the lowest.

    delta is the palette's table of differences (at most 64 x 64). A tile carries a ring of `rounds` cells, so all passes
    need one shuffle; more passes than the map needs change nothing.
    """

    def run(p: Patch) -> dict[str, np.ndarray]:
        return p.rows({"label": maps.majority(np.where(p.there, p.values["label"], OUT), delta, rounds)})

    return over_tiles(cells, ["label"], run, "y int, x int, label int", reach=rounds)


def fill_holes(cells: DataFrame, edges: DataFrame, most_area: float) -> DataFrame:
    """cells (with region) whose regions off the page's edge, with one neighbour and at most this area, take its label."""
    sym = edges.select("image", F.col("a").alias("region"), F.col("b").alias("near")).union(edges.select("image", "b", "a"))
    alone = sym.groupBy("image", "region").agg(F.count(F.lit(1)).alias("k"), F.min("near").alias("near")).where("k = 1")
    rec = region_records(cells).select("image", "region", "label", "area")
    small = alone.join(rec, ["image", "region"]).join(page_border(cells), ["image", "region"]).where((F.col("border") == 0) & (F.col("area") <= most_area)).select("image", "region", "near")
    into = rec.select("image", F.col("region").alias("near"), F.col("label").alias("new"))
    return cells.join(small.join(into, ["image", "near"]).select("image", "region", "new"), ["image", "region"], "left").select("image", "y", "x", F.coalesce("new", "label").alias("label"))


def _choices(records: DataFrame, edges: DataFrame, threshold: float, delta: DataFrame | None) -> DataFrame:
    rec = records.select("image", "region", "label", "area")
    sym = edges.select("image", F.col("a").alias("region"), F.col("b").alias("near"), "w").union(edges.select("image", "b", "a", "w"))
    speck = rec.where(F.col("area") < threshold).select("image", "region", "label")
    other = rec.select("image", F.col("region").alias("near"), F.col("label").alias("near_label"), (F.col("area") < threshold).alias("near_speck"))
    met = speck.join(sym, ["image", "region"]).join(other, ["image", "near"])
    if delta is None:
        met = met.withColumn("de", (F.col("label") != F.col("near_label")).cast("double"))
    else:  # a palette's table, at most 64 x 64 rows
        met = met.join(F.broadcast(delta.select(F.col("label"), F.col("cand").alias("near_label"), "de")), ["label", "near_label"])
    return met.groupBy("image", "region").agg(F.min_by("near", F.struct("near_speck", -F.col("w"), "de", "near_label", "near")).alias("into"))


def open_areas(cells: DataFrame, records: DataFrame, edges: DataFrame, threshold: float, delta: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """(image, y, x, label): regions below threshold take a neighbour's label: of one that isn't such a speck first, then by the longest
    border, the least colour difference, the lowest label and id.

    Chains of specks end where the last one does, found by doubling jumps; specks that lead into a cycle keep their labels.
    """
    choice = cut(_choices(records, edges, threshold, delta))
    state = choice.select("image", "region", F.col("into").alias("end"))
    for _ in range(most_rounds):
        hop = state.select("image", F.col("region").alias("end"), F.col("end").alias("next"))
        new = cut(state.join(hop, ["image", "end"], "left").select("image", "region", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        state = new.select("image", "region", "end")
        if not moved:
            break
        # those that only circle stop as soon as jumps have gone round more often than there are specks
        if 2 ** (_ + 1) > 2 * choice.count():
            break
    into = state.join(choice.select("image", F.col("region").alias("end"), F.lit(True).alias("speck")), ["image", "end"], "left").where("speck is null")
    new = into.select("image", "region", "end").join(records.select("image", F.col("region").alias("end"), F.col("label").alias("new")), ["image", "end"])
    return cells.join(new.select("image", "region", "new"), ["image", "region"], "left").select("image", "y", "x", F.coalesce("new", "label").alias("label"))


def corners(cells: DataFrame) -> DataFrame:
    """(image, v, u): grid corners where three regions or more meet (outside the page is one), and the page's corners."""

    def run(p: Patch) -> dict[str, np.ndarray]:
        pad = lambda a, fill: np.pad(a, 1, constant_values=fill)
        r, there = pad(np.where(p.there, p.values["region"], OUT), OUT), pad(p.there, False)
        mine = np.zeros(p.there.shape, bool)
        mine[p.own] = p.there[p.own]
        mine = pad(mine, False)
        quad = [r[1:, 1:], r[1:, :-1], r[:-1, 1:], r[:-1, :-1]]  # south-east first: a corner belongs to the first cell that exists
        kinds = sum(np.logical_and.reduce([quad[i] != quad[j] for j in range(i)]) if i else np.ones(quad[0].shape, bool) for i in range(4)).astype(int)
        n = sum(t.astype(int) for t in (there[1:, 1:], there[1:, :-1], there[:-1, 1:], there[:-1, :-1]))
        before, owner = np.zeros(n.shape, bool), np.zeros(n.shape, bool)
        for m, t in zip((mine[1:, 1:], mine[1:, :-1], mine[:-1, 1:], mine[:-1, :-1]), (there[1:, 1:], there[1:, :-1], there[:-1, 1:], there[:-1, :-1]), strict=True):
            owner |= m & ~before
            before |= t
        v, u = np.nonzero(owner & ((kinds >= 3) | (n == 1)))
        return {"v": v + p.y0, "u": u + p.x0}

    return over_tiles(cells, ["region"], run, "v int, u int", reach=1)

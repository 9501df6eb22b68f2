"""Neighbourhood operators over dense grids (image, y, x, ...): the cells of a tile and a ring around it meet in one task.

A grid of any size is cut into TILE x TILE tiles; a cell near a tile's side also goes to the next tile, so one shuffle
serves an operator of any reach, and a task never holds more than one tile and its ring. Many small images are many tiles.

Defined results: rows without image, y or x are left out; repeated cells count once (the least values); a null value is -1
in whole numbers and NaN in others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.plans.shipping import ship

TILE = 512


@dataclass
class Patch:
    """A tile with its ring: arrays by name, there (a cell exists), the tile's own part, and the place of [0, 0]."""

    values: dict[str, np.ndarray]
    there: np.ndarray
    own: tuple[slice, slice]
    y0: int
    x0: int

    def rows(self, arrays: dict[str, np.ndarray], where: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """y, x and the arrays' values at the tile's own cells (that exist, or where given)."""
        keep = (self.there if where is None else where)[self.own]
        y, x = np.nonzero(keep)
        out = {"y": y + self.own[0].start + self.y0, "x": x + self.own[1].start + self.x0}
        return out | {k: v[self.own][keep] for k, v in arrays.items()}


def patch(table: pa.Table, ty: int, tx: int, names: list[str], reach: int, tile: int) -> Patch:
    y, x = (table.column(c).to_numpy() for c in ("y", "x"))
    y0, x0 = max(0, ty * tile - reach), max(0, tx * tile - reach)
    shape = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
    at = (y.astype(np.int64) - y0) * shape[1] + (x - x0)
    columns = []
    for n in names:
        c = table.column(n).combine_chunks()
        whole = pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)
        columns.append((c.cast(pa.int64()).fill_null(-1) if whole else c.cast(pa.float64()).fill_null(np.nan)).to_numpy(zero_copy_only=False))
    if len(at) > 1 and len(np.unique(at)) < len(at):
        order = np.lexsort((*reversed(columns), at))[::-1]  # the least values are written last
        at, columns = at[order], [c[order] for c in columns]
    there = np.zeros(shape[0] * shape[1], bool)
    there[at] = True
    values = {}
    for n, c in zip(names, columns, strict=True):
        grid = np.full(there.shape, -1 if c.dtype.kind == "i" else np.nan, c.dtype)
        grid[at] = c
        values[n] = grid.reshape(shape)
    r, c = ty * tile - y0, tx * tile - x0
    return Patch(values, there.reshape(shape), (slice(r, r + tile), slice(c, c + tile)), y0, x0)


def over_tiles(cells: DataFrame, names: list[str], run: Callable[[Patch], dict[str, np.ndarray]], schema: str, reach: int = 0, tile: int = TILE) -> DataFrame:
    """(image, schema's columns) from run(patch) of every tile; run gives a tile's own rows as arrays."""
    ship(cells.sparkSession)
    out = to_arrow_schema(StructType.fromDDL("image string, " + schema))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))).alias(f"_t{c}")
    rows = cells.where("image is not null and y is not null and x is not null").select("image", "y", "x", *names)
    if reach:
        rows = rows.select("*", near("y")).select("*", near("x")).where("_ty >= 0 and _tx >= 0")
    else:
        rows = rows.select("*", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))

    def one(key, table):  # without annotations, which Spark would read as its own kind of type hint
        image, ty, tx = (k.as_py() for k in key)
        p = patch(table, ty, tx, names, reach, tile)
        if not p.there[p.own].any():  # a ring without a tile: beyond the page
            return out.empty_table()
        got = run(p)
        n = len(next(iter(got.values())))
        return pa.table([pa.array([image] * n, pa.string()), *[pa.array(got[f.name], from_pandas=True).cast(f.type) for f in out if f.name != "image"]], schema=out)

    return rows.groupBy("image", "_ty", "_tx").applyInArrow(one, "image string, " + schema)

"""Merging tiny regions: a greedy contraction whose order matters, one task for each image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.kernels.maps import contract
from gridloom.plans.shipping import ship


def merge_tiny(records: DataFrame, edges: DataFrame, perimeter: DataFrame, lab: np.ndarray, delta: np.ndarray, floor: float, weight: float = 15.0, dark: float = 0.0, lighter: float = 0.0) -> DataFrame:
    """(image, region, into) for every region; the region graph of an image, not its cells, goes to one task.

    lab and delta: the palette and its differences, by label (at most 64). A region darker than `dark` whose neighbours are all
    lighter by `lighter` or more stays as it is.
    """
    ship(records.sparkSession)
    number = lambda c: F.col(c).cast("bigint").alias(c)
    rows = records.join(perimeter, ["image", "region"]).select("image", number("region"), number("label"), number("area"), number("perimeter"), F.lit(None).cast("bigint").alias("b"))
    links = edges.select("image", F.col("a").cast("bigint").alias("region"), F.lit(None).cast("bigint").alias("label"), F.col("w").cast("bigint").alias("area"), F.lit(None).cast("bigint").alias("perimeter"), number("b"))

    def run(key, table):
        own = table.filter(pa.compute.is_null(table.column("b")))
        link = table.filter(pa.compute.is_valid(table.column("b")))
        name, label, area, rim = (own.column(c).to_numpy() for c in ("region", "label", "area", "perimeter"))
        order = np.argsort(name)
        place = {int(v): i for i, v in enumerate(name[order])}
        at = lambda c: np.array([place[v] for v in link.column(c).to_pylist()], np.int64)
        spared = (lambda k, near: lab[k, 0] < dark and all(lab[m, 0] - lab[k, 0] >= lighter for m in near)) if dark > 0 else None
        end = contract(label[order], area[order], rim[order], (at("region"), at("b"), link.column("area").to_numpy()), lambda k, m, border, mine: delta[k, m] - weight * border / mine, floor, spared)
        return pa.table({"image": pa.array([key[0].as_py()] * len(end), pa.string()), "region": pa.array(name[order].astype(np.int32)), "into": pa.array(name[order][end].astype(np.int32))})

    return rows.unionByName(links).groupBy("image").applyInArrow(run, "image string, region int, into int")

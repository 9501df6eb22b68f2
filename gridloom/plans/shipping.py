"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Arrow batches of whole texts: a worker holds a few of them, so they are kept small where the session has the defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each Spark context; clusters then need no installation of it."""
    sc = spark.sparkContext
    for k, (default, small) in BATCHES.items():
        if spark.conf.get(k, default) == default:
            spark.conf.set(k, small)
    if getattr(sc, "_gridloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(name)
    sc._gridloom_shipped = True

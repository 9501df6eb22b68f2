"""A stream of converted pages: files that arrive in a folder become rows, each image on its own, so no state is kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.convert import convert
from gridloom.sources import images


def pages(spark: SparkSession, path: str, preset: str = "medium", overrides: Mapping | None = None, seed: int = 0) -> DataFrame:
    """convert() over images.stream(); write it with a checkpoint location, and a lost executor costs one image's work."""
    return convert(images.stream(spark, path), preset, overrides, seed)

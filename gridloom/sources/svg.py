"""Vector pages: one SVG text for each image, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import layout


def pages(arcs: DataFrame, width: float, height: float, scale: float = 1.0) -> DataFrame:
    """(image, svg) of arcs (image, arc, vs, us): each arc once, in id order, as a path in one group."""
    points = F.transform(F.arrays_zip("us", "vs"), lambda p: F.concat(layout.fixed((p["us"] * F.lit(float(scale))).cast("double")), F.lit(" "), layout.fixed((p["vs"] * F.lit(float(scale))).cast("double"))))
    path = F.concat(F.lit('<path id="arc-'), F.col("arc").cast("string"), F.lit('" d="M '), F.array_join(points, " L "), F.lit('"/>'))
    lines = arcs.select("image", "arc", path.alias("p")).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("arc", "p"))).alias("l"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" viewBox="0 0 {width:g} {height:g}">\n<g id="arcs" fill="none" stroke="black">\n'
    return lines.select("image", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["p"]), "\n"), F.lit("\n</g>\n</svg>\n")).alias("svg"))


def fingerprint(pages: DataFrame) -> DataFrame:
    """(image, arcs, segments): structure read back from the text."""
    return pages.select("image", F.size(F.regexp_extract_all("svg", F.lit('id="arc-([0-9]+)"'), 1)).alias("arcs"), F.regexp_count("svg", F.lit(" L ")).alias("segments"))

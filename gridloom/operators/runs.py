"""Analytics over runs of the engine: bands, reports, golden comparisons, snapshots by preset and the rules that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The seven rules: name, severity, measure, and when it speaks.
RULES = (
    ("region_count", "info", "region_count", "ratio >= 1.3"), ("smoothness", "caution", "boundary_smoothness", "ratio >= 1.5"), ("compactness", "caution", "mean_compactness", "ratio <= 0.85"),
    ("tiny_regions", "caution", "tiny_region_pct", "gain >= 5.0"), ("label_density", "info", "label_density_per_cm2", "ratio >= 1.5"), ("edge_length", "info", "average_edge_length_mm", "ratio <= 0.5"),
    ("printability", "caution", "printability_score", "gain < 0 and now <= 0.6"),
)


def in_band(value: Column, low: Column, high: Column) -> Column:
    """Whether low <= value <= high, judged before the value is rounded for storing."""
    return value.between(low, high)


def bands(rows: DataFrame) -> DataFrame:
    """rows (..., value, lo, hi) with passed, the value rounded to 6 places."""
    return rows.withColumn("passed", in_band(F.col("value"), F.col("lo"), F.col("hi"))).withColumn("value", F.round("value", 6))


def accepted(checks: DataFrame, key: str) -> DataFrame:
    """(key, checks, failures, accepted) from rows (key, passed)."""
    bad = F.sum((~F.col("passed")).cast("int"))
    return checks.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), bad.alias("failures"), (bad == 0).alias("accepted"))


def triage(findings: DataFrame) -> DataFrame:
    """(validator, severity, n)."""
    return findings.groupBy("validator", "severity").agg(F.count(F.lit(1)).alias("n"))


def golden(now: DataFrame, stored: DataFrame, keys: list[str], exact: list[str], content: str) -> DataFrame:
    """(keys, verdict): identical content; changed but with the same exact counts; incompatible otherwise or where one side lacks the key."""
    a, b = now.select(*keys, F.struct(*exact).alias("e1"), F.col(content).alias("c1"), F.lit(True).alias("here")), stored.select(*keys, F.struct(*exact).alias("e2"), F.col(content).alias("c2"), F.lit(True).alias("there"))
    verdict = F.when(F.col("here").isNull() | F.col("there").isNull(), "incompatible").when(F.col("c1").eqNullSafe(F.col("c2")), "identical").when(F.col("e1") == F.col("e2"), "changed_compatible").otherwise("incompatible")
    return a.join(b, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def recommendations(snapshots: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, rule, severity, was, now): what the rules say of each snapshot against the one before it.

    snapshots: (by, order and the measures of RULES), wide. Measures become rows by one unpivot, so the rules share a window.
    """
    names = [m for _, _, m, _ in RULES]
    tall = snapshots.select(by, order, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).cast("double").alias("now")) for i, m in enumerate(names)])).alias("m")).select(by, order, "m.i", "m.now")
    tall = tall.withColumn("was", F.lag("now").over(W.partitionBy(by, "i").orderBy(order))).where("was is not null")
    tall = tall.withColumn("ratio", F.when(F.col("was") > 0, F.col("now") / F.col("was"))).withColumn("gain", F.col("now") - F.col("was"))
    when = F.lit(False)
    for i, (_, _, _, rule) in enumerate(RULES):
        when = when | ((F.col("i") == i) & F.coalesce(F.expr(rule), F.lit(False)))
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RULES]), F.col("i") + 1)
    return tall.where(when).select(by, order, pick(0).alias("rule"), pick(1).alias("severity"), "was", "now")


def comparison_report(found: DataFrame, scope: str) -> DataFrame:
    """(scope, severity, n, rules): recommendations counted by scope."""
    return found.groupBy(scope, "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule").alias("rules"))


def run_times(runs: DataFrame, by: list[str], seconds: str, memory: str) -> DataFrame:
    """(by, median_s, max_memory): the median of the runs and the largest memory."""
    return runs.groupBy(*by).agg(F.median(seconds).alias("median_s"), F.max(memory).alias("max_memory"))


def cost_ratio(runs: DataFrame, by: str, flag: str, seconds: str) -> DataFrame:
    """(by, ratio): the median with the flag over that without; null where one is missing or 0."""
    m = lambda v: F.median(F.when(F.col(flag) == v, F.col(seconds)))
    return runs.groupBy(by).agg((m(True) / F.nullif(m(False), F.lit(0.0))).alias("ratio"))

"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a hash of doc_id. Each source's budget falls in one bucket; only that bucket is
split again, by the next bits, until a single hash value is left. A source takes every document whole (once for each full
multiple of its size in the budget), then once more those with a hash below the threshold, and a part of the document at it.
Nothing is sorted but the bucket sums, and a larger budget takes a superset (thresholds nest).

Targets: sources by code point, null last, weigh WEIGHTS in turn and share `share` of all sizes; a target stops at
`most` times its source's size and the excess is reshared by weight (water filling).

Defined results: a null text has size 0; rows with one doc_id share a hash, and at the threshold the words left are dealt
to them in proportion, rounded down; a null doc_id hashes as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.llm.common import WORD, Scratch, only

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash, and bits that each histogram level reads.
BITS, STEP = 60, 12


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source, so the windows see few rows."""
    in_order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = totals.withColumn("w", weight.cast("double")).withColumn("budget", F.lit(share) * F.sum("source_size").over(every)).withColumn("w_all", F.sum("w").over(every))
    # by the level at which a source is full; before[k]: full sources ahead of it
    by_level = W.orderBy((F.lit(most) * F.col("source_size") / F.col("w")), F.col("source").cast("binary").asc_nulls_last())
    ahead = by_level.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("c", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(ahead), F.lit(0))).withColumn("wb", F.coalesce(F.sum("w").over(ahead), F.lit(0.0)))
    t = t.withColumn("level", (F.col("budget") - F.col("c")) / (F.col("w_all") - F.col("wb")))
    ok = F.lit(most) * F.col("source_size") >= F.col("level") * F.col("w")
    t = t.withColumn("fill", F.first(F.when(ok, F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    return t.select("source", "source_size", F.least(cap, F.coalesce(F.col("fill") * F.col("w"), cap)).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): size counts words, h is BITS bits of md5(doc_id)."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return only(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h")
    )


def thresholds(rows: DataFrame, goal: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, whole, at, left, here): copies of all, the threshold's hash, the words left for it, and its rows' words."""
    want = F.floor("target").cast("long")
    g = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    g = scratch.table(g.withColumn("left", want - F.col("whole") * F.col("source_size")).withColumn("at", F.lit(0).cast("long")).withColumn("here", F.lit(0).cast("long")))
    inside = rows
    for used in range(STEP, BITS + 1, STEP):
        bucket = F.shiftright("h", BITS - used)
        open_ = g.where("left > 0").select(F.col("source").alias("s"), "left", F.col("at").alias("prefix"))
        mine = inside.join(open_, inside.source.eqNullSafe(open_.s) & (F.shiftright("h", BITS - used + STEP) == F.col("prefix"))).select(*inside.columns, "left")
        sums = mine.groupBy("source", "left", bucket.alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        edge = sums.withColumn("upto", upto).where("upto - n < left and left <= upto").select(F.col("source").alias("s"), F.col("b"), (F.col("left") - F.col("upto") + F.col("n")).alias("rest"), "n", "rows")
        old, g = g, g.drop("rows")
        g = scratch.table(
            g.join(edge, g.source.eqNullSafe(edge.s), "left").select(
                "source", "source_size", "target", "whole", F.coalesce("rest", "left").alias("left"),
                F.coalesce("b", F.shiftleft("at", STEP)).alias("at"), F.coalesce("n", "here").alias("here"), F.coalesce("rows", F.lit(0)).alias("rows"),
            )
        )
        scratch.drop(old)
        if used == BITS:
            return g.withColumn("used", F.lit(used))
        if not g.where("rows > 1").limit(1).count():
            return g.withColumn("used", F.lit(used))
    return g


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, taken) for each row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(sizes(docs))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    g = thresholds(rows, goal, scratch).select(F.col("source").alias("s"), "source_size", "target", "whole", "left", "at", "here", "used")
    head = F.expr(f"shiftright(h, {BITS} - used)")
    part = F.when(F.col("left") <= 0, 0).when(head < F.col("at"), F.col("size")).when(
        head == F.col("at"), F.expr("case when here > 0 then size * left div here else 0 end")
    ).otherwise(0)
    return rows.join(g, rows.source.eqNullSafe(g.s)).select(
        "doc_id", "source", "h", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs as the mix takes them, with their own columns: a row for each whole copy, and the leading words of a part taken."""
    plan = mix(docs, weights, share, most).select(F.struct("doc_id", "source", "size", "taken").alias("mix")).distinct()
    # rows travel whole in one column, so that none of their names can meet those of the plan
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    words = F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0))
    got = rows.join(plan, F.col("doc.doc_id").eqNullSafe(F.col("mix.doc_id")) & F.col("doc.source").eqNullSafe(F.col("mix.source")) & (words == F.col("mix.size")))
    n = F.when(F.col("mix.size") > 0, F.ceil(F.col("mix.taken") / F.col("mix.size"))).otherwise(0).cast("int")
    got = got.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keep = F.col("mix.taken") - (F.col("i") - 1) * F.col("mix.size")
    spans = F.slice(F.split("doc.text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), keep.cast("int") + F.col("doc.text").rlike(r"^[\x20\x09-\x0D]").cast("int"))
    cut = F.when(keep >= F.col("mix.size"), F.col("doc.text")).otherwise(F.rtrim(F.concat_ws("", spans)))
    return got.select(*[cut.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])

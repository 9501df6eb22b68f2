"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function names shingles; a document keeps its SKETCH smallest names. Inverted lists of retained names give
candidates, the sketch of each pair's union estimates its Jaccard similarity and drops what is far below the threshold,
and the full sets of the rest decide exactly.

Skew. Equal sets are one class before any list is made. A list of more than LIST documents is not paired off: its
documents move to lists of two, then three retained names that follow each other, which a passage shared by otherwise
different texts rarely gives. Lists still long then hold a dense group: each is tied to one of its documents (linear), the
components that result are contracted, and only pairs between different components are compared. No list is capped.

Recall. With 0.8 the chance that a pair shares none of INDEX retained names is 0.2**INDEX (2e-17), none of two in a row
about 1e-7 where all its lists are long. One extra name breaks at most two of a set's triples, so a link of whole sets
keeps a common triple but for a set of 4 and the same set with one more name; those are found by deletion keys, exactly.

Order. Names are kept with the top bit flipped (_signed), so that Spark's signed order is the order of the sketches.

Defined results: null or blank text has an empty set and links with nothing; a text with fewer words than a shingle has
its whole word sequence as the one shingle; rows with the same doc_id are one node; a null doc_id links with nothing
(component_id null, kept). Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.common import Scratch, among, id_filter, is_hot, join_hot, list_array, map_text, only
from gridloom.llm.graph import components

SKETCH, INDEX, LIST, BLOCK = 48, 24, 32, 2048


def _signed(names: np.ndarray) -> np.ndarray:
    """uint64 names as int64 in the same order."""
    return (names ^ np.uint64(1 << 63)).view(np.int64)


def shingle_sets(texts: list[bytes], width: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text."""
    words, counts = tokens.word_hashes(texts, lower)
    grams = tokens.window_hashes(words, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            out.append(tokens.span_hashes(words, np.array([at]), np.array([at + n]), seed=2))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): d1 and d2 name the whole set, sketch holds its SKETCH smallest names."""

    def run(keys, texts):
        sets = shingle_sets(texts, width)
        n = np.array([len(s) for s in sets], np.int64)
        offsets = np.zeros(len(sets) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
        total = np.zeros(len(flat) + 1, np.uint64)
        digest = []
        for k in (3, 5):
            np.cumsum(tokens.mix(flat * np.uint64(2 * k + 1) + np.uint64(k)), out=total[1:])
            digest.append(tokens.mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
        short = [s[:SKETCH] for s in sets]
        return {
            "doc_id": keys["doc_id"], "n_shingles": n, "d1": digest[0], "d2": digest[1],
            "sketch": list_array(_signed(np.concatenate([*short, np.zeros(0, np.uint64)])), np.array([len(s) for s in short]), pa.int64()),
        }

    return map_text(only(docs, "doc_id", "text"), ["doc_id", "text"], run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(keys, texts):
        sets = shingle_sets(texts, width)
        return {"node": keys["doc_id"], "names": list_array(_signed(np.concatenate([*sets, np.zeros(0, np.uint64)])), np.array([len(s) for s in sets]), pa.int64())}

    return map_text(docs, ["doc_id", "text"], run, "node long, names array<long>")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that meet the threshold: sizes and sketches drop the hopeless, full sets decide."""
    side = classes.select("node", "n_shingles", "sketch")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{s}") for c in side.columns]) for s in "ab")
    joined = pairs.join(b, pairs.b == b.node_b).join(a, pairs.a == a.node_a)
    fits = F.least("n_shingles_a", "n_shingles_b") * 100 >= F.greatest("n_shingles_a", "n_shingles_b") * percent
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), "u"))
    # five standard deviations below the threshold: no true link is dropped in practice
    p = percent / 100
    floor = F.size("u") * p - 5 * F.sqrt(F.size("u") * p * (1 - p))
    likely = scratch.table(joined.where(fits).withColumn("u", union).where(shared >= floor).select("a", "b"))
    wanted = scratch.table(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    maybe, _ = id_filter(wanted, "node")(docs, "doc_id")
    sets = scratch.table(_sets(among(maybe, wanted.withColumnRenamed("node", "doc_id"), ["doc_id"]), width).distinct())
    sa, sb = sets.select(F.col("node").alias("a"), F.col("names").alias("na")), sets.select(F.col("node").alias("b"), F.col("names").alias("nb"))
    both = F.size(F.array_intersect("na", "nb"))
    links = scratch.table(
        likely.join(sb, "b").join(sa, "a")
        .where(both * 100 >= (F.size("na") + F.size("nb") - both) * percent)
        .select("a", "b").distinct()
    )
    scratch.drop(likely)
    scratch.drop(sets)
    return links


def _by_size(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (a written table) of lists with 2 to LIST members, and of longer ones; none of a long list's rows meet in a task."""
    total = rows.count()
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    hot = F.broadcast(n.where(is_hot("members", total)).select(key))
    short = rows.join(hot, key, "left_anti").join(n.where(F.col("members") <= LIST), key)
    return short.drop("members"), join_hot(rows, n.where(F.col("members") > LIST), [key], "members", total).drop("members")


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    a, b = rows.select(key, F.col("node").alias("a")), rows.select(key, F.col("node").alias("b"))
    return a.join(b, key).where("a < b").select("a", "b")


def _short_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a set of 4 names with the same names and one more: the 5 sets less one name are looked up, one row each."""
    four = classes.where("n_shingles = 4").select(F.col("node").alias("x"), F.col("sketch").alias("key"))
    five = classes.where("n_shingles = 5").select(F.col("node").alias("y"), "sketch", F.explode("sketch").alias("out"))
    less = five.select("y", F.array_remove("sketch", F.col("out")).alias("key"))
    return less.join(four, "key").where(F.lit(4 * 100 >= 5 * percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _bounded_sets(pool: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(node, names, n, s): each pooled document's set, its size, and how many of its shingles any other pooled document has.

    No intersection inside the pool exceeds s, which settles most pairs of a dense group without comparing them.
    """
    maybe, _ = id_filter(pool, "node")(docs, "doc_id")
    sets = scratch.table(_sets(among(maybe, pool.withColumnRenamed("node", "doc_id"), ["doc_id"]), width).distinct())
    each = sets.select("node", F.explode("names").alias("name"))
    alone = each.groupBy("name").agg(F.count(F.lit(1)).alias("in"), F.min("node").alias("node")).where("in = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return sets.withColumn("n", F.size("names")).join(alone, "node", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")


def link_classes(classes: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes, enough of them that their components are those of all links."""
    # retained names with the one and the two that follow
    post = classes.select("node", "sketch", F.posexplode(F.slice("sketch", 1, INDEX)).alias("i", "k1")).select(
        "node", "k1",
        F.when(F.col("i") + 2 <= F.size("sketch"), F.xxhash64("k1", F.get("sketch", F.col("i") + 1))).alias("k2"),
        F.when(F.col("i") + 3 <= F.size("sketch"), F.xxhash64("k1", F.get("sketch", F.col("i") + 1), F.get("sketch", F.col("i") + 2))).alias("k3"),
    )
    posted = scratch.table(post)
    one, more = _by_size(posted, "k1")
    more = scratch.table(more)
    two, more2 = _by_size(more, "k2")
    more2 = scratch.table(more2)
    three, dense = _by_size(more2, "k3")
    dense = scratch.table(dense.select(F.col("k3").alias("k"), "node").distinct())
    star = join_hot(dense, dense.groupBy("k").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")), ["k"], "n", dense.count()).where("a < node").select("a", F.col("node").alias("b"))
    first = _pairs(one, "k1").union(_pairs(two, "k2")).union(_pairs(three, "k3")).union(star).distinct()
    links = scratch.table(_confirm(first, classes, docs, width, percent, scratch).union(_short_links(classes, percent)))
    for t in (posted, more, more2):
        scratch.drop(t)
    for round_ in range(2):
        if not dense.limit(1).count():
            return links
        # the dense lists' documents with their component so far; lists of one component are done
        comp = components(links, scratch)
        held = dense.join(comp, "node", "left").select("k", "node", F.coalesce("component", "node").alias("c"))
        open_ = held.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("k")
        dense = scratch.table(held.join(open_, "k"))
        if not round_:  # another document of each list as its centre
            centre = dense.groupBy("k").agg(F.min_by(F.struct("node", "c"), F.xxhash64("node", F.lit(round_))).alias("s")).select("k", F.col("s.node").alias("a"), F.col("s.c").alias("ca"))
            todo = dense.join(centre, "k").where("c <> ca").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        else:  # all others against each list's documents, but for pairs inside a component
            sizes = dense.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
            main = sizes.groupBy("k").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
            lists = dense.groupBy("node").agg(F.collect_set("k").alias("ks"))
            held = _bounded_sets(scratch.table(dense.select("node").distinct()), docs, width, scratch).join(lists, "node")
            # a list's documents are dealt to blocks of about BLOCK; those outside its main component go to each block
            main = main.join(sizes.groupBy("k").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")), "k")
            full = scratch.table(dense.join(held, "node").join(main, "k").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")))
            rest = full.where("c <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            rest = rest.select("k", "block", *[F.col(c).alias(f"x_{c}") for c in ("node", "c", "names", "n", "s", "ks")])
            both = "size(array_intersect(names, x_names))"
            links = links.union(
                rest.join(full, ["k", "block"]).where(
                    "c <> x_c and (c = main or node < x_node)"
                    f" and least(s, x_s) * {100 + percent} >= {percent} * (n + x_n)"
                    " and k = array_min(array_intersect(ks, x_ks))"
                    f" and {both} * 100 >= (n + x_n - {both}) * {percent}"
                ).select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b"))
            )
            return scratch.table(links)
        dense = dense.drop("c")
        links = scratch.table(links.union(_confirm(todo, classes, docs, width, percent, scratch)))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: documents whose Jaccard similarity is percent/100 or more are linked."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    scratch = Scratch(spark)
    rows = scratch.table(sketches(docs, width))
    live = rows.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class, named by its smallest doc_id
    classes = scratch.table(
        live.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by("sketch", "doc_id").alias("sketch"))
    )
    links = link_classes(classes.select("node", "n_shingles", "sketch"), docs.where("doc_id is not null"), width, percent, scratch)
    member = scratch.table(
        live.select("doc_id", "d1", "d2", "n_shingles").distinct()
        .join(classes.select("d1", "d2", "n_shingles", "node"), ["d1", "d2", "n_shingles"]).select("doc_id", "node")
    )
    # a doc_id whose rows have different sets ties their classes together
    torn = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    ties = member.join(torn, "doc_id").select("a", F.col("node").alias("b"))
    comp = components(links.union(ties), scratch)
    final = member.join(comp, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")).groupBy("doc_id").agg(
        F.min("component").alias("component")
    )
    out = rows.select("doc_id", "n_shingles").join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))

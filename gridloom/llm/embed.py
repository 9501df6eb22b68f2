"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. A table's key is K quantised random projections floor((a.v + b)/w);
two vectors are compared, by their exact cosine in doubles, if any of the tables gives them one key. K grows with the
logarithm of the number of vectors so that buckets of unrelated vectors stay small, and the number of tables follows from
K and the chance MISS of not finding a pair that lies exactly at the threshold (closer pairs are missed less).

Skew. Equal vectors are one class with a multiplicity. A bucket of more than BLOCK vectors becomes pairs of blocks, each a
task's bounded matrix product; a pair is counted only in the first table that has it, and links leave a block as counts
and a spanning forest, never as pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows of one vec_id and vector are one vector; a null vec_id links with nothing
(component_id null, kept). Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, only
from gridloom.llm.graph import components
from gridloom.plans.shipping import ship

WIDTH, MISS, BLOCK, TARGET = 2.0, 1e-3, 256, 64


def same_key_chance(distance: float, width: float = WIDTH) -> float:
    """That one projection puts two points at this distance into one bucket."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(projections a key, tables) for n vectors."""
    far, near = same_key_chance(math.sqrt(2)), same_key_chance(math.sqrt(2 - 2 * cosine))
    k = min(40, max(4, math.ceil(math.log(max(n, 2) / TARGET) / -math.log(far))))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


class Tables:
    def __init__(self, k: int, tables: int, seed: int = 7):
        self.k, self.tables, self.seed, self.made = k, tables, seed, {}

    def keys(self, v: np.ndarray) -> np.ndarray:
        """A 64-bit key for every vector and table."""
        dim = v.shape[1]
        if dim not in self.made:
            r = np.random.Generator(np.random.PCG64([self.seed, dim]))
            mixers = r.integers(1, 2**62, self.k, dtype=np.int64) * 2 + 1
            self.made[dim] = r.standard_normal((dim, self.k * self.tables)), r.uniform(0, WIDTH, self.k * self.tables), mixers
        a, b, mixers = self.made[dim]
        q = np.floor((v @ a + b) / WIDTH).astype(np.int64).reshape(len(v), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = (q * mixers).sum(2) + dim * 0x9E3779B97F4A7
            h ^= (h >> 31) & 0x1FFFFFFFF
            return h * 0x2545F4914F6CDD1D


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, unit(flat[begin[at][:, None] + np.arange(d)[None, :]])


def _compare(v, node, copies, side, table, keys, cosine):
    """(node, links, root) of one block or pair of blocks."""
    first, second = (np.arange(len(v)),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    near = v[first] @ v[second].T >= cosine
    if side is None:
        near &= np.tri(len(v), k=-1, dtype=bool).T
    i, j = np.nonzero(near)
    i, j = first[i], second[j]
    other = node[i] != node[j]
    i, j = i[other], j[other]
    if not len(i):
        return None
    new = ~(keys[i, :table] == keys[j, :table]).any(1) if table else np.ones(len(i), bool)
    links = np.bincount(i[new], copies[j[new]], len(v)) + np.bincount(j[new], copies[i[new]], len(v))
    low = node.copy()
    while True:  # spread the smallest node over links
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if np.array_equal(before, low):
            break
    touched = np.unique(np.concatenate((i, j)))
    return node[touched], links[touched].astype(np.int64), low[touched]


def link_vectors(vectors: DataFrame, cosine: float = 0.95, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = only(vectors, "vec_id", "embedding")
    fine = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    classes = scratch.table(
        rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("copies"))
    )
    k, n_tables = parameters(classes.count(), cosine, miss)
    tables = Tables(k, n_tables)

    def sign(batches):
        for b in batches:
            for at, v in _by_length(b.column(1)):
                keys = tables.keys(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(b.column(0).to_numpy()[at], n_tables)), pa.array(np.tile(np.arange(n_tables, dtype=np.int32), len(at))), pa.array(keys.ravel())],
                    ["node", "t", "key"],
                )

    signed = scratch.table(classes.select("node", "embedding").mapInArrow(sign, "node long, t int, key long").distinct())
    full = signed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int")
    dealt = signed.join(full, ["t", "key"]).withColumn("b", block).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("node", "t", "key", F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"), (F.col("b") > F.col("x")).alias("second"))
    group = ["gid", "t", "key", "bi", "bj"]
    ready = (
        dealt.join(classes, "node").withColumn("gid", F.xxhash64("t", "key", "bi", "bj"))
        .select(*group, "second", "node", "copies", "embedding").repartition(F.col("gid")).sortWithinPartitions(*group)
    )

    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cols = [held.column(c).to_numpy() for c in group]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            if len(change):
                yield from groups(held.slice(0, int(change[-1])), change[:-1])
                held = held.slice(int(change[-1]))
        if held is not None and held.num_rows:
            yield from groups(held, np.zeros(0, int))

    def groups(t, cuts):
        t = t.combine_chunks()
        node, copies, table = (t.column(c).to_numpy() for c in ("node", "copies", "t"))
        second = t.column("second").to_numpy(zero_copy_only=False).astype(bool)
        alike = (t.column("bi").to_numpy() == t.column("bj").to_numpy())
        found = []
        emb = t.column("embedding").chunk(0) if t.num_rows else None
        for at, v in _by_length(emb) if t.num_rows else ():
            keys = tables.keys(v)
            place = np.full(t.num_rows, -1)
            place[at] = np.arange(len(at))
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [t.num_rows])), strict=True):
                r = place[lo:hi]
                r = r[r >= 0]
                if len(r) > 1:
                    g = at[r]
                    got = _compare(v[r], node[g], copies[g], None if alike[lo] else second[g], int(table[lo]), keys[r], cosine)
                    if got:
                        found.append(got)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "links", "root"])

    found = scratch.table(
        ready.mapInArrow(run, "node long, links long, root long").groupBy("node", "root").agg(F.sum("links").alias("links"))
    )
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = classes.join(links, "node", "left").join(comp, "node", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    good = rows.where(fine).join(member, "embedding").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(good, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

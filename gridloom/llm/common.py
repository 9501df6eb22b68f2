"""Helpers shared by the training-data operators: shared-folder tables, folds, Arrow batches, fixed-size row filters."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.scratch import release, shared_dir
from gridloom.plans.shipping import ship

#: A word, by the contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step holds at a time (a single longer text is a step of its own).
STEP_BYTES = 1 << 20


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


class Scratch:
    """Tables in the shared folder: lineage ends there, and a lost executor loses nothing.

    Those that drop() names go at once; the folder's owner clears the rest when results are no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gridloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later plan reads."""
        if path := getattr(df, "_gridloom_path", None):
            _remove(self.spark, path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id's text modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def distinct_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one row per labelled doc_id; null labels are left out, a doc_id with both labels counts as 1."""
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("y"))
    )


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names can't get in the way."""
    return df.select(*[F.col(n) for n in names])


def map_text(df: DataFrame, columns: list[str], fn: Callable[[dict, list[bytes]], dict], schema: str) -> DataFrame:
    """Runs fn over Arrow batches in steps of about STEP_BYTES of text.

    columns[-1] is the text (null: empty). fn gets the other columns as lists and the texts as UTF-8 bytes, and gives
    the output columns as lists or arrays in the schema's order of names.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = 0, batch.num_rows
            text = batch.column(len(names) - 1)
            sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32, n + 1 + text.offset)[text.offset :]) if n and pa.types.is_string(text.type) else None
            while at < n:
                if sizes is None:
                    end = min(n, at + 256)
                else:
                    end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), STEP_BYTES, "right")))
                part = batch.slice(at, end - at)
                texts = [b"" if t is None else t for t in part.column(len(names) - 1).cast(pa.binary()).to_pylist()]
                got = fn({c: part.column(i).to_pylist() for i, c in enumerate(names[:-1])}, texts)
                arrays = [a if isinstance(a := got[f.name], pa.Array) else pa.array(a, type=f.type) for f in out]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
                at = end

    return df.select(*names).mapInArrow(run, schema)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of the values, counts[i] of them in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Most bits of the filter below: 4,194,304 rows of 16 bytes (67 MB) to broadcast, whatever the data.
FILTER_BITS = 1 << 28


def filter_bits(n: int) -> int:
    """Bits for n ids: 16 to 32 an id, so 3 to 6 % of other rows pass, up to the bound. Beyond it more and more do; results stay."""
    return min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))


def id_filter(ids: DataFrame, column: str) -> Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]:
    """A split of any table by whether its id may be among ids (a written table; no false 'no'; null ids are never among them).

    The bitmap is as large as the ids ask for, with a bound. Its words are summed up on the executors and broadcast; the
    test is a join with them and a bit operation, so it needs no Python.
    """
    n = ids.count()
    bits = filter_bits(n)
    if n > bits:
        warnings.warn(f"{n} ids fill the filter of {bits} bits; most rows will be shuffled", stacklevel=2)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        ids.select(slot(F.col(column)).alias("s")).groupBy(F.shiftright("s", 6).alias("_gridloom_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_gridloom_b"))
    )
    words = F.broadcast(words)

    def split(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        s = slot(F.col(name))
        met = df.join(words, F.shiftright(s, 6) == F.col("_gridloom_w"), "left")
        bit = F.col(name).isNotNull() & F.col("_gridloom_b").isNotNull() & (F.getbit(F.coalesce("_gridloom_b", F.lit(0).cast("long")), (s % 64).cast("int")) == 1)
        return met.where(bit).drop("_gridloom_w", "_gridloom_b"), met.where(~bit).drop("_gridloom_w", "_gridloom_b")

    return split


#: A key is hot if it has more rows than this and than a HOT_KEYS-th of all, so there are never more than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 4096, 65536


def is_hot(n: str, total: int) -> Column:
    return F.col(n) > max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with table, which has each key once, with the number n of rows that have it; total: all rows.

    Rows of hot keys stay where they are and meet a broadcast of at most HOT_KEYS rows; the others are shuffled.
    """
    hot = is_hot(n, total)
    there = rows.join(F.broadcast(table.where(hot)), keys)
    return there.unionByName(rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti").join(table.where(~hot), keys))


def among(df: DataFrame, ids: DataFrame, keys: list[str], present: bool = True) -> DataFrame:
    """Rows of df whose keys are in ids (distinct in keys), or those whose keys are not; df comes from id_filter.

    An outer join with a mark, since the optimizer moves semi and anti joins below the filter's own join, where they would
    shuffle every row that the bitmap keeps back.
    """
    mark = ids.select(*keys, F.lit(True).alias("_gridloom_in"))
    out = df.join(mark, keys, "left").where(F.col("_gridloom_in").isNotNull() if present else F.col("_gridloom_in").isNull())
    return out.select(*df.columns)

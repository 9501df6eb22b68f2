"""The corpus pipeline: toxicity, near duplicates, personal data, source mix, packing.

Each stage is a function of (spark, docs, sf_dir). A stage's result is written as Parquet in the shared folder and read
again as the next one's docs, so a lost executor costs the running stage at most. All stages but the last keep the columns
of documents. SQL can't express the classifier, the tokeniser or the packing, so there is no oracle; tests hold near
duplicates and the mix against plain versions, the classifier by held-out labels, packing by a round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, neardup, packing, pii, toxicity
from gridloom.llm.common import Scratch, among, id_filter


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.7 or more) go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id; five-word shingles, similarity 0.8."""
    gone = Scratch(spark).table(neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct())
    maybe, surely = id_filter(gone, "doc_id")(docs, "doc_id")
    return surely.select(*docs.columns).unionByName(among(maybe, gone, ["doc_id"], present=False).select(*docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_entities(docs, pii.session_key(spark))
    return out.select(*[F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them: a document can come twice, or not at all."""
    out = mixing.apply_mix(docs)
    return out.select(*[F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

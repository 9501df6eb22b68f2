"""The queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import embed, langid, mixing, neardup, packing, pii, quality, substring, tiff, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir), width=4, percent=80)


def op3_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_digests(_docs(spark, sf_dir))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_docs(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_docs(spark, sf_dir), pii.session_key(spark)).select("doc_id", "text", "n_entities")


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op9_pack_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op10_toxicity_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP6_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
a AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, sum(w) OVER () AS w_all,
      row_number() OVER (ORDER BY 2 * source_size / w, encode(source) NULLS LAST) AS k FROM r),
b AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS c,
      coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM a),
l AS (SELECT *, (budget - c) / (w_all - wb) AS level FROM b),
f AS (SELECT arg_min(level, k) AS fill FROM l WHERE 2 * source_size >= level * w),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, fill * w) AS target FROM l, f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, floor(u.target)::BIGINT - u.whole * u.source_size AS rest,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mix": OP6_SQL}

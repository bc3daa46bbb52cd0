"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, license, minhash, mixing, packing, pii, quality, repeats, rules, secretscan
from corpusloom.llm.shared import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stage(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("mx_size")), "mix")
    out = mixing.mix(sized)
    return out.select("doc_id", F.col("mx_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("mx_size")).alias("taken"))


SQL["op9_source_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM s),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS mx FROM p),
r AS (SELECT *, mx / w AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(mx) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level >= ratio AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN mx ELSE w * (SELECT level FROM f WHERE NOT capped ORDER BY ratio, pos LIMIT 1) END AS target,
    ('0x' || substr(md5('{mixing.SEED}:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::INTEGER, -1), doc_id NULLS FIRST) AS rk FROM d),
j AS (SELECT k.doc_id, k.size, k.rk, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS ratio
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rk * ratio + u) - floor((rk - 1) * ratio + u))::BIGINT * size)::BIGINT AS taken FROM j
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return rules.judged(table(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document."""
    return license.licenses(table(spark, sf_dir, "documents"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secretscan.secrets(table(spark, sf_dir, "documents"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, class and verdict of every document, on shingles of four words."""
    return minhash.clusters(table(spark, sf_dir, "documents"), width=4)


@query
def op1_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document because a string of 100 bytes starts earlier."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


@query
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, Gumbel key and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""A corpus, from documents to packed sequences: five stages, each of an operator of ``corpusloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared folder
and hands the table read back to the next stage; ``corpusloom.llm.shared.release`` removes those tables once the result is
kept elsewhere.

Cases, for every stage: empty tables give empty results; extra columns are carried along up to the last stage, whatever
their names; null ids, repeated rows and very long texts take part as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import minhash, mixing, packing, quality, secretscan
from corpusloom.llm.shared import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Null and empty texts have log weight 0, rows that tie with the last one drawn
    stay, equal rows share their fate; without labels all stay."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), the one of the smallest id. Documents without
    words are like no other; of rows that share an id one stays; rows without an id all stay."""
    return minhash.deduplicated(docs, width=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts, n_chars following. Null texts stay null; equal rows are treated alike."""
    return secretscan.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target draws it. A null source is one source; documents without words add nothing
    and are drawn at their source's rate; repeated rows are drawn each for itself."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids. Null and empty texts have one id; copies are packed each for itself."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Scoring, signatures and tokens are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.split()[0].lower())
    return docs

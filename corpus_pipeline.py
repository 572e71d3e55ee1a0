"""A corpus in five stages: language, lines, near copies, benchmark passages, mix. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelattice.llm import decontam, langid, lines, mixing, simhash
from tracelattice.llm.common import shared_dir, written
from tracelattice.llm.queries import prepared


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a pooled probability of a half or more; those without a letter go."""
    prepared(spark)
    return docs.where(langid.accepted(langid.fit_language_model(docs)))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that stand elsewhere before, equal or one edit away."""
    prepared(spark)
    return lines.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, similarity 0.8 or more."""
    prepared(spark)
    return simhash.near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark passage."""
    prepared(spark)
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    prepared(spark)
    return mixing.mix_documents(docs)


STAGES = [
    ("language", told_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", near_copies),
    ("decontamination", decontaminated),
    ("mix", mixed),
]

# Trained stages and similarity classes have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; what a stage returns is written to the shared folder and read again."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs

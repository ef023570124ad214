"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage gets what the one before kept, as a written table. The first four return the columns of
``documents``; the last returns the pieces of all kept documents with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import common, mixing, near_dedup, packing, quality_classifier, secret_scan

#: Milder than the mixing operator's own targets: most documents stay.
MIX_POWERS, MIX_BUDGET = {"source": 0.8, "lang": 0.9, "topic": 0.9}, 0.95


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.pipeline_stage(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays (five-word shingles, similarity 0.8)."""
    return near_dedup.pipeline_stage(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts."""
    return secret_scan.pipeline_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities."""
    return mixing.pipeline_stage(docs, MIX_BUDGET, MIX_POWERS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with sequence_id and offset."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: SQL can't express the classifier's training; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.swept(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

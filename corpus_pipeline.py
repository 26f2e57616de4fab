"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftgauge.llm import stages
from driftgauge.llm.common import materialise, table

STAGES = [
    ("language_id", stages.language_stage),
    ("quality_classifier", stages.quality_stage),
    ("ngram_jaccard_join", stages.near_duplicate_stage),
    ("best_fit_packing", stages.packing_stage),
]

#: SQL can't express the classifiers and the packing; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The corpus pipeline: documents to a clean, deduplicated, decontaminated and mixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import stages
from spindrift.llm.common import settle, table

STAGES = [
    ("quality classifier", stages.quality_classifier),
    ("line dedup", stages.line_dedup_stage),
    ("simhash near-dedup", stages.simhash_near_dedup),
    ("benchmark decontamination", stages.benchmark_decontamination),
    ("mixing to target weights", stages.mix_sources),
]

# No stage fits in SQL: trained models, winnowing, bit votes, edit distance and an iterative fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

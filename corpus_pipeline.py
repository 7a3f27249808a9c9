"""Corpus pipeline: stages that each take and return a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import stages
from footfall.llm.common import stored, table

STAGES = [
    ("toxicity", stages.not_toxic),
    ("exact dedup", stages.no_copies),
    ("n-gram Jaccard join", stages.no_near_copies),
    ("secret scans", stages.no_secrets),
    ("best-fit packing", stages.packed),
]

# Learned toxicity scores have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""Corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import stages
from lineweave.session import attach

#: (name, function); each function takes (spark, docs, sf_dir); its result is written and reread as the next one's docs.
STAGES = [
    ("quality_rules", stages.quality_rules),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("secret_scans", stages.secret_scans),
    ("mixing_sources", stages.mixing_sources),
    ("packing", stages.packing_sequences),
]

#: Fingerprints, entropy windows and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.reread(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The operators as pipeline stages: (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows of ``docs`` and, but for the last, returns the columns of ``docs`` in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import attach
from . import mixing, packing, quality, secrets, similar
from .common import table, written

reread = written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality.good_documents(docs, table(attach(spark), sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, 4/5 alike): the one with the smallest id, of equal rows one."""
    attach(spark)
    return similar.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by a mark."""
    attach(spark)
    return secrets.redact_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document's words as often as the mix takes them, one row per document and epoch."""
    attach(spark)
    return mixing.mixed_documents(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences and their token ids."""
    attach(spark)
    return packing.pack_documents(docs)

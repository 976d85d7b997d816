"""Preparation of a training corpus: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import stages
from riskloom.llm.common import table
from riskloom.session import durable

STAGES = [
    ("language_id", stages.known_language),
    ("minhash_near_dedup", stages.one_of_each_group),
    ("pii", stages.without_personal_data),
    ("source_mixing", stages.mixed_sources),
    ("bpe", stages.encoded),
]

# Hashing, scheduling and token merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents through quality rules, near-dedup, decontamination, mixing and sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in the
shared checkpoint folder and read back as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``; the last adds the shard of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varietas.llm import decontaminate, mixing, near_dedup, rules, sharding
from varietas.llm.common import benchmark, documents, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, benchmark(spark, sf_dir))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them (up to three times, or not at all)."""
    return mixing.mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("shard", shard_stage),
]

#: The edit matching, the signatures' links and the mix of what they leave have no SQL form here; the
#: stages are tested against brute force instead (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs

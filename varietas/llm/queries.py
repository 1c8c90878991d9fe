"""Registered queries of the training-data operators: ``opN_<name>`` and ``pipeline``, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varietas.llm import collocations as phrase_mining
from varietas.llm import conversations as conversation_repair
from varietas.llm import decontaminate, language, mixing, near_dedup, oracle, personal_data, pieces, quality, rules, sharding, token_files, toxicity
from varietas.llm.common import benchmark, conversations, documents, labels, scratch_path, tokenizer_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.token_index(spark.read.parquet(path))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    out, targets = mixing.assign_copies(docs)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    joined = out.join(F.broadcast(t) if t.count() <= 200_000 else t, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", F.col("__mix_size").alias("size"), "source_size", "target",
                         (F.col("__mix_size") * F.size("__mix_copies")).alias("taken"),
                         F.col("__mix_copies.shard").alias("shards"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.assign_shards(docs).drop("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(documents(spark, sf_dir))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(conversations(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_near_dedup, op3_personal_data, op4_quality_rules, op5_decontaminate, op6_token_files, op7_mix_sources, op8_shard, op9_toxicity, op10_language,
    op11_sentencepiece, op12_collocations, op13_conversation_repair)}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> tuple[dict, dict]:
    """(queries, oracle SQL by name)."""
    return {**QUERIES, "pipeline": pipeline}, dict(oracle.ORACLE)

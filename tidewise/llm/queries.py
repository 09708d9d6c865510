"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm import chat, decontaminate, exact_dedup, langid, lexical, licenses, mixing, periodic, pii, quality, sharding, simhash, suffix


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.curriculum(_t(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(_t(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_t(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard_id", "depth", "shard_bytes", "shard_docs", "oversize")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_t(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_t(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_t(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_t(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.Index(_t(spark, sf_dir, "documents")), _t(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(_t(spark, sf_dir, "documents"), tail=True).drop("collapsed")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_t(spark, sf_dir, "documents"))
    return out.withColumn("spans", F.array_join("spans", ","))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mixing, op2_pii, op3_sharding, op4_suffix_dedup, op5_quality, op6_chat, op7_simhash, op8_exact_dedup, op9_langid, op10_decontaminate, op11_lexical_search, op12_periodic_runs, op13_license_scan, pipeline]
    return {f.__name__: f for f in found}

"""The queries that apply each corpus operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_quality, lm_score, manifest, mixing, prefix_trie, simhash, substring_dedup, surrogates, token_store, toxicity, url_rules
from .sql import ORACLE


#: The key where the session sets none in spark.tidemark.surrogates.key: for tests, it hides nothing.
NO_SECRET = "not a secret"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_store.store(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.rate(_documents(spark, sf_dir)).drop("source", "text_hash", "bad_lines")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_documents(spark, sf_dir), spark.conf.get("spark.tidemark.surrogates.key", NO_SECRET))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.steps(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(prefix_trie.grafted(turns)).drop("prefix")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    altered = F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    rows = manifest.folded(manifest.manifest(docs, altered=manifest.leaf(docs, text=altered)), "altered")
    in_hex = lambda c: F.lower(F.hex(c))
    return rows.select("doc_id", in_hex("digest").alias("leaf"), in_hex("subroot").alias("subroot"), in_hex("root").alias("root"), F.sha2(in_hex("path"), 256).alias("proof_sha256"), in_hex("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(rules, "host string, path string, verdict string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_token_store, op4_decontamination, op5_substring_dedup, op6_mixing, op7_quality_rules, op8_lm_score, op9_simhash, op10_surrogates, op11_prefix_trie, op12_manifest, op13_url_rules)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""From raw documents to token shards: quality, near duplicates, contamination, mixture, token ids.

Each stage works on all that the one before it kept and returns the columns of documents; the last one returns the
documents' places in the token shards. A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_quality, mixing, simhash, token_store
from tidemark.llm.common import among, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host have. A null text
    fails the rules; ``n_chars``, where there is one, follows the text, and all other columns stay."""
    kept = line_quality.rate(docs).where("kept").groupBy("doc_id", "text_hash").agg(F.max("bad_lines").alias("bad"))
    out = among(docs, kept, ("bad",))
    text = line_quality.without_lines(out["text"], F.col("__tidemark_bad"))
    changed = {"text": text} | ({"n_chars": F.when(F.size("__tidemark_bad") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest doc_id, and of rows with that id
    the one with the smallest text hash; equal rows become one. A null doc_id counts as larger than any other."""
    rows = simhash.near_duplicates(docs)
    first = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("apart")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    kept = among(docs, first.select("x.doc_id", "x.text_hash"))
    if rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies")).where("copies > 0")
    out = among(docs, taken, ("copies",))
    return out.withColumn("__tidemark_copies", F.explode(F.sequence(F.lit(1).cast("long"), "__tidemark_copies"))).drop("__tidemark_copies")


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in wavelet-matrix shards, and where each document is in them."""
    import public_tokenizers

    return token_store.store(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_shards", token_shards),
]

#: Near-duplicate search, edit distances and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

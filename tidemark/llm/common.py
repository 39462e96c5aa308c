"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset in local mode, as in
    tests, a temporary folder is taken and set as the session's checkpoint folder; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        now = spark.sparkContext.getCheckpointDir()
    return str(now).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``rows`` rows; else Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blocks(total: int, each: int) -> int:
    """How many blocks of about ``each`` units hold ``total``."""
    return max(1, -(-int(total) // each))


def among(docs: DataFrame, keys: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are among ``keys`` (doc_id, text_hash, each pair once), with all their
    columns and, under new names ``__tidemark_<name>``, the ``extra`` ones of keys."""
    k = keys.select(F.col("doc_id").alias("__tidemark_id"), F.col("text_hash").alias("__tidemark_hash"), *(F.col(c).alias(f"__tidemark_{c}") for c in extra))
    same = docs["doc_id"].eqNullSafe(k["__tidemark_id"]) & (F.xxhash64(docs["text"].cast("string")) == k["__tidemark_hash"])
    return docs.join(k, same, "inner" if extra else "left_semi").drop("__tidemark_id", "__tidemark_hash")

"""Idempotent writes expressed as DataFrames, and the reports of a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def newest(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with the rows of ``batch`` in place of those with their keys, null keys included."""
    b = newest(batch, keys, order)
    return target.join(b, _same(target, b, keys), "left_anti").unionByName(b)


def upsert_partial(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str], order: list[str]) -> DataFrame:
    """Like ``upsert``, but of rows that are there only the ``update`` columns change."""
    b = newest(batch, keys, order)
    t, n = target.withColumn("__old", F.lit(True)).alias("t"), b.withColumn("__new", F.lit(True)).alias("n")
    on = reduce(lambda x, y: x & y, (F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    fresh = lambda c: F.col("__new").isNotNull() & (F.col("__old").isNull() if c not in update else F.lit(True))
    return t.join(n, on, "full").select(*(F.when(fresh(c), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def replace_by_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the batch's keys go, the batch comes."""
    b = batch.select(*keys).distinct()
    return target.join(b, _same(target, b, keys), "left_anti").unionByName(batch)


def split_bad(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and the others; unknown counts as bad."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def chunked(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """chunk_index from 1 on, ``size`` rows in each; rows are numbered by ranges, not in one task."""
    if size <= 0:
        raise ValueError("size is to be positive")
    return numbered(df, order, "__row").withColumn("chunk_index", (F.floor(F.col("__row") / size) + 1).cast("int")).drop("__row")


def load_report(loaded: DataFrame, failed: DataFrame, by: str) -> DataFrame:
    """Rows loaded and failed by chunk."""
    a, b = loaded.groupBy(by).agg(F.count("*").alias("loaded")), failed.groupBy(by).agg(F.count("*").alias("failed"))
    zero = F.lit(0).cast("long")
    return a.join(b, by, "full").select(by, F.coalesce("loaded", zero).alias("loaded"), F.coalesce("failed", zero).alias("failed"))


def digest(news: DataFrame, key: str, order: list[str], top: int = 3) -> DataFrame:
    """Of each key its first titles and how many more there are."""
    w = Window.partitionBy(key).orderBy(*order)
    n = news.withColumn("__n", F.row_number().over(w))
    return n.groupBy(key).agg(F.count("*").alias("articles"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__n") <= top, F.struct("__n", "title")))), lambda x: x["title"]), "; ").alias("titles"), F.greatest(F.count("*") - top, F.lit(0)).alias("more"))

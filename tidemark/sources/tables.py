"""Input tables and the views of them that the analytics use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core below which an input is dealt over the cores.
LITTLE = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by ``key`` where there is so little to read that a file or two would hold all tasks; larger
    inputs come in splits enough and are left as they are, without a shuffle. The size is the optimiser's estimate."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * LITTLE else df


def _bars(ticks: DataFrame, *keys: str) -> DataFrame:
    first = F.struct("l_orderkey", "l_linenumber", "px")
    return ticks.groupBy(*keys, "trading_date").agg(
        F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.avg("px").alias("close"), F.sum("l_quantity").alias("volume")
    )


def _ticks(spark: SparkSession, sf_dir: str, symbols: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % symbols).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("trading_date"),
        (100 + F.col("l_extendedprice") / 1000).alias("px"), "l_quantity", "l_orderkey", "l_linenumber",
    )


def prices(spark: SparkSession, sf_dir: str, symbols: int = 8) -> DataFrame:
    """symbol, trading_date, open, high, low, close, volume."""
    return _bars(_ticks(spark, sf_dir, symbols), "symbol")


def index_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trading_date and close of the market as a whole."""
    return _bars(_ticks(spark, sf_dir, 1)).select("trading_date", "close")


def sectors(prices: DataFrame) -> DataFrame:
    """symbol and industry of each symbol."""
    return prices.select("symbol").distinct().withColumn("industry", F.concat(F.lit("I"), (F.substring("symbol", 2, 9).cast("int") % 3).cast("string")))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news_id, text, source, publish_date of the documents; a small table is dealt over the cores, as its texts cost more than their way."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("news_id"), F.coalesce("text", F.lit("")).alias("text"), "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("timestamp").alias("publish_date")
    )

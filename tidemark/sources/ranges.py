"""Reads of stored tables by symbol, range, source and page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statements import provider_fallback
from ..operators.stored import PART, Table
from ..operators.timeseries import log_return

#: The folders of prices are months.
MONTH = "date_format(trading_date, 'yyyy-MM')"


def price_table(path: str) -> Table:
    """A stored table of prices by symbol and date, in folders of a month."""
    return Table(path, ("symbol", "trading_date"), ("close",), MONTH)


def read_prices(spark: SparkSession, sources: list[tuple[str, Table]], symbols: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Prices of the symbols (or all) from ``start`` to ``end``, both included, with log_ret, each symbol's from the first source that has any row of it in
    the range; source_provider names it.

    Only the folders of the range are read, and the symbols and dates are pushed down to the files. The first return of a symbol
    in the range is null: the close before it is not read.
    """
    frames = []
    for name, table in sources:
        rows = spark.read.parquet(table.path)
        if start is not None:
            rows = rows.where((F.col(PART) >= f"p{start:%Y-%m}") & (F.col("trading_date") >= F.lit(start)))
        if end is not None:
            rows = rows.where((F.col(PART) <= f"p{end:%Y-%m}") & (F.col("trading_date") <= F.lit(end)))
        if symbols is not None:
            rows = rows.where(F.col("symbol").isin(symbols))
        frames.append((name, rows.drop(PART)))
    return log_return(provider_fallback(frames, "symbol"))


def read_news(news: DataFrame, assets: list[int] | None = None, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """News with text (title, a space, content), the newest first, of the given assets or all.

    A page is the next ``limit`` rows ``after`` the (publish_date, news_id) of the last row read, so that a page costs what it holds and
    not the pages before it. Null titles and contents are empty; rows without a date come last.
    """
    rows = news.where(F.col("asset_id").isin(assets)) if assets is not None else news
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("text", F.trim(F.concat(part("title"), F.lit(" "), part("content"))))
    if after is not None:
        date, last = after
        same = F.col("publish_date").eqNullSafe(F.lit(date).cast("timestamp")) & (F.col("news_id") < last)
        older = F.lit(False) if date is None else F.col("publish_date").isNull() | (F.col("publish_date") < F.lit(date).cast("timestamp"))
        rows = rows.where(same | older)
    rows = rows.orderBy(F.desc_nulls_last("publish_date"), F.desc("news_id"))
    return rows.limit(limit) if limit is not None else rows

"""Joins that look back: latest rows, as-of snapshots, refresh candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("x")).select(*keys, "x.*")


def nth_previous(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Each key's last value and the one n rows before it."""
    w = Window.partitionBy(key).orderBy(order)
    back = df.withColumn("previous", F.lag(value, n).over(w))
    return back.groupBy(key).agg(F.max_by(value, order).alias("latest"), F.max_by("previous", order).alias("previous"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the right row of the key that is the last at or before its time.

    Both sides are shuffled once by key and read in order; no pair of rows is formed. ``right`` has one row for each
    key and time.
    """
    cols = [c for c in left.columns if c not in (key, time)]
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    a = left.select(key, time, F.lit(1).alias("__side"), F.struct(*cols).alias("__row"), F.struct(*(null(right, v).alias(v) for v in values)).alias("__value"))
    b = right.select(key, time, F.lit(0).alias("__side"), F.struct(*(null(left, c).alias(c) for c in cols)).alias("__row"), F.struct(*values).alias("__value"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("__found", F.last(F.when(F.col("__side") == 0, F.col("__value")), ignorenulls=True).over(w))
    return u.where("__side = 1").select(key, time, "__row.*", *(F.col("__found")[v].alias(v) for v in values))


def refresh_candidates(events: DataFrame, assets: DataFrame, prices: DataFrame, as_of: Column | None = None, lookback: int = 7) -> DataFrame:
    """Assets with a symbol whose prices were never loaded, or not since an event came in; an event without a time of arrival
    counts if its date is at most ``lookback`` days old. Distinct asset_id and symbol.

    events: asset_id, ingested_at, event_date. prices: asset_id, ingested_at.
    """
    last = prices.groupBy("asset_id").agg(F.max("ingested_at").alias("loaded"))
    j = events.join(assets.where("symbol IS NOT NULL"), "asset_id").join(last, "asset_id", "left")
    late = F.col("loaded").isNull() | (F.col("ingested_at") > F.col("loaded"))
    if as_of is not None:
        late = late | (F.col("ingested_at").isNull() & (F.col("event_date") >= F.date_sub(as_of, lookback)))
    return j.where(late).select("asset_id", "symbol").distinct()


def unmatched(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other, keys, "left_anti")


def matched(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other, keys, "left_semi")

"""Indicators over price series: one row for each (symbol, trading_date).

All windows share the partitioning by symbol, so a chain of them costs one shuffle. Recurrences, which no window
expresses, run in one grouped map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_symbol(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("trading_date")


def last_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_symbol()).rowsBetween(1 - n, 0)


def full(value: Column, n: int, over: Column, w: WindowSpec | None = None) -> Column:
    """``value`` where the last n rows all have ``over``; else null."""
    return F.when(F.count(over).over(last_rows(n, w)) == n, value)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def log_return(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn("log_ret", F.log(F.col("close") / F.lag("close").over(w or by_symbol())))


def pct_change(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    return df.withColumn("ret", F.col("close") / F.lag("close").over(w or by_symbol()) - 1)


def sma(x: str, n: int) -> Column:
    return full(F.avg(x).over(last_rows(n)), n, F.col(x))


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """bb_upper, bb_lower, bb_mid, bb_pct, bb_width with the population deviation."""
    mid, dev = sma("close", n), full(F.stddev_pop("close").over(last_rows(n)), n, F.col("close"))
    df = df.withColumn("bb_mid", mid).withColumn("__dev", dev)
    df = df.withColumn("bb_upper", F.col("bb_mid") + width * F.col("__dev")).withColumn("bb_lower", F.col("bb_mid") - width * F.col("__dev"))
    band = F.nullif(F.col("bb_upper") - F.col("bb_lower"), F.lit(0.0))
    return df.withColumn("bb_pct", (F.col("close") - F.col("bb_lower")) / band).withColumn("bb_width", band / F.nullif(F.col("bb_mid"), F.lit(0.0)) * 100).drop("__dev")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """stoch_k, stoch_d and williams_r."""
    low, high = full(F.min("low").over(last_rows(n)), n, F.col("low")), full(F.max("high").over(last_rows(n)), n, F.col("high"))
    df = df.withColumn("__low", low).withColumn("__high", high)
    span = F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    df = df.withColumn("stoch_k", 100 * (F.col("close") - F.col("__low")) / span).withColumn("williams_r", -100 * (F.col("__high") - F.col("close")) / span)
    return df.withColumn("stoch_d", full(F.avg("stoch_k").over(last_rows(smooth)), smooth, F.col("stoch_k"))).drop("__low", "__high")


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    before = F.lag("close", n).over(by_symbol())
    return df.withColumn(f"roc_{n}", (F.col("close") - before) / F.nullif(before, F.lit(0.0)) * 100)


def obv(df: DataFrame) -> DataFrame:
    """Volume signed by the move of the close; ties and the first row add."""
    signed = F.when(F.col("close") < F.lag("close").over(by_symbol()), -F.col("volume")).otherwise(F.col("volume"))
    return df.withColumn("__signed", signed).withColumn("obv", F.sum("__signed").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("__signed")


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    up = F.when(F.col("__tp") > F.lag("__tp").over(by_symbol()), 1).when(F.col("__tp") < F.lag("__tp").over(by_symbol()), -1).otherwise(0)
    df = df.withColumn("__up", up).withColumn("__flow", F.col("__tp") * F.col("volume") * F.col("__up"))
    plus = F.sum(F.when(F.col("__flow") > 0, F.col("__flow")).otherwise(0.0)).over(last_rows(n))
    minus = F.sum(F.when(F.col("__flow") < 0, -F.col("__flow")).otherwise(0.0)).over(last_rows(n))
    value = F.when(minus == 0, 100.0).otherwise(100 - 100 / (1 + plus / F.nullif(minus, F.lit(0.0))))
    return df.withColumn(f"mfi_{n}", full(value, n, F.col("__tp"))).drop("__tp", "__up", "__flow")


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("vol_ma20", sma("volume", n)).withColumn("vol_ratio", F.col("volume") / F.nullif(F.col("vol_ma20"), F.lit(0.0)))


def drawdown(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """running_max and drawdown."""
    df = df.withColumn("running_max", F.max("close").over((w or by_symbol()).rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("drawdown", F.col("close") / F.col("running_max") - 1)


def rolling_var(df: DataFrame, n: int = 60, q: float = 0.05) -> DataFrame:
    """The q quantile of the last n log returns."""
    return df.withColumn("rolling_var", full(F.percentile("log_ret", F.lit(q)).over(last_rows(n)), n, F.col("log_ret")))


def _ewm(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Recursive exponential mean that starts at the first value; null before ``least`` values."""
    out, now, seen = np.full(len(x), np.nan), np.nan, 0
    for i, v in enumerate(x):
        if not np.isnan(v):
            now = v if seen == 0 else now + alpha * (v - now)
            seen += 1
        if seen >= least:
            out[i] = now
    return out


def _seeded(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean, seeded with the plain mean of the first n values; zero before."""
    out = np.zeros(len(x))
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


SPANS = (9, 12, 21, 26, 50, 200)
RECURRENT = (*(f"ema_{n}" for n in SPANS), "macd", "macd_signal", "macd_diff", "rsi_14", "atr_14", "adx")
#: The columns of a technical report beside symbol and trading_date.
INDICATORS = [
    "close", "ema_9", "ema_21", "ema_50", "ema_200", "sma_20", "macd", "macd_signal", "macd_diff", "adx", "rsi_14", "stoch_k", "stoch_d", "roc_10", "williams_r",
    "bb_upper", "bb_lower", "bb_mid", "bb_pct", "bb_width", "atr_14", "obv", "mfi_14", "vol_ratio",
]


def recurrences(df: DataFrame) -> DataFrame:
    """Exponential means, MACD, RSI, ATR and ADX; a symbol's rows, a few thousand, make one group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("trading_date").reset_index(drop=True)
        c, h, low = (p[k].to_numpy(float) for k in ("close", "high", "low"))
        before = np.concatenate([[np.nan], c[:-1]])
        for n in SPANS:
            p[f"ema_{n}"] = _ewm(c, 2 / (n + 1), n)
        p["macd"] = p["ema_12"] - p["ema_26"]
        p["macd_signal"] = _ewm(p["macd"].to_numpy(), 2 / 10, 9)
        p["macd_diff"] = p["macd"] - p["macd_signal"]
        move = c - before
        up, down = _ewm(np.where(move > 0, move, 0.0), 1 / 14, 14), _ewm(np.where(move < 0, -move, 0.0), 1 / 14, 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            p["rsi_14"] = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            p.loc[np.isnan(up), "rsi_14"] = np.nan
            first = np.where(np.isnan(before), h - low, np.maximum(h, before) - np.minimum(low, before))
            p["atr_14"] = _seeded(first, 14)
            rise, fall = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
            plus, minus = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
            tr, pdm, ndm = (_seeded(x, 14) for x in (first, plus, minus))
            di = np.where(tr > 0, 100 * np.abs(pdm - ndm) / (pdm + ndm), 0.0)
            p["adx"] = np.concatenate([np.zeros(min(13, len(di))), _seeded(np.nan_to_num(di[13:]), 14)])[: len(di)]
        return p

    schema = T.StructType([*df.schema.fields, *(T.StructField(x, T.DoubleType()) for x in RECURRENT)])
    return df.groupBy("symbol").applyInPandas(run, schema)


def technical_indicators(prices: DataFrame) -> DataFrame:
    """symbol, trading_date, log_ret and all indicators; rows with a null in any of them go."""
    df = recurrences(prices).withColumn("sma_20", sma("close", 20))
    for f in (bollinger, stochastic, roc, obv, mfi, volume_ratio, log_return):
        df = f(df)
    return df.select("symbol", "trading_date", "log_ret", *INDICATORS).na.replace(float("nan"), None).dropna()


def signal_latest(indicators: DataFrame) -> DataFrame:
    """BUY, SELL or HOLD of each symbol's last row."""
    last = indicators.groupBy("symbol").agg(F.max_by(F.struct("trading_date", "close", "macd", "macd_signal", "rsi_14"), "trading_date").alias("x")).select("symbol", "x.*")
    buy, sell = (F.col("macd") > F.col("macd_signal")) & (F.col("rsi_14") < 65), (F.col("macd") < F.col("macd_signal")) & (F.col("rsi_14") > 60)
    return last.withColumn("signal", F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"))

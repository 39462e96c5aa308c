"""Signals, positions and backtests; everything is windows by symbol and strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import by_symbol

YEAR, RISK_FREE = 252, 0.045


def crossover(x: str, y: str) -> Column:
    """1 where x rises above y, -1 where it falls below, else 0."""
    w = by_symbol()
    up = (F.col(x) > F.col(y)) & (F.lag(x).over(w) <= F.lag(y).over(w))
    down = (F.col(x) < F.col(y)) & (F.lag(x).over(w) >= F.lag(y).over(w))
    return F.when(up, 1).when(down, -1).otherwise(0)


def threshold_signal(x: str, low: float, high: float) -> Column:
    return F.when(F.col(x) < low, 1).when(F.col(x) > high, -1).otherwise(0)


def combo_signal(sell: Column, buy: Column) -> Column:
    """A sale overrides a purchase."""
    return F.when(sell, -1).when(buy, 1).otherwise(0)


def signals(df: DataFrame) -> DataFrame:
    """A row for each strategy of the indicators' rows: S1 exponential means 9 and 21 cross, S2 RSI returns, S3 MACD crosses
    its signal, S4 the trend of 21 and 50 with a low RSI and much volume, and buy and hold."""
    df = df.withColumn("S1", crossover("ema_9", "ema_21")).withColumn("S2", threshold_signal("rsi_14", 30, 70)).withColumn("S3", crossover("macd", "macd_signal"))
    buy = (F.col("ema_21") > F.col("ema_50")) & (F.col("rsi_14") < 40) & (F.col("vol_ratio") > 1)
    df = df.withColumn("S4", combo_signal((F.col("rsi_14") > 70) | (crossover("ema_21", "ema_50") == -1), buy))
    names = ("S1", "S2", "S3", "S4")
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(n).alias("signal")) for n in names), F.struct(F.lit("BH").alias("strategy"), F.lit(1).alias("signal")))
    return df.select("symbol", "trading_date", "close", F.inline(each))


def position_state(df: DataFrame, keys: tuple[str, ...] = ("symbol", "strategy")) -> DataFrame:
    """Position 1 or 0: held until the opposite signal, flat at the start."""
    w = by_symbol(*keys).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("signal") != 0, (F.col("signal") == 1).cast("int")), ignorenulls=True).over(w)
    return df.withColumn("position", F.coalesce(held, F.lit(0)))


def equity(df: DataFrame, cost: float = 0.0025, capital: float = 1e8, keys: tuple[str, ...] = ("symbol", "strategy")) -> DataFrame:
    """Net returns and equity: yesterday's position earns, today's change of position costs."""
    w = by_symbol(*keys)
    df = df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("held", F.lag("position").over(w)).withColumn("turn", F.abs(F.col("position") - F.col("held")))
    df = df.withColumn("net", F.col("held") * F.col("ret") - F.coalesce(F.col("turn"), F.lit(0)) * cost)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # a running product by logarithms and the parity of negative factors
    grown = F.exp(F.sum(F.log(F.abs(1 + F.col("net")))).over(run)) * F.when(F.sum((1 + F.col("net") < 0).cast("int")).over(run) % 2 == 1, -1).otherwise(1)
    df = df.withColumn("equity", F.when(F.col("net").isNotNull(), capital * grown))
    return df.withColumn("peak", F.max("equity").over(run))


def backtest(df: DataFrame, cost: float = 0.0025, capital: float = 1e8, keys: tuple[str, ...] = ("symbol", "strategy")) -> DataFrame:
    """Metrics of each symbol and strategy from rows with close and signal."""
    e = equity(position_state(df, keys), cost, capital, keys)
    a = e.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("trading_date"))) / capital - 1).alias("total_return"),
        F.avg("net").alias("mean"), F.stddev_samp("net").alias("dev"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
        F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("gain"), F.sum(F.when(F.col("net") < 0, -F.col("net"))).alias("loss"), F.sum(F.coalesce("turn", F.lit(0))).cast("long").alias("trades"),
    )
    years = F.col("n") / YEAR
    a = a.withColumn("ann_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(-1.0)).withColumn("ann_vol", F.col("dev") * YEAR**0.5)
    a = a.withColumn("sharpe", F.when(F.col("ann_vol") > 0, (F.col("ann_return") - RISK_FREE) / F.col("ann_vol")).otherwise(0.0)).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / -F.col("max_drawdown")).otherwise(0.0))
    a = a.withColumn("final_equity", (F.col("total_return") + 1) * capital)
    return a.withColumn("profit_factor", F.coalesce("gain", F.lit(0.0)) / F.col("loss")).select(*keys, "n", "total_return", "final_equity", "ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar", "profit_factor", "trades")


def best_strategy(metrics: DataFrame) -> DataFrame:
    """Each symbol's strategy with the best Sharpe ratio, buy and hold aside; ties go to the first name."""
    w = Window.partitionBy("symbol").orderBy(F.desc("sharpe"), "strategy")
    return metrics.where("strategy <> 'BH'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def walk_forward(indicators: DataFrame, periods: DataFrame, least: int = 20) -> DataFrame:
    """The MACD strategy beside buy and hold in each period (period, start, end) with at least ``least`` rows.

    Indicators come from the whole history; crossings and positions start anew in each period.
    """
    p = F.broadcast(periods)  # a handful of rows that the caller writes down
    inside = indicators.join(p, (F.col("trading_date") >= F.col("start")) & (F.col("trading_date") <= F.col("end")))
    w = Window.partitionBy("symbol", "period").orderBy("trading_date")
    x, y = F.col("macd") - F.col("macd_signal"), F.lag(F.col("macd") - F.col("macd_signal")).over(w)
    each = F.array(F.struct(F.lit("macd").alias("strategy"), F.when((x > 0) & (y <= 0), 1).when((x < 0) & (y >= 0), -1).otherwise(0).alias("signal")), F.struct(F.lit("bh").alias("strategy"), F.lit(1).alias("signal")))
    m = backtest(inside.withColumn("__s", each).select("symbol", "period", "trading_date", "close", F.inline("__s")), keys=("symbol", "strategy", "period")).where(F.col("n") >= least)
    of = lambda k, c: F.max(F.when(F.col("strategy") == k, F.col(c)))
    out = m.groupBy("symbol", "period").agg(*(of(k, c).alias(f"{k}_{n}") for c, n in (("total_return", "return"), ("sharpe", "sharpe"), ("max_drawdown", "max_dd")) for k in ("macd", "bh")))
    return out.withColumn("macd_outperforms", F.col("macd_return") > F.col("bh_return"))


def walk_forward_wins(periods: DataFrame) -> DataFrame:
    """In how many of its periods each symbol's MACD strategy beats buy and hold."""
    return periods.groupBy("symbol").agg(F.count_if("macd_outperforms").alias("wins"), F.count("*").alias("periods"))

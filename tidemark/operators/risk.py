"""Return and risk statistics by symbol."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributions import GRID, student_t, t_quantile
from .timeseries import drawdown, log_return, rolling_var

YEAR, RISK_FREE = 252, 0.045


def corrected_skew(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def return_stats(returns: DataFrame, keys: tuple[str, ...] = ("symbol",), x: str = "log_ret") -> DataFrame:
    """Annual return and volatility, Sharpe ratio, bias-corrected skewness and excess kurtosis, Jarque-Bera."""
    g, k = F.skewness(x), F.kurtosis(x)
    a = returns.groupBy(*keys).agg(
        F.count(x).alias("n"), (F.avg(x) * YEAR).alias("ann_return"), (F.stddev_samp(x) * YEAR**0.5).alias("ann_vol"), corrected_skew(x).alias("skew"), corrected_kurtosis(x).alias("kurtosis"),
        (F.count(x) / 6 * (g * g + k * k / 4)).alias("jb_stat"),
    )
    a = a.withColumn("sharpe", (F.col("ann_return") - RISK_FREE) / F.nullif(F.col("ann_vol"), F.lit(0.0)))
    return a.withColumn("jb_p", F.exp(-F.col("jb_stat") / 2)).withColumn("is_normal", F.col("jb_p") > 0.05)


def with_index(prices: DataFrame, index: DataFrame) -> DataFrame:
    """Log returns beside those of the index from one to the next of the symbol's rows that have a return; rows with both."""
    w = Window.partitionBy("symbol").orderBy("trading_date")
    j = log_return(prices.join(index.select("trading_date", F.col("close").alias("index_close")), "trading_date", "left")).where("log_ret IS NOT NULL")
    return j.withColumn("index_ret", F.log(F.col("index_close") / F.lag("index_close").over(w))).where("index_ret IS NOT NULL")


def capm(returns: DataFrame) -> DataFrame:
    """beta, alpha (of a year), r2 and a label by symbol."""
    y, x = F.col("log_ret"), F.col("index_ret")
    a = returns.groupBy("symbol").agg(F.regr_slope(y, x).alias("beta"), (F.regr_intercept(y, x) * YEAR).alias("alpha"), F.regr_r2(y, x).alias("r2"))
    return a.withColumn("kind", F.when(F.col("beta") > 1.2, "HIGH-BETA").when(F.col("beta") > 0.8, "MARKET").otherwise("DEFENSIVE"))


def max_drawdown(prices: DataFrame) -> DataFrame:
    """The deepest drawdown, its first date, the peak before and the close at it."""
    d = drawdown(prices)
    low = F.struct("drawdown", "trading_date")
    return d.groupBy("symbol").agg(F.min(low).alias("low"), F.min_by("running_max", low).alias("peak"), F.min_by("close", low).alias("trough")).select("symbol", F.col("low.drawdown").alias("max_drawdown"), F.col("low.trading_date").alias("max_dd_date"), "peak", "trough")


def value_at_risk(returns: DataFrame, confidence: float = 0.95, notional: float = 1e8) -> DataFrame:
    """Historical, normal, Student-t and Cornish-Fisher value at risk, expected shortfalls, and the losses on a notional."""
    if not 0.9 <= confidence <= 0.99:
        raise ValueError("confidence is to lie between 0.9 and 0.99")
    z, tail = NormalDist().inv_cdf(1 - confidence), 1 - confidence
    density = NormalDist().pdf(z)
    r = returns.where("log_ret IS NOT NULL")
    a = r.groupBy("symbol").agg(F.percentile("log_ret", F.lit(tail)).alias("var_hist"), F.avg("log_ret").alias("mu"), F.stddev_samp("log_ret").alias("sd"), corrected_skew("log_ret").alias("s"), corrected_kurtosis("log_ret").alias("k"))
    short = r.join(a.select("symbol", "var_hist"), "symbol").where("log_ret <= var_hist").groupBy("symbol").agg(F.avg("log_ret").alias("cvar_hist"))
    cf = z + (z * z - 1) * F.col("s") / 6 + (z**3 - 3 * z) * F.col("k") / 24 - (2 * z**3 - 5 * z) * F.col("s") * F.col("s") / 36
    a = a.join(short, "symbol", "left").withColumn("var_normal", F.col("mu") + z * F.col("sd")).withColumn("cvar_normal", F.col("mu") - F.col("sd") * density / tail)
    t = student_t(r)
    quantile = F.create_map(*(F.lit(float(x)) for n in GRID for x in (n, t_quantile(tail, n))))
    t = t.select("symbol", (F.col("mean") + F.col("scale") * quantile[F.col("dof").cast("double")]).alias("var_t"))
    beyond = r.join(t, "symbol").groupBy("symbol").agg(F.max("var_t").alias("var_t"), F.avg(F.when(F.col("log_ret") <= F.col("var_t"), F.col("log_ret"))).alias("cvar_t"))
    a = a.withColumn("var_cf", F.col("mu") + cf * F.col("sd")).withColumn("loss_hist", F.abs("var_hist") * notional).withColumn("loss_cvar", F.abs("cvar_hist") * notional)
    return a.drop("mu", "sd", "s", "k").join(beyond, "symbol")


def risk_report(prices: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Values at risk, drawdown and the latest rolling value at risk of each symbol."""
    r = log_return(prices)
    rolling = rolling_var(r).groupBy("symbol").agg(F.max_by("rolling_var", F.when(F.col("rolling_var").isNotNull(), F.col("trading_date"))).alias("rolling_var"))
    return value_at_risk(r, confidence).join(max_drawdown(prices), "symbol").join(rolling, "symbol")


def eda_report(prices: DataFrame, index: DataFrame) -> DataFrame:
    """Return statistics, market model and drawdown of each symbol, and the index's statistics over the same dates."""
    r = with_index(prices, index)
    own, of_index = return_stats(r), return_stats(r, x="index_ret").select("symbol", *(F.col(c).alias(f"index_{c}") for c in ("ann_return", "ann_vol", "sharpe")))
    return own.join(capm(r), "symbol").join(of_index, "symbol").join(max_drawdown(r).select("symbol", "max_drawdown"), "symbol")

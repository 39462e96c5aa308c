"""Distribution tests and fits of return series by symbol."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Degrees of freedom among which the Student-t fit chooses, and scales, in hundredths of the sample's deviation.
GRID, SCALES = (2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 60), tuple(range(40, 105, 5))


def t_constant(nu: int) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-30)
    out = d
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-30), 1 + num / c or 1e-30
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) * out / a


def t_quantile(p: float, nu: int) -> float:
    """Quantile of Student's law for p under a half, by halving."""
    low, high = -1e4, 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(nu / 2, 0.5, nu / (nu + mid * mid)) / 2 < p else (low, mid)
    return (low + high) / 2


def student_t(returns: DataFrame, grid: tuple[int, ...] = GRID, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """Degrees of freedom and scale with the highest likelihood, at the sample's mean: symbol, dof, scale, mean, log_lik."""
    r = returns.where("log_ret IS NOT NULL")
    m = r.groupBy("symbol").agg(F.avg("log_ret").alias("mu"), F.stddev_samp("log_ret").alias("sd"))
    cells = F.array(*(F.struct(F.lit(n).alias("dof"), F.lit(k).alias("part"), F.lit(t_constant(n)).alias("c")) for n in grid for k in scales))
    each = r.join(m, "symbol").select("symbol", "mu", "sd", ((F.col("log_ret") - F.col("mu")) / F.col("sd")).alias("z"), F.inline(cells))
    k = F.col("part") / 100
    ll = each.groupBy("symbol", "mu", "sd", "dof", "part").agg(F.sum(F.col("c") - F.log(F.col("sd") * k) - (F.col("dof") + 1) / 2 * F.log(1 + F.pow(F.col("z") / k, 2) / F.col("dof"))).alias("log_lik"))
    best = ll.groupBy("symbol").agg(F.max_by(F.struct("dof", (F.col("sd") * k).alias("scale"), F.col("mu").alias("mean")), F.struct(F.round("log_lik", 6), -F.col("dof"), -F.col("part"))).alias("x"), F.max("log_lik").alias("log_lik"))
    return best.select("symbol", "x.*", "log_lik")


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def ks_normal(returns: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance from the normal law of the sample's mean and deviation, with its asymptotic p value."""
    r = returns.where("log_ret IS NOT NULL")
    m = r.groupBy("symbol").agg(F.avg("log_ret").alias("mu"), F.stddev_samp("log_ret").alias("sd"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("log_ret", "trading_date"))
    p = r.join(m, "symbol").withColumn("i", rank).withColumn("phi", normal_cdf((F.col("log_ret") - F.col("mu")) / F.col("sd")))
    d = p.groupBy("symbol", "n").agg(F.max(F.greatest(F.abs(F.col("i") / F.col("n") - F.col("phi")), F.abs(F.col("phi") - (F.col("i") - 1) / F.col("n")))).alias("ks_stat"))
    x = F.sqrt(F.col("n")) * F.col("ks_stat")
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 30)), F.lit(0.0))
    return d.withColumn("ks_p", F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


#: MacKinnon's response surface for the statistic's p value, one series and a constant. Between the least and the most
#: the p value is the normal distribution of a polynomial of the statistic, lowest power first; below and above it is 0 and 1.
ADF_LEAST, ADF_BREAK, ADF_MOST = -18.83, -1.61, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(stat: Column) -> Column:
    """The p value of an augmented Dickey-Fuller statistic with a constant; null for null and NaN."""
    poly = lambda c: sum((F.lit(x) * F.pow(stat, F.lit(i)) for i, x in enumerate(c)), F.lit(0.0))
    z = normal_cdf(F.when(stat <= ADF_BREAK, poly(ADF_SMALL)).otherwise(poly(ADF_LARGE)))
    return F.when(F.isnan(stat), None).when(stat > ADF_MOST, 1.0).when(stat < ADF_LEAST, 0.0).otherwise(z)


def adf(returns: DataFrame, critical: float = -2.8615) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant and its p value; the lag has the least AIC. A group is one symbol's returns."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("trading_date")["log_ret"].dropna().to_numpy()
        most = min(int(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
        if most < 0:
            return pd.DataFrame({"symbol": [], "adf_stat": [], "lag": [], "is_stationary": []})
        dx = np.diff(x)

        def fit(lag: int, skip: int) -> tuple[float, float]:
            y = dx[skip:]
            m = np.column_stack([x[skip:-1], *(dx[skip - k : len(dx) - k] for k in range(1, lag + 1)), np.ones(len(y))])
            b, *_ = np.linalg.lstsq(m, y, rcond=None)
            ssr = float(((y - m @ b) ** 2).sum())
            cov = np.linalg.pinv(m.T @ m) * ssr / max(len(y) - m.shape[1], 1)
            return len(y) * math.log(max(ssr, 1e-300) / len(y)) + 2 * m.shape[1], float(b[0] / math.sqrt(cov[0, 0]))

        lag = min(range(most + 1), key=lambda k: fit(k, most)[0])
        stat = fit(lag, lag)[1]
        return pd.DataFrame({"symbol": [p["symbol"].iloc[0]], "adf_stat": [stat], "lag": [lag], "is_stationary": [stat < critical]})

    return returns.select("symbol", "trading_date", "log_ret").groupBy("symbol").applyInPandas(run, "symbol string, adf_stat double, lag int, is_stationary boolean").withColumn("adf_p", adf_p(F.col("adf_stat")))

"""Analytics across symbols: panels, pairs, sectors, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gram
from .distributions import incomplete_beta
from .risk import RISK_FREE, YEAR
from .timeseries import log_return


def panel_complete_case(prices: DataFrame) -> DataFrame:
    """Log returns over the dates on which every symbol has a close."""
    p = prices.where("close IS NOT NULL")
    n = p.select(F.count_distinct("symbol").alias("n"))
    dates = p.groupBy("trading_date").agg(F.count_distinct("symbol").alias("m"))
    whole = dates.join(F.broadcast(n), F.col("m") == F.col("n")).select("trading_date")  # one row
    return log_return(p.join(whole, "trading_date", "left_semi"))


def pair_self_join(returns: DataFrame, ordered: bool = False, keys: tuple[str, ...] = ("trading_date",)) -> DataFrame:
    """a, b, ra, rb by date; unordered pairs once, or both ways. The join is an equality on the date."""
    r = returns.where("log_ret IS NOT NULL")
    a, b = (r.select(*keys, F.col("symbol").alias(x), F.col("log_ret").alias(f"r{x}")) for x in "ab")
    return a.join(b, list(keys)).where(F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b"))


def _centred(returns: DataFrame, group: Column | None = None) -> DataFrame:
    """g, symbol, at and x for ``gram``: days, and returns less their symbol's mean, which changes no covariance but keeps digits."""
    g = F.lit(0) if group is None else group
    r = returns.where("log_ret IS NOT NULL").select(g.alias("g"), "symbol", F.unix_date("trading_date").alias("at"), "log_ret")
    return r.withColumn("x", F.col("log_ret") - F.avg("log_ret").over(Window.partitionBy("symbol"))).drop("log_ret")


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """Correlation, yearly covariance and common dates of every two symbols (a before b)."""
    return gram.gram(_centred(returns)).select("a", "b", gram.corr().alias("corr"), (gram.covar_samp() * YEAR).alias("cov"), F.col("n").cast("long").alias("n"))


def covariance(returns: DataFrame) -> DataFrame:
    """The whole matrix, both halves and the diagonal: a, b, cov of a year."""
    half = correlation_matrix(returns).select("a", "b", "cov")
    own = returns.where("log_ret IS NOT NULL").groupBy(F.col("symbol").alias("a")).agg((F.var_samp("log_ret") * YEAR).alias("cov"))
    both = half.select(F.inline(F.array(F.struct("a", "b", "cov"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))))
    return both.unionByName(own.select("a", F.col("a").alias("b"), "cov"))


def extreme_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k pairs with the highest and the k with the lowest correlation."""
    top = pairs.orderBy(F.desc("corr"), "a", "b").limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(pairs.orderBy("corr", "a", "b").limit(k).withColumn("side", F.lit("bottom")))


def pair_insights(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("corr").alias("avg_corr"), F.count_if(F.col("corr") > 0.7).alias("high_pairs"), F.count_if(F.col("corr") < 0.3).alias("low_pairs"))


def rolling_intra_corr(returns: DataFrame, size: int = 60, step: int = 20, last: int = 10) -> DataFrame:
    """Mean pair correlation of the ``size`` dates before each ``step``-th date; the last ones only.

    A date lies in few windows, so each row is dealt to the windows that hold it instead of a range join.
    """
    dates = returns.where("log_ret IS NOT NULL").select("trading_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trading_date")) - 1)
    many = dates.agg((F.max("i") + 1).alias("dates"))
    at = F.explode(F.expr(f"filter(sequence(cast(floor(i / {step}) as int), cast(floor((i + {size}) / {step}) as int)), w -> w * {step} > i and w * {step} <= i + {size} and w * {step} >= {size} and w * {step} < dates)"))
    dealt = dates.join(F.broadcast(many)).withColumn("w", at)
    r = returns.join(dealt.select("trading_date", "w"), "trading_date")
    pairs = gram.gram(_centred(r, F.col("w"))).select(F.col("g").alias("w"), gram.corr().alias("corr"))
    out = pairs.groupBy("w").agg(F.avg("corr").alias("avg_corr")).join(dates, F.col("w") * step == F.col("i"))
    return out.select(F.col("trading_date").alias("as_of"), "avg_corr").orderBy(F.desc("as_of")).limit(last)


def index_returns(index: DataFrame) -> DataFrame:
    """trading_date and index_ret of the index's own rows."""
    return index.select("trading_date", F.log(F.col("close") / F.lag("close").over(Window.orderBy("trading_date"))).alias("index_ret"))  # one row a date


def sector_index(returns: DataFrame, sectors: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Equal-weight daily returns of each industry, summed up over the time; with the index its correlation, and how many stocks rose."""
    r = returns.where("log_ret IS NOT NULL").join(sectors, "symbol")
    day = r.groupBy("industry", "trading_date").agg(F.avg("log_ret").alias("r"))
    a = day.groupBy("industry").agg((F.exp(F.sum("r")) - 1).alias("total_return"), (F.avg("r") * YEAR).alias("ann_return"), (F.stddev_samp("r") * YEAR**0.5).alias("ann_vol"))
    a = a.withColumn("sharpe", (F.col("ann_return") - RISK_FREE) / F.nullif(F.col("ann_vol"), F.lit(0.0)))
    if index is None:
        return a
    both = day.join(index_returns(index), "trading_date").where("index_ret IS NOT NULL").groupBy("industry").agg(F.when(F.count("*") > 10, F.corr("r", "index_ret")).alias("corr_index"))
    up = r.groupBy("industry", "symbol").agg(F.sum("log_ret").alias("s")).groupBy("industry").agg(F.count("*").alias("stocks"), F.avg((F.col("s") > 0).cast("double")).alias("stocks_up"))
    return a.join(both, "industry", "left").join(up, "industry")


def sector_analysis(returns: DataFrame, sectors: DataFrame, index: DataFrame) -> DataFrame:
    """Of each industry with two stocks or more: sessions, members, total return, beta, mean pair correlation with its label, and
    the yearly variance of its equal-weight portfolio in percent."""
    r = returns.where("log_ret IS NOT NULL").join(sectors, "symbol").join(index_returns(index).where("index_ret IS NOT NULL"), "trading_date")
    day = r.groupBy("industry", "trading_date", "index_ret").agg(F.avg("log_ret").alias("r"), F.count("*").alias("m"))
    a = day.groupBy("industry").agg(F.count("*").alias("sessions"), F.max("m").alias("members"), (F.exp(F.sum("r")) - 1).alias("total_return"), F.when(F.count("*") > 30, F.regr_slope("r", "index_ret")).alias("beta"), (F.var_samp("r") * YEAR * 100).alias("variance_pct"))
    c = gram.gram(_centred(r, F.col("industry"))).groupBy(F.col("g").alias("industry")).agg(F.avg(gram.corr()).alias("avg_corr"))
    x = F.col("avg_corr")
    return a.join(c, "industry").withColumn("label", F.when(x > 0.6, "HIGH co-movement").when(x > 0.3, "MODERATE").otherwise("LOW"))


def sector_stock_details(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Yearly return, volatility and share of the industry's equal-weight variance of each stock."""
    r = returns.where("log_ret IS NOT NULL").join(sectors, "symbol").withColumn("mean", F.avg("log_ret").over(Window.partitionBy("industry", "trading_date")))
    a = r.groupBy("industry", "symbol").agg((F.avg("log_ret") * YEAR).alias("ann_return"), (F.stddev_samp("log_ret") * YEAR**0.5).alias("ann_vol"), F.covar_samp("log_ret", "mean").alias("c"))
    return a.withColumn("risk_pct", F.col("c") / F.sum("c").over(Window.partitionBy("industry")) * 100).drop("c")


def breadth(returns: DataFrame) -> DataFrame:
    """Share of symbols with a positive sum of returns, and the mean return."""
    each = returns.where("log_ret IS NOT NULL").groupBy("symbol").agg(F.sum("log_ret").alias("s"))
    return each.agg(F.avg((F.col("s") > 0).cast("double")).alias("advancing"), F.avg("s").alias("mean_return"), F.count("*").alias("symbols"))


def sector_members(sectors: DataFrame) -> DataFrame:
    return sectors.groupBy("industry").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"))


def sector_peers(sectors: DataFrame) -> DataFrame:
    """symbol and each other symbol of its industry."""
    return sectors.join(sectors.select("industry", F.col("symbol").alias("peer")), "industry").where("symbol <> peer").select("symbol", "peer", "industry")


def peer_comparison(returns: DataFrame, sectors: DataFrame, index: DataFrame) -> DataFrame:
    """Yearly statistics of the panel's symbols, beta and correlation with the index, and their rank by Sharpe ratio in the industry."""
    r = returns.where("log_ret IS NOT NULL").join(index_returns(index).where("index_ret IS NOT NULL"), "trading_date")
    a = r.groupBy("symbol").agg((F.avg("log_ret") * YEAR).alias("ann_return"), (F.stddev_samp("log_ret") * YEAR**0.5).alias("ann_vol"), F.when(F.count("*") > 30, F.regr_slope("log_ret", "index_ret")).alias("beta"), F.corr("log_ret", "index_ret").alias("corr_index"))
    a = a.withColumn("sharpe", F.when(F.col("ann_vol") > 0, (F.col("ann_return") - RISK_FREE) / F.col("ann_vol")).otherwise(0.0)).join(sectors, "symbol")
    return a.withColumn("rank", F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("sharpe"), "symbol")))


def peer_correlations(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Correlation of each symbol with each peer of its industry, itself included at 1."""
    r = returns.where("log_ret IS NOT NULL").join(sectors, "symbol").select("industry", "trading_date", "symbol", "log_ret")
    half = gram.gram(_centred(r, F.col("industry"))).select("a", "b", gram.corr().alias("corr"))
    pairs = half.select(F.inline(F.array(F.struct(F.col("a").alias("symbol"), F.col("b").alias("peer"), "corr"), F.struct(F.col("b").alias("symbol"), F.col("a").alias("peer"), "corr"))))
    return pairs.unionByName(r.select("symbol", F.col("symbol").alias("peer"), F.lit(1.0).alias("corr")).distinct())


def tail_dependence(returns: DataFrame, q: float = 0.1) -> DataFrame:
    """Of each pair the share of dates on which both lie under their q quantile, and the correlation on days when either does."""
    # days that are no stress for a pair are those on which both lie above: stress is all days less these
    cuts = returns.groupBy("symbol").agg(F.percentile("log_ret", F.lit(q)).alias("cut"))
    low = returns.where("log_ret IS NOT NULL").join(cuts, "symbol").select("trading_date", "symbol", "log_ret", (F.col("log_ret") <= F.col("cut")).alias("low"))
    x = _centred(low).join(low.select("symbol", F.unix_date("trading_date").alias("at"), "low"), ["symbol", "at"])
    kinds = F.inline(F.array(F.struct(F.lit(0).alias("g"), "x"), F.struct(F.lit(1).alias("g"), F.when(~F.col("low"), F.col("x")).alias("x")), F.struct(F.lit(2).alias("g"), F.when(F.col("low"), F.col("x")).alias("x"))))
    sums = gram.gram(x.select("symbol", "at", kinds))
    of = lambda k: F.max(F.when(F.col("g") == k, F.struct(*gram.SUMS)))
    s = sums.groupBy("a", "b").agg(of(0).alias("all"), of(1).alias("calm"), of(2).alias("both"))
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    stress = lambda k: part(f"all.{k}") - part(f"calm.{k}")
    g = s.select("a", "b", (part("both.n") / F.col("all.n")).alias("joint"), gram.corr(lambda k: F.col(f"all.{k}")).alias("corr"), gram.corr(stress).alias("stress_corr"), F.round(stress("n")).cast("long").alias("stress_days"))
    return g.withColumn("warning", (F.col("stress_days") > 10) & (F.col("stress_corr") > F.col("corr") + 0.1))


def lead_lag(returns: DataFrame, most: int = 5) -> DataFrame:
    """Correlation of each pair (a before b) at its strongest lag, and the leader: a positive lag means that a leads b."""
    i = F.dense_rank().over(Window.partitionBy("symbol").orderBy("trading_date"))
    r = returns.where("log_ret IS NOT NULL").withColumn("at", i).withColumn("x", F.col("log_ret") - F.avg("log_ret").over(Window.partitionBy("symbol")))
    c = gram.gram(r.select(F.lit(0).alias("g"), "symbol", "at", "x"), most).select("a", "b", "lag", gram.corr().alias("corr"))
    first = F.struct(F.abs(F.round("corr", 12)), -F.col("lag"))
    best = c.groupBy("a", "b").agg(F.max_by("lag", first).alias("lag"), F.max_by("corr", first).alias("corr"))
    return best.withColumn("leader", F.when(F.col("lag") > 0, F.col("a")).when(F.col("lag") < 0, F.col("b")).otherwise("simultaneous"))


def contagion_summary(granger_pairs: DataFrame, lags: DataFrame, tails: DataFrame) -> DataFrame:
    """How many causal links are significant, how many pairs have a leader, and how many warn of crashing together."""
    g = granger_pairs.agg(F.count("*").alias("tested"), F.count_if("significant").alias("significant"))
    l = lags.agg(F.count("*").alias("pairs"), F.count_if(F.col("lag") != 0).alias("with_leader"))  # noqa: E741
    t = tails.agg(F.count_if("warning").alias("warnings"))
    return g.join(F.broadcast(l)).join(F.broadcast(t))  # one row each


def equal_weights(returns: DataFrame) -> DataFrame:
    s = returns.select("symbol").distinct()
    return s.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy()))


def checked_weights(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """``weights`` (symbol, weight), if they cover the symbols and sum to one within a hundredth."""
    total, n, missing = weights.agg(F.sum("weight"), F.count("*")).first()[0], weights.count(), returns.select("symbol").distinct().join(weights, "symbol", "left_anti").isEmpty()
    if not missing or n != returns.select("symbol").distinct().count() or abs(total - 1) > 0.01:
        raise ValueError("weights are to cover every symbol and to sum to 1")
    return weights


def risk_contribution(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each symbol in the portfolio's variance."""
    cov = covariance(returns)
    wa, wb = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("wa")), weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    part = cov.join(wa, "a").join(wb, "b").groupBy(F.col("a").alias("symbol")).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("part"))
    return part.withColumn("contribution", F.col("part") / F.sum("part").over(Window.partitionBy())).drop("part").join(weights, "symbol")


def portfolio_stats(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Annual return, volatility, Sharpe ratio and 95 % value at risk of the portfolio."""
    mean = returns.groupBy("symbol").agg((F.avg("log_ret") * YEAR).alias("mu")).join(weights, "symbol").agg(F.sum(F.col("mu") * F.col("weight")).alias("ann_return"))
    cov = covariance(returns)
    wa, wb = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("wa")), weights.select(F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    var = cov.join(wa, "a").join(wb, "b").agg(F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("cov"))).alias("ann_vol"))
    out = mean.join(F.broadcast(var))  # one row beside one row
    return out.withColumn("sharpe", (F.col("ann_return") - RISK_FREE) / F.col("ann_vol")).withColumn("var_95", F.col("ann_return") - 1.645 * F.col("ann_vol"))


def portfolio_points(returns: DataFrame, many: int = 2000, seed: int = 42) -> DataFrame:
    """Yearly return, volatility and Sharpe ratio of candidate portfolios over all symbols: candidate, weights (in the order of
    the symbols), ann_return, ann_vol, sharpe.

    Candidates are equal weights, each symbol alone, and ``many`` points of the simplex drawn by hash (exponential
    variates over their sum). A candidate is one row; the panel's means and covariances are one row of arrays, whose
    size goes with the square of the number of symbols, and which is sent to the candidates.
    """
    mu = returns.where("log_ret IS NOT NULL").groupBy("symbol").agg((F.avg("log_ret") * YEAR).alias("mu"))
    row = covariance(returns).where("cov IS NOT NULL").groupBy(F.col("a").alias("symbol")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "cov"))), lambda x: x["cov"]).alias("cov"))
    model = mu.join(row, "symbol").agg(F.sort_array(F.collect_list(F.struct("symbol", "mu", "cov"))).alias("m")).where(F.size("m") > 0)
    m = model.select(F.col("m.symbol").alias("symbols"), F.col("m.mu").alias("mu"), F.col("m.cov").alias("cov"))
    n = F.size("symbols")
    u = lambda i, s: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), s)), 1, 10), 16, 10).cast("double") + 1) / float(16**10 + 1)
    i, drawn = F.col("i"), F.transform("symbols", lambda s: -F.log(u(F.col("i"), s)))
    p = m.withColumn("i", F.explode(F.sequence(F.lit(0), many + n))).withColumn("e", F.when(i == 0, F.transform("symbols", lambda s: F.lit(1.0))).when(i <= many, drawn).otherwise(F.transform("symbols", lambda s, k: (k == i - many - 1).cast("double"))))
    total = F.aggregate("e", F.lit(0.0), lambda x, y: x + y)
    name = F.when(i == 0, "equal").when(i <= many, F.format_string("r%06d", "i")).otherwise(F.concat(F.lit("one "), F.get("symbols", i - many - 1)))
    p = p.select(name.alias("candidate"), F.transform("e", lambda x: x / total).alias("weights"), "mu", "cov")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = p.withColumn("ann_return", dot("weights", "mu")).withColumn("ann_vol", F.sqrt(dot("weights", F.transform("cov", lambda r: dot("weights", r)))))
    return p.withColumn("sharpe", (F.col("ann_return") - RISK_FREE) / F.nullif(F.col("ann_vol"), F.lit(0.0))).select("candidate", "weights", "ann_return", "ann_vol", "sharpe")


def portfolio_search(points: DataFrame) -> DataFrame:
    """The candidates with the least volatility and with the best Sharpe ratio; no row without candidates."""
    row = F.struct("candidate", "ann_return", "ann_vol", "sharpe")
    best = points.agg(F.min_by(row, F.struct(F.round("ann_vol", 10), "candidate")).alias("a"), F.min_by(row, F.struct(-F.round("sharpe", 10), "candidate")).alias("b"))
    each = F.array(F.struct(F.lit("min_variance").alias("goal"), F.col("a").alias("x")), F.struct(F.lit("max_sharpe").alias("goal"), F.col("b").alias("x")))
    return best.select(F.inline(each)).where("x IS NOT NULL").select("goal", "x.*")


def efficient_frontier(points: DataFrame, steps: int = 10) -> DataFrame:
    """The least volatility at or above each of ``steps`` even target returns from the lowest to the highest candidate's."""
    ends = points.agg(F.min("ann_return").alias("low"), F.max("ann_return").alias("high"))
    at = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    t = points.join(F.broadcast(ends)).withColumn("step", at).withColumn("target", F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / (steps - 1))  # one row
    return t.where(F.round("ann_return", 12) >= F.round("target", 12)).groupBy("step", "target").agg(F.min("ann_vol").alias("ann_vol"))


def granger(returns: DataFrame, max_lag: int = 5) -> DataFrame:
    """Granger causality of every ordered pair: the lag with the smallest p value of the F test on squared residuals.

    A group is one pair's dates; pairs of fewer than max_lag + 30 dates give no row.
    """
    import numpy as np
    import pandas as pd

    def test(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("trading_date")
        y, x = p["rb"].to_numpy(), p["ra"].to_numpy()
        best = None
        if len(y) >= max_lag + 30:
            for lag in range(1, max_lag + 1):
                past = lambda v: np.stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)], 1)  # noqa: B023, E731
                target, one = y[lag:], np.ones((len(y) - lag, 1))
                short, long = np.hstack([one, past(y)]), np.hstack([one, past(y), past(x)])
                ssr = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (short, long)]
                free = len(target) - 2 * lag - 1
                f = (ssr[0] - ssr[1]) / lag / (ssr[1] / free)
                pv = 1 - incomplete_beta(lag / 2, free / 2, lag * f / (lag * f + free))
                best = min(best or (2.0, 0, 0.0), (pv, lag, f))
        if best is None:
            return pd.DataFrame({"cause": [], "effect": [], "lag": [], "f": [], "p": []})
        return pd.DataFrame({"cause": [p["a"].iloc[0]], "effect": [p["b"].iloc[0]], "lag": [best[1]], "f": [best[2]], "p": [best[0]]})

    pairs = pair_self_join(returns, ordered=True)
    return pairs.groupBy("a", "b").applyInPandas(test, "cause string, effect string, lag int, f double, p double").withColumn("significant", F.col("p") < 0.05)

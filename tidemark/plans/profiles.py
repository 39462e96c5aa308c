"""Registered queries that join several reports, and tests of distributions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as di
from ..operators import risk, strategy
from ..operators import text as tx
from ..operators import timeseries as ts
from ..operators import vectors as ve
from ..sources import tables
from . import market, texts
from .market import PRICES, rounded

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _returns(spark, sf):
    return ts.log_return(tables.prices(spark, sf))


@query(f"WITH {PRICES}, {market.T_FIT} SELECT symbol, dof, round(scale, 6) AS scale, round(mean, 6) + 0.0 AS mean, round(log_lik, 3) AS log_lik FROM tb")
def student_t_dof(spark, sf):
    return rounded(di.student_t(_returns(spark, sf))).withColumn("log_lik", F.round("log_lik", 3))


@query()
def ks_normal(spark, sf):
    return rounded(di.ks_normal(_returns(spark, sf)))


@query()
def adf_stationarity(spark, sf):
    return rounded(di.adf(_returns(spark, sf)))


@query(f"""WITH RECURSIVE {market.SIGNALS}, bt AS ({'WITH ' + market._backtest_sql('sig', 'symbol, strategy')}), risk AS ({market.SQL['risk_report']}), ed AS ({market.SQL['eda_report']}),
best AS (SELECT symbol, strategy AS best_strategy, sharpe AS best_sharpe FROM bt WHERE strategy <> 'BH' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, strategy) = 1), hold AS (SELECT symbol, total_return AS hold_return FROM bt WHERE strategy = 'BH')
SELECT ed.symbol, n, ann_return, ann_vol, skew, kurtosis, jb_stat, ed.sharpe, beta, alpha, r2, kind, var_hist, cvar_hist, var_t, loss_hist, risk.max_drawdown, best_strategy, best_sharpe, hold_return FROM ed JOIN risk USING (symbol) JOIN best USING (symbol) JOIN hold USING (symbol)""")
def full_analysis(spark, sf):
    """One row for each symbol: returns, market model, risk, and the best strategy beside buy and hold."""
    m = market.backtest_report(spark, sf)
    best = strategy.best_strategy(m).select("symbol", F.col("strategy").alias("best_strategy"), F.col("sharpe").alias("best_sharpe"))
    hold = m.where("strategy = 'BH'").select("symbol", F.col("total_return").alias("hold_return"))
    eda = market.eda_report(spark, sf).select("symbol", "n", "ann_return", "ann_vol", "skew", "kurtosis", "jb_stat", "sharpe", "beta", "alpha", "r2", "kind")
    risks = market.risk_report(spark, sf).select("symbol", "var_hist", "cvar_hist", "var_t", "loss_hist", "max_drawdown")
    return eda.join(risks, "symbol").join(best, "symbol").join(hold, "symbol")


@query()
def distribution_tests(spark, sf):
    """Jarque-Bera, Kolmogorov-Smirnov and Dickey-Fuller tests and the Student-t fit of each symbol's returns."""
    r = _returns(spark, sf)
    jb = risk.return_stats(r).select("symbol", "jb_stat", "jb_p", "is_normal")
    return rounded(jb.join(di.ks_normal(r).select("symbol", "ks_stat", "ks_p"), "symbol").join(di.adf(r), "symbol").join(di.student_t(r).select("symbol", "dof"), "symbol"))


@query(f"""WITH {PRICES}, a AS (SELECT symbol, count(log_ret) AS n, avg(log_ret) * 252 AS m, stddev_samp(log_ret) * sqrt(252) AS v, arg_max(close, trading_date) AS last FROM r GROUP BY symbol)
SELECT symbol, 'analysis' AS doc_type, 'Symbol ' || symbol || ' over ' || n || ' sessions: return ' || printf('%.3f', m) || ', volatility ' || printf('%.3f', v) || ', close ' || printf('%.3f', last) || '.' AS content FROM a""")
def stock_profile_docs(spark, sf):
    a = _returns(spark, sf).groupBy("symbol").agg(F.count("log_ret").alias("n"), (F.avg("log_ret") * 252).alias("m"), (F.stddev_samp("log_ret") * 252**0.5).alias("v"), F.max_by("close", "trading_date").alias("last"))
    return a.select("symbol", F.lit("analysis").alias("doc_type"), F.format_string("Symbol %s over %d sessions: return %.3f, volatility %.3f, close %.3f.", "symbol", "n", "m", "v", "last").alias("content"))


@query(f"WITH {texts.NEWS}, s AS (SELECT news_id, ({texts._found(['that', 'with', 'this', 'from'])}) >= 2 OR (regexp_matches(lower(text), '[0-9]+ ?(mw|gw|%)') AND contains(lower(text), 'the')) AS positive FROM news) SELECT positive, count(*) AS n FROM s GROUP BY positive")
def weak_labels(spark, sf):
    t = F.lower("text")
    strong = tx.found(F.col("text"), ["that", "with", "this", "from"]) >= 2
    n = tables.news(spark, sf).select((strong | (t.rlike("[0-9]+ ?(mw|gw|%)") & F.contains(t, F.lit("the")))).alias("positive"))
    return n.groupBy("positive").agg(F.count("*").alias("n"))


@query(f"WITH {texts.NEWS} SELECT round(avg({texts._dens(['die', 'der'])}), 9) AS density, count(*) FILTER ({texts._m(['die', 'der'])} > 0) AS matched FROM news")
def custom_theme_match(spark, sf):
    t = F.col("text")
    return tables.news(spark, sf).agg(F.round(F.avg(tx.keyword_density(t, ["die", "der"])), 9).alias("density"), F.count_if(tx.matches(t, ["die", "der"]) > 0).alias("matched"))


METHOD = "SELECT '{}' AS method, count(*) FILTER (x AND quality = 1) AS tp, count(*) FILTER (x AND quality <> 1) AS fp, count(*) FILTER (NOT x AND quality = 1) AS fn, count(*) FILTER (NOT x AND quality <> 1) AS tn FROM (SELECT quality, {} AS x FROM news JOIN y USING (news_id))"


@query(f"WITH {texts.NEWS}, y AS (SELECT doc_id AS news_id, max(quality) AS quality FROM labels GROUP BY 1) " + " UNION ALL ".join([METHOD.format("density", f"{texts._dens(texts.WORDS)} > 0.002"), METHOD.format("presence", f"least({texts._found(texts.WORDS)} / 3, 1.0) > 0.5"), METHOD.format("matches", f"least({texts._m(texts.WORDS)} / 3, 1.0) > 0.5")]))
def method_comparison(spark, sf):
    d, t = texts._labelled(spark, sf), F.col("text")
    rules = {"density": tx.keyword_density(t, texts.WORDS) > 0.002, "presence": tx.keyword_presence(t, texts.WORDS) > 0.5, "matches": tx.keyword_match(t, texts.WORDS) > 0.5}
    each = d.select("quality", F.inline(F.array(*(F.struct(F.lit(k).alias("method"), x.alias("x")) for k, x in rules.items()))))
    return tx.classification_metrics(each, F.col("x"), F.col("quality") == 1, ("method",)).select("method", "tp", "fp", "fn", "tn")


@query(f"WITH {texts.VEC}, b AS (SELECT id, ({texts.BUCKET}) AS bucket FROM v) SELECT bucket, count(*) AS n, min(id) AS first, max(id) AS last FROM b GROUP BY bucket")
def bucket_contents(spark, sf):
    return texts.lsh_build(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query()
def replicate_vectors(spark, sf):
    """Each vector four times, with a little hash noise and length one: a larger corpus for scale tests."""
    v = texts._vectors(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    noisy = v.select((F.col("id") * 4 + F.col("copy")).alias("id"), F.transform("v", lambda x, i: x + (F.pmod(F.xxhash64(i, F.col("id"), F.col("copy")), F.lit(1000)) / 1000 - 0.5) * 1e-3).alias("v"))
    return noisy.select("id", F.posexplode(ve.l2_normalize(F.col("v"))).alias("i", "x")).groupBy("id").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("length"))


@query("SELECT r_name, n_name, count(*) AS assets, round(avg(s_acctbal), 4) AS mean_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def class_distribution(spark, sf):
    s, n, r = (tables.table(spark, sf, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("assets"), F.round(F.avg("s_acctbal"), 4).alias("mean_balance"))


@query("WITH c AS (SELECT DISTINCT conv_id, role FROM conversations), k AS (SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations GROUP BY conv_id) SELECT turns, count(*) AS conversations, max(longest) AS longest FROM k GROUP BY turns")
def conversation_profile(spark, sf):
    c = tables.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"))
    return c.groupBy("turns").agg(F.count("*").alias("conversations"), F.max("longest").alias("longest"))

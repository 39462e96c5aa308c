"""Registered queries over the price panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crosssection as cs
from ..operators import distributions as di
from ..operators import risk, strategy
from ..operators import timeseries as ts
from ..sources import tables

PRICES = """
px AS (SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trading_date, 100 + l_extendedprice / 1000 AS px, l_quantity, l_orderkey, l_linenumber FROM lineitem),
prices AS (SELECT symbol, trading_date, arg_min(px, ROW(l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low, avg(px) AS close, sum(l_quantity) AS volume FROM px GROUP BY symbol, trading_date),
idx AS (SELECT trading_date, avg(px) AS index_close FROM px GROUP BY trading_date),
r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date)) AS log_ret FROM prices)
"""
PANEL = f"""{PRICES},
days AS (SELECT trading_date FROM prices GROUP BY trading_date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM prices)),
p AS (SELECT symbol, trading_date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date)) AS log_ret FROM prices SEMI JOIN days USING (trading_date)),
pr AS (SELECT trading_date, a.symbol AS a, b.symbol AS b, a.log_ret AS ra, b.log_ret AS rb FROM p a JOIN p b USING (trading_date) WHERE a.symbol < b.symbol AND a.log_ret IS NOT NULL AND b.log_ret IS NOT NULL)
"""
COV = f"""{PANEL},
half AS (SELECT a, b, covar_samp(ra, rb) * 252 AS cov FROM pr GROUP BY a, b),
cov AS (SELECT a, b, cov FROM half UNION ALL SELECT b, a, cov FROM half UNION ALL SELECT symbol, symbol, var_samp(log_ret) * 252 FROM p WHERE log_ret IS NOT NULL GROUP BY symbol),
mu AS (SELECT symbol, avg(log_ret) * 252 AS mu FROM p GROUP BY symbol)
"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; negative zero becomes zero."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return tables.prices(spark, sf)


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return cs.panel_complete_case(_prices(spark, sf))


@query(f"WITH {PRICES} SELECT symbol, trading_date, round(open, 10) AS open, round(high, 10) AS high, round(low, 10) AS low, round(close, 10) AS close, volume, round(log_ret, 10) AS log_ret, count(*) OVER (PARTITION BY symbol) AS sessions FROM r")
def price_history(spark, sf):
    return rounded(ts.log_return(_prices(spark, sf)).withColumn("sessions", F.count("*").over(Window.partitionBy("symbol"))), 10)


ROLL = "OVER (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_n = lambda n: ROLL.format(n - 1)
_full = lambda n, x, of: f"CASE WHEN count({of}) {_n(n)} = {n} THEN {x} {_n(n)} END"
_lag = lambda x, n=1: f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY trading_date)"


@query(f"""WITH {PRICES}, a AS (SELECT symbol, trading_date, close, {_full(20, 'avg(close)', 'close')} AS m, {_full(20, 'stddev_pop(close)', 'close')} AS d FROM prices)
SELECT symbol, trading_date, round(m, 10) AS bb_mid, round(m + 2 * d, 10) AS bb_upper, round(m - 2 * d, 10) AS bb_lower, round((close - (m - 2 * d)) / nullif(4 * d, 0), 10) AS bb_pct, round(nullif(4 * d, 0) / m * 100, 10) AS bb_width FROM a""")
def bollinger_bands(spark, sf):
    return rounded(ts.bollinger(_prices(spark, sf)).select("symbol", "trading_date", "bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width"), 10)


@query(f"""WITH {PRICES}, a AS (SELECT *, {_full(14, 'min(low)', 'low')} AS lo, {_full(14, 'max(high)', 'high')} AS hi, {_lag('close', 10)} AS c10 FROM prices),
b AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k, -100 * (hi - close) / nullif(hi - lo, 0) AS wr FROM a)
SELECT symbol, trading_date, round(k, 6) AS stoch_k, round({_full(3, 'avg(k)', 'k')}, 6) AS stoch_d, round(wr, 6) + 0.0 AS williams_r, round((close - c10) / c10 * 100, 6) AS roc_10 FROM b""")
def stochastic_momentum(spark, sf):
    return rounded(ts.roc(ts.stochastic(_prices(spark, sf))).select("symbol", "trading_date", "stoch_k", "stoch_d", "williams_r", "roc_10"))


@query(f"""WITH {PRICES}, a AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN close < {_lag('close')} THEN -volume ELSE volume END AS sv FROM prices),
b AS (SELECT *, tp * volume * CASE WHEN tp > {_lag('tp')} THEN 1 WHEN tp < {_lag('tp')} THEN -1 ELSE 0 END AS flow FROM a),
c AS (SELECT *, sum(CASE WHEN flow > 0 THEN flow ELSE 0 END) {_n(14)} AS plus, sum(CASE WHEN flow < 0 THEN -flow ELSE 0 END) {_n(14)} AS minus, count(*) {_n(14)} AS n FROM b)
SELECT symbol, trading_date, sum(sv) OVER (PARTITION BY symbol ORDER BY trading_date) AS obv, round(CASE WHEN n = 14 THEN CASE WHEN minus = 0 THEN 100 ELSE 100 - 100 / (1 + plus / minus) END END, 6) AS mfi_14,
round({_full(20, 'avg(volume)', 'volume')}, 6) AS vol_ma20, round(volume / {_full(20, 'avg(volume)', 'volume')}, 6) AS vol_ratio FROM c""")
def volume_indicators(spark, sf):
    return rounded(ts.volume_ratio(ts.mfi(ts.obv(_prices(spark, sf)))).select("symbol", "trading_date", "obv", "mfi_14", "vol_ma20", "vol_ratio"))


@query(f"""WITH RECURSIVE {PRICES}, n AS (SELECT symbol, close, trading_date, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) AS i FROM prices),
e AS (SELECT symbol, i, trading_date, close, close AS e12, close AS e26, NULL::DOUBLE AS sig FROM n WHERE i = 1 UNION ALL
 SELECT n.symbol, n.i, n.trading_date, n.close, e12 + (n.close - e12) * (2.0::DOUBLE / 13), e26 + (n.close - e26) * (2.0::DOUBLE / 27),
 CASE WHEN n.i < 26 THEN NULL WHEN n.i = 26 THEN (e12 + (n.close - e12) * (2.0::DOUBLE / 13)) - (e26 + (n.close - e26) * (2.0::DOUBLE / 27)) ELSE sig + (((e12 + (n.close - e12) * (2.0::DOUBLE / 13)) - (e26 + (n.close - e26) * (2.0::DOUBLE / 27))) - sig) * (2.0::DOUBLE / 10) END
 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, trading_date, round(CASE WHEN i >= 12 THEN e12 END, 6) AS ema_12, round(CASE WHEN i >= 26 THEN e26 END, 6) AS ema_26, round(CASE WHEN i >= 26 THEN e12 - e26 END, 6) + 0.0 AS macd, round(CASE WHEN i >= 34 THEN sig END, 6) + 0.0 AS macd_signal FROM e""")
def ema_macd(spark, sf):
    df = ts.recurrences(_prices(spark, sf)).na.replace(float("nan"), None)
    return rounded(df.select("symbol", "trading_date", "ema_12", "ema_26", "macd", "macd_signal"))


#: EMA, RSI, ATR and ADX by recursion over each symbol's rows, and the windows beside them.
_step = lambda e, n: f"{e} + (n.close - {e}) * (2.0::DOUBLE / {n + 1})"
_wilder = lambda e, x: f"CASE WHEN n.i < 14 THEN 0 WHEN n.i = 14 THEN n.{x}14 ELSE ({e} * 13 + n.{x}) / 14 END"
_macd = f"(({_step('e12', 12)}) - ({_step('e26', 26)}))"
_dx = f"CASE WHEN n.i >= 14 AND ({_wilder('atr', 'tr')}) > 0 AND ({_wilder('pdm', 'pd')}) + ({_wilder('ndm', 'nd')}) > 0 THEN 100 * abs(({_wilder('pdm', 'pd')}) - ({_wilder('ndm', 'nd')})) / (({_wilder('pdm', 'pd')}) + ({_wilder('ndm', 'nd')})) ELSE 0 END"
IND = f"""{PRICES},
b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) AS i, {_lag('close')} AS pc, high - {_lag('high')} AS rise, {_lag('low')} - low AS fall FROM prices),
b1 AS (SELECT *, greatest(coalesce(close - pc, 0), 0) AS up, greatest(coalesce(pc - close, 0), 0) AS dn, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high, pc) - least(low, pc) END AS tr, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END AS pd, CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END AS nd FROM b0),
b2 AS (SELECT *, avg(tr) {_n(14)} AS tr14, avg(pd) {_n(14)} AS pd14, avg(nd) {_n(14)} AS nd14 FROM b1),
rec AS (SELECT symbol, i, close AS e9, close AS e12, close AS e21, close AS e26, close AS e50, close AS e200, NULL::DOUBLE AS sig, up AS u, dn AS d, 0::DOUBLE AS atr, 0::DOUBLE AS pdm, 0::DOUBLE AS ndm, 0::DOUBLE AS dxs, 0::DOUBLE AS adx FROM b2 WHERE i = 1 UNION ALL
 SELECT n.symbol, n.i, {_step('e9', 9)}, {_step('e12', 12)}, {_step('e21', 21)}, {_step('e26', 26)}, {_step('e50', 50)}, {_step('e200', 200)},
 CASE WHEN n.i < 26 THEN NULL WHEN n.i = 26 THEN {_macd} ELSE sig + ({_macd} - sig) * (2.0::DOUBLE / 10) END, u + (n.up - u) * (1.0::DOUBLE / 14), d + (n.dn - d) * (1.0::DOUBLE / 14),
 {_wilder('atr', 'tr')}, {_wilder('pdm', 'pd')}, {_wilder('ndm', 'nd')}, dxs + {_dx}, CASE WHEN n.i < 27 THEN 0 WHEN n.i = 27 THEN (dxs + {_dx}) / 14 ELSE (adx * 13 + {_dx}) / 14 END
 FROM rec JOIN b2 n ON n.symbol = rec.symbol AND n.i = rec.i + 1),
w0 AS (SELECT *, ln(close / pc) AS log_ret, avg(close) {_n(20)} AS sma_20, stddev_pop(close) {_n(20)} AS dev, min(low) {_n(14)} AS lo, max(high) {_n(14)} AS hi, {_lag('close', 10)} AS c10, avg(volume) {_n(20)} AS vol_ma20, (high + low + close) / 3 AS tp, CASE WHEN close < pc THEN -volume ELSE volume END AS sv FROM b0),
w1 AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k, tp * volume * CASE WHEN tp > {_lag('tp')} THEN 1 WHEN tp < {_lag('tp')} THEN -1 ELSE 0 END AS flow FROM w0),
w2 AS (SELECT *, {_full(3, 'avg(stoch_k)', 'stoch_k')} AS stoch_d, sum(sv) OVER (PARTITION BY symbol ORDER BY trading_date) AS obv, sum(CASE WHEN flow > 0 THEN flow ELSE 0 END) {_n(14)} AS plus, sum(CASE WHEN flow < 0 THEN -flow ELSE 0 END) {_n(14)} AS minus FROM w1),
ind AS (SELECT symbol, trading_date, log_ret, close, e9 AS ema_9, e21 AS ema_21, e50 AS ema_50, e200 AS ema_200, sma_20, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_diff, adx, CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END AS rsi_14, stoch_k, stoch_d,
 (close - c10) / nullif(c10, 0) * 100 AS roc_10, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r, sma_20 + 2 * dev AS bb_upper, sma_20 - 2 * dev AS bb_lower, sma_20 AS bb_mid, (close - (sma_20 - 2 * dev)) / nullif(4 * dev, 0) AS bb_pct, nullif(4 * dev, 0) / nullif(sma_20, 0) * 100 AS bb_width, atr AS atr_14, obv,
 CASE WHEN minus = 0 THEN 100 ELSE 100 - 100 / (1 + plus / minus) END AS mfi_14, volume / nullif(vol_ma20, 0) AS vol_ratio FROM w2 JOIN rec USING (symbol, i) WHERE i >= 200 AND stoch_k IS NOT NULL AND stoch_d IS NOT NULL AND log_ret IS NOT NULL AND dev > 0 AND c10 <> 0 AND vol_ma20 <> 0)
"""


@query(f"WITH RECURSIVE {IND} SELECT symbol, trading_date, round(log_ret, 6) + 0.0 AS log_ret, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ts.INDICATORS)} FROM ind")
def technical_indicators(spark, sf):
    return rounded(ts.technical_indicators(_prices(spark, sf)))


@query(f"""WITH RECURSIVE {IND}, l AS (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) = 1)
SELECT symbol, trading_date, round(close, 6) AS close, round(macd, 6) + 0.0 AS macd, round(macd_signal, 6) + 0.0 AS macd_signal, round(rsi_14, 6) AS rsi_14, CASE WHEN macd > macd_signal AND rsi_14 < 65 THEN 'BUY' WHEN macd < macd_signal AND rsi_14 > 60 THEN 'SELL' ELSE 'HOLD' END AS signal FROM l""")
def signal_latest(spark, sf):
    return rounded(ts.signal_latest(ts.technical_indicators(_prices(spark, sf))))


T_FIT = f"""tm AS (SELECT symbol, avg(log_ret) AS mu, stddev_samp(log_ret) AS sd FROM r WHERE log_ret IS NOT NULL GROUP BY symbol),
tg AS (SELECT *, k / 100.0::DOUBLE AS f FROM (VALUES {', '.join(f'({n}, {di.t_constant(n)!r}::DOUBLE, {di.t_quantile(0.05, n)!r}::DOUBLE)' for n in di.GRID)}) t(dof, c, q) CROSS JOIN (SELECT unnest({list(di.SCALES)}) AS k)),
tl AS (SELECT r.symbol, mu, sd * f AS scale, dof, k, q, sum(c - ln(sd * f) - (dof + 1) / 2 * ln(1 + ((log_ret - mu) / sd / f) ** 2 / dof)) AS ll FROM r JOIN tm USING (symbol) CROSS JOIN tg WHERE log_ret IS NOT NULL GROUP BY ALL),
tb AS (SELECT symbol, dof, scale, mu AS mean, q, ll AS log_lik FROM tl QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(ll, 6) DESC, dof, k) = 1)"""


@query(f"""WITH {PRICES}, d AS (SELECT symbol, trading_date, close, max(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS peak FROM prices),
low AS (SELECT symbol, arg_min(ROW(close / peak - 1, trading_date, peak, close), ROW(close / peak - 1, trading_date)) AS x FROM d GROUP BY symbol),
v AS (SELECT symbol, quantile_cont(log_ret, 0.05) AS var_hist, avg(log_ret) AS mu, stddev_samp(log_ret) AS sd, skewness(log_ret) AS s, kurtosis(log_ret) AS k FROM r WHERE log_ret IS NOT NULL GROUP BY symbol),
t AS (SELECT r.symbol, avg(log_ret) AS cvar_hist FROM r JOIN v USING (symbol) WHERE log_ret <= var_hist GROUP BY r.symbol), {T_FIT},
tv AS (SELECT symbol, mean + scale * q AS var_t FROM tb), tc AS (SELECT r.symbol, max(var_t) AS var_t, avg(log_ret) FILTER (log_ret <= var_t) AS cvar_t FROM r JOIN tv USING (symbol) GROUP BY r.symbol),
ro AS (SELECT symbol, trading_date, CASE WHEN count(log_ret) {_n(60)} = 60 THEN quantile_cont(log_ret, 0.05) {_n(60)} END AS x FROM r), rl AS (SELECT symbol, arg_max(x, trading_date) FILTER (x IS NOT NULL) AS rolling_var FROM ro GROUP BY symbol)
SELECT v.symbol, round(var_hist, 6) AS var_hist, round(cvar_hist, 6) AS cvar_hist, round(mu - 1.6448536269514722 * sd, 6) AS var_normal, round(mu - sd * 0.10313564037537139 / 0.05, 6) AS cvar_normal,
round(mu + sd * (-1.6448536269514722 + (1.6448536269514722 ** 2 - 1) * s / 6 + (-(1.6448536269514722 ** 3) + 3 * 1.6448536269514722) * k / 24 - (-2 * 1.6448536269514722 ** 3 + 5 * 1.6448536269514722) * s * s / 36), 6) AS var_cf,
round(var_t, 6) AS var_t, round(cvar_t, 6) AS cvar_t, round(rolling_var, 6) AS rolling_var,
round(abs(var_hist) * 1e8, 2) AS loss_hist, round(abs(cvar_hist) * 1e8, 2) AS loss_cvar, round(x[1], 6) AS max_drawdown, x[2] AS max_dd_date, round(x[3], 6) AS peak, round(x[4], 6) AS trough FROM v JOIN t USING (symbol) JOIN low USING (symbol) JOIN tc USING (symbol) JOIN rl USING (symbol)""")
def risk_report(spark, sf):
    return rounded(risk.risk_report(_prices(spark, sf)).withColumns({c: F.round(c, 2) for c in ("loss_hist", "loss_cvar")}))


EDA = f"""{PRICES}, ln0 AS (SELECT symbol, trading_date, close, log_ret, index_close FROM r LEFT JOIN idx USING (trading_date) WHERE log_ret IS NOT NULL),
j0 AS (SELECT *, ln(index_close / {_lag('index_close')}) AS index_ret FROM ln0), j AS (SELECT * FROM j0 WHERE index_ret IS NOT NULL),
mo AS (SELECT symbol, avg((log_ret - m) ** 3) / (avg((log_ret - m) ** 2) ** 1.5) AS g FROM j JOIN (SELECT symbol, avg(log_ret) AS m FROM j GROUP BY symbol) USING (symbol) GROUP BY symbol),
dd AS (SELECT symbol, min(close / peak - 1) AS max_drawdown FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS peak FROM j) GROUP BY symbol),
a AS (SELECT symbol, count(log_ret) AS n, avg(log_ret) * 252 AS m, stddev_samp(log_ret) * sqrt(252) AS v, skewness(log_ret) AS skew, kurtosis(log_ret) AS kurtosis, any_value(g) AS g, kurtosis_pop(log_ret) AS k, regr_slope(log_ret, index_ret) AS beta, regr_intercept(log_ret, index_ret) * 252 AS alpha, regr_r2(log_ret, index_ret) AS r2,
 avg(index_ret) * 252 AS im, stddev_samp(index_ret) * sqrt(252) AS iv FROM j JOIN mo USING (symbol) GROUP BY symbol),
eda AS (SELECT symbol, n, round(m, 6) AS ann_return, round(v, 6) AS ann_vol, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(n / 6 * (g * g + k * k / 4), 6) AS jb_stat, round((m - 0.045) / v, 6) AS sharpe, round(exp(-(n / 6 * (g * g + k * k / 4)) / 2), 6) AS jb_p, exp(-(n / 6 * (g * g + k * k / 4)) / 2) > 0.05 AS is_normal,
round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2, CASE WHEN beta > 1.2 THEN 'HIGH-BETA' WHEN beta > 0.8 THEN 'MARKET' ELSE 'DEFENSIVE' END AS kind, round(im, 6) AS index_ann_return, round(iv, 6) AS index_ann_vol, round((im - 0.045) / iv, 6) AS index_sharpe, round(max_drawdown, 6) AS max_drawdown FROM a JOIN dd USING (symbol))"""


@query(f"WITH {EDA} SELECT * FROM eda")
def eda_report(spark, sf):
    return rounded(risk.eda_report(_prices(spark, sf), tables.index_prices(spark, sf)))


@query(f"""WITH {PRICES} SELECT symbol, trading_date, round(CASE WHEN count(log_ret) {_n(60)} = 60 THEN quantile_cont(log_ret, 0.05) {_n(60)} END, 6) AS rolling_var FROM r""")
def rolling_var(spark, sf):
    return rounded(ts.rolling_var(ts.log_return(_prices(spark, sf))).select("symbol", "trading_date", "rolling_var"))


def _signals(spark, sf):
    return strategy.signals(ts.technical_indicators(_prices(spark, sf)))


SIGNALS = f"""{IND}, b AS (SELECT *, {_lag('ema_9')} AS l9, {_lag('ema_21')} AS l21, {_lag('ema_50')} AS l50, {_lag('macd')} AS lm, {_lag('macd_signal')} AS ls FROM ind),
s AS (SELECT symbol, trading_date, close, unnest([ROW('S1', CASE WHEN ema_9 > ema_21 AND l9 <= l21 THEN 1 WHEN ema_9 < ema_21 AND l9 >= l21 THEN -1 ELSE 0 END), ROW('S2', CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 ELSE 0 END),
 ROW('S3', CASE WHEN macd > macd_signal AND lm <= ls THEN 1 WHEN macd < macd_signal AND lm >= ls THEN -1 ELSE 0 END), ROW('S4', CASE WHEN rsi_14 > 70 OR (ema_21 < ema_50 AND l21 >= l50) THEN -1 WHEN ema_21 > ema_50 AND rsi_14 < 40 AND vol_ratio > 1 THEN 1 ELSE 0 END), ROW('BH', 1)]) AS x FROM b),
sig AS (SELECT symbol, trading_date, close, x[1] AS strategy, x[2] AS signal FROM s)"""


def _backtest_sql(source: str, keys: str, more: str = "") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY trading_date)"
    return f"""pos AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN CASE WHEN signal = 1 THEN 1 ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY trading_date ROWS UNBOUNDED PRECEDING), 0) AS position FROM {source}),
l AS (SELECT *, close / lag(close) {w} - 1 AS ret, lag(position) {w} AS held FROM pos),
net AS (SELECT *, abs(position - held) AS turn, held * ret - coalesce(abs(position - held), 0) * 0.0025 AS net FROM l),
eq AS (SELECT *, CASE WHEN net IS NOT NULL THEN exp(sum(ln(abs(1 + net))) {w}) * CASE WHEN sum(CASE WHEN 1 + net < 0 THEN 1 ELSE 0 END) {w} % 2 = 1 THEN -1 ELSE 1 END END AS e FROM net),
pk AS (SELECT *, max(e) {w} AS peak FROM eq),
m AS (SELECT {keys}, count(*) AS n, arg_max(e, trading_date) FILTER (e IS NOT NULL) - 1 AS total_return, stddev_samp(net) * sqrt(252) AS ann_vol, min(e / peak - 1) AS max_drawdown, sum(net) FILTER (net > 0) AS gain, -sum(net) FILTER (net < 0) AS loss, CAST(sum(coalesce(turn, 0)) AS BIGINT) AS trades FROM pk GROUP BY {keys}),
m2 AS (SELECT *, CASE WHEN total_return > -1 THEN (1 + total_return) ** (252.0::DOUBLE / n) - 1 ELSE -1 END AS ann_return FROM m)
SELECT {keys}, n, round(total_return, 6) AS total_return, round((total_return + 1) * 1e8, 2) AS final_equity, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(CASE WHEN ann_vol > 0 THEN (ann_return - 0.045) / ann_vol ELSE 0 END, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown,
round(CASE WHEN max_drawdown < 0 THEN ann_return / -max_drawdown ELSE 0 END, 6) AS calmar, round(coalesce(gain, 0) / loss, 6) AS profit_factor, trades FROM m2 {more}"""


@query(f"WITH RECURSIVE {SIGNALS}, {_backtest_sql('sig', 'symbol, strategy')}")
def backtest_report(spark, sf):
    return rounded(strategy.backtest(_signals(spark, sf)).withColumn("final_equity", F.round("final_equity", 2)))


@query(f"WITH RECURSIVE {SIGNALS}, {_backtest_sql('sig', 'symbol, strategy').split('m AS (')[0].rstrip().rstrip(',')} SELECT symbol, strategy, trading_date, position, round(e * 1e8, 2) AS equity FROM eq")
def equity_curve(spark, sf):
    return strategy.equity(strategy.position_state(_signals(spark, sf))).select("symbol", "strategy", "trading_date", "position", F.round("equity", 2).alias("equity"))


@query(f"WITH RECURSIVE {SIGNALS}, bs AS ({'WITH ' + _backtest_sql('sig', 'symbol, strategy')}) SELECT * FROM bs WHERE strategy <> 'BH' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, strategy) = 1")
def best_strategy(spark, sf):
    return strategy.best_strategy(backtest_report(spark, sf))


PERIODS = [("1995", "1995-01-01", "1995-12-31"), ("1996", "1996-01-01", "1996-12-31"), ("1997", "1997-01-01", "1997-12-31"), ("1998", "1998-01-01", "1998-12-31")]
WALK = f"""{IND}, per AS (SELECT * FROM (VALUES {', '.join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in PERIODS)}) t(period, s0, s1)), i0 AS (SELECT ind.*, period, macd - macd_signal AS x, lag(macd - macd_signal) OVER (PARTITION BY symbol, period ORDER BY trading_date) AS y FROM ind JOIN per ON trading_date BETWEEN s0 AND s1),
inside AS (SELECT symbol, period, trading_date, close, 'macd' AS strategy, CASE WHEN x > 0 AND y <= 0 THEN 1 WHEN x < 0 AND y >= 0 THEN -1 ELSE 0 END AS signal FROM i0 UNION ALL SELECT symbol, period, trading_date, close, 'bh', 1 FROM i0),
wf0 AS ({'WITH ' + _backtest_sql('inside', 'symbol, strategy, period', 'WHERE n >= 20')}),
wf AS (SELECT symbol, period, {', '.join(f"max({c}) FILTER (strategy = '{k}') AS {k}_{n}" for c, n in (('total_return', 'return'), ('sharpe', 'sharpe'), ('max_drawdown', 'max_dd')) for k in ('macd', 'bh'))} FROM wf0 GROUP BY symbol, period)"""


def _walk(spark, sf):
    periods = spark.createDataFrame(PERIODS, "period string, start string, end string").select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return rounded(strategy.walk_forward(ts.technical_indicators(_prices(spark, sf)), periods))


@query(f"WITH RECURSIVE {WALK} SELECT *, macd_return > bh_return AS macd_outperforms FROM wf")
def walk_forward(spark, sf):
    return _walk(spark, sf)


@query(f"WITH RECURSIVE {WALK} SELECT symbol, count(*) FILTER (macd_return > bh_return) AS wins, count(*) AS periods FROM wf GROUP BY symbol")
def walk_forward_wins(spark, sf):
    return strategy.walk_forward_wins(_walk(spark, sf))


@query(f"WITH {PANEL} SELECT a, b, round(corr(ra, rb), 6) AS corr, round(covar_samp(ra, rb) * 252, 6) AS cov, count(*) AS n FROM pr GROUP BY a, b")
def correlation_matrix(spark, sf):
    return rounded(cs.correlation_matrix(_panel(spark, sf)))


@query(f"WITH {PANEL}, c AS (SELECT a, b, round(corr(ra, rb), 6) AS corr FROM pr GROUP BY a, b) (SELECT a, b, corr, 'top' AS side FROM c ORDER BY corr DESC, a, b LIMIT 5) UNION ALL (SELECT a, b, corr, 'bottom' AS side FROM c ORDER BY corr, a, b LIMIT 5)")
def extreme_pairs(spark, sf):
    return cs.extreme_pairs(rounded(cs.correlation_matrix(_panel(spark, sf)).select("a", "b", "corr")))


@query(f"WITH {PANEL}, c AS (SELECT a, b, corr(ra, rb) AS corr FROM pr GROUP BY a, b) SELECT round(avg(corr), 6) + 0.0 AS avg_corr, count(*) FILTER (corr > 0.7) AS high_pairs, count(*) FILTER (corr < 0.3) AS low_pairs FROM c")
def pair_insights(spark, sf):
    return rounded(cs.pair_insights(cs.correlation_matrix(_panel(spark, sf))))


@query(f"""WITH {PANEL}, d AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS i FROM (SELECT DISTINCT trading_date FROM p WHERE log_ret IS NOT NULL)),
w AS (SELECT i AS hi, trading_date AS as_of FROM d WHERE i % 20 = 0 AND i >= 60),
c AS (SELECT as_of, a, b, corr(ra, rb) AS corr FROM pr JOIN d USING (trading_date) JOIN w ON d.i BETWEEN hi - 60 AND hi - 1 GROUP BY as_of, a, b)
SELECT as_of, round(avg(corr), 6) + 0.0 AS avg_corr FROM c GROUP BY as_of ORDER BY as_of DESC LIMIT 10""")
def rolling_intra_corr(spark, sf):
    return rounded(cs.rolling_intra_corr(_panel(spark, sf)))


SECTOR = "'I' || CAST(CAST(substr(symbol, 2) AS INT) % 3 AS VARCHAR)"


IRET = "ir AS (SELECT * FROM (SELECT trading_date, ln(index_close / lag(index_close) OVER (ORDER BY trading_date)) AS index_ret FROM idx) WHERE index_ret IS NOT NULL)"


@query(f"""WITH {PRICES}, {IRET}, s AS (SELECT *, {SECTOR} AS industry FROM r WHERE log_ret IS NOT NULL), day AS (SELECT industry, trading_date, avg(log_ret) AS x FROM s GROUP BY ALL),
c AS (SELECT industry, CASE WHEN count(*) > 10 THEN corr(x, index_ret) END AS c FROM day JOIN ir USING (trading_date) GROUP BY industry), u AS (SELECT industry, count(*) AS stocks, avg(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS up FROM (SELECT industry, symbol, sum(log_ret) AS t FROM s GROUP BY ALL) GROUP BY industry)
SELECT industry, round(exp(sum(x)) - 1, 6) AS total_return, round(avg(x) * 252, 6) AS ann_return, round(stddev_samp(x) * sqrt(252), 6) AS ann_vol, round((avg(x) * 252 - 0.045) / (stddev_samp(x) * sqrt(252)), 6) AS sharpe, round(any_value(c), 6) AS corr_index, any_value(stocks) AS stocks, round(any_value(up), 6) AS stocks_up FROM day JOIN c USING (industry) JOIN u USING (industry) GROUP BY industry""")
def sector_index(spark, sf):
    p = _prices(spark, sf)
    return rounded(cs.sector_index(ts.log_return(p), tables.sectors(p), tables.index_prices(spark, sf)))


@query(f"""WITH {PANEL}, {IRET}, s AS (SELECT *, {SECTOR} AS industry FROM p JOIN ir USING (trading_date) WHERE log_ret IS NOT NULL), day AS (SELECT industry, trading_date, index_ret, avg(log_ret) AS x, count(*) AS m FROM s GROUP BY ALL),
c AS (SELECT industry, avg(c) AS c FROM (SELECT a.industry, a.symbol, b.symbol, corr(a.log_ret, b.log_ret) AS c FROM s a JOIN s b ON a.industry = b.industry AND a.trading_date = b.trading_date AND a.symbol < b.symbol GROUP BY ALL) GROUP BY industry)
SELECT industry, count(*) AS sessions, max(m) AS members, round(exp(sum(x)) - 1, 6) AS total_return, round(CASE WHEN count(*) > 30 THEN regr_slope(x, index_ret) END, 6) AS beta, round(var_samp(x) * 25200, 6) AS variance_pct, round(any_value(c), 6) + 0.0 AS avg_corr, CASE WHEN any_value(c) > 0.6 THEN 'HIGH co-movement' WHEN any_value(c) > 0.3 THEN 'MODERATE' ELSE 'LOW' END AS label FROM day JOIN c USING (industry) GROUP BY industry""")
def sector_analysis(spark, sf):
    return rounded(cs.sector_analysis(_panel(spark, sf), tables.sectors(_prices(spark, sf)), tables.index_prices(spark, sf)))


@query(f"""WITH {PANEL}, s AS (SELECT *, {SECTOR} AS industry FROM p WHERE log_ret IS NOT NULL), m AS (SELECT *, avg(log_ret) OVER (PARTITION BY industry, trading_date) AS mean FROM s), a AS (SELECT industry, symbol, avg(log_ret) * 252 AS m, stddev_samp(log_ret) * sqrt(252) AS v, covar_samp(log_ret, mean) AS c FROM m GROUP BY ALL)
SELECT industry, symbol, round(m, 6) AS ann_return, round(v, 6) AS ann_vol, round(c / sum(c) OVER (PARTITION BY industry) * 100, 6) + 0.0 AS risk_pct FROM a""")
def sector_stock_details(spark, sf):
    return rounded(cs.sector_stock_details(_panel(spark, sf), tables.sectors(_prices(spark, sf))))


@query(f"WITH {PRICES}, e AS (SELECT symbol, sum(log_ret) AS s FROM r WHERE log_ret IS NOT NULL GROUP BY symbol) SELECT round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS advancing, round(avg(s), 6) + 0.0 AS mean_return, count(*) AS symbols FROM e")
def market_breadth(spark, sf):
    return rounded(cs.breadth(ts.log_return(_prices(spark, sf))))


@query(f"WITH {PRICES} SELECT {SECTOR} AS industry, count(DISTINCT symbol) AS members, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM prices GROUP BY 1")
def sector_members(spark, sf):
    return cs.sector_members(tables.sectors(_prices(spark, sf)))


@query(f"WITH {PRICES}, s AS (SELECT DISTINCT symbol, {SECTOR} AS industry FROM prices) SELECT a.symbol, b.symbol AS peer, industry FROM s a JOIN s b USING (industry) WHERE a.symbol <> b.symbol")
def sector_peers(spark, sf):
    return cs.sector_peers(tables.sectors(_prices(spark, sf)))


@query(f"""WITH {PANEL}, {IRET}, a AS (SELECT symbol, {SECTOR} AS industry, avg(log_ret) * 252 AS m, stddev_samp(log_ret) * sqrt(252) AS v, CASE WHEN count(*) > 30 THEN regr_slope(log_ret, index_ret) END AS beta, corr(log_ret, index_ret) AS c FROM p JOIN ir USING (trading_date) WHERE log_ret IS NOT NULL GROUP BY symbol)
SELECT symbol, industry, round(m, 6) AS ann_return, round(v, 6) AS ann_vol, round((m - 0.045) / v, 6) AS sharpe, round(beta, 6) AS beta, round(c, 6) AS corr_index, CAST(row_number() OVER (PARTITION BY industry ORDER BY (m - 0.045) / v DESC, symbol) AS INT) AS rank FROM a""")
def peer_comparison(spark, sf):
    return rounded(cs.peer_comparison(_panel(spark, sf), tables.sectors(_prices(spark, sf)), tables.index_prices(spark, sf)))


@query(f"WITH {PANEL}, s AS (SELECT *, {SECTOR} AS industry FROM p WHERE log_ret IS NOT NULL) SELECT a.symbol, b.symbol AS peer, CASE WHEN a.symbol = b.symbol THEN 1 ELSE round(corr(a.log_ret, b.log_ret), 6) + 0.0 END AS corr FROM s a JOIN s b USING (industry, trading_date) GROUP BY a.symbol, b.symbol")
def peer_correlations(spark, sf):
    return rounded(cs.peer_correlations(_panel(spark, sf), tables.sectors(_prices(spark, sf))))


@query(f"""WITH {PANEL}, c AS (SELECT symbol, quantile_cont(log_ret, 0.1) AS cut FROM p WHERE log_ret IS NOT NULL GROUP BY symbol), x AS (SELECT pr.*, ra <= ca.cut AS la, rb <= cb.cut AS lb FROM pr JOIN c ca ON ca.symbol = a JOIN c cb ON cb.symbol = b),
g AS (SELECT a, b, avg(CASE WHEN la AND lb THEN 1 ELSE 0 END) AS joint, corr(ra, rb) AS corr, corr(ra, rb) FILTER (la OR lb) AS stress_corr, count(*) FILTER (la OR lb) AS stress_days FROM x GROUP BY a, b)
SELECT a, b, round(joint, 6) AS joint, round(corr, 6) + 0.0 AS corr, round(stress_corr, 6) + 0.0 AS stress_corr, stress_days, stress_days > 10 AND stress_corr > corr + 0.1 AS warning FROM g""")
def tail_dependence(spark, sf):
    return rounded(cs.tail_dependence(_panel(spark, sf)))


@query(f"""WITH {PANEL}, i AS (SELECT symbol, log_ret, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) AS i FROM p WHERE log_ret IS NOT NULL),
c AS (SELECT a.symbol AS a, b.symbol AS b, lag, corr(a.log_ret, b.log_ret) AS corr FROM i a CROSS JOIN (SELECT unnest(range(-5, 6)) AS lag) JOIN i b ON b.i = a.i + lag WHERE a.symbol < b.symbol GROUP BY ALL)
SELECT a, b, CAST(lag AS INT) AS lag, round(corr, 6) + 0.0 AS corr, CASE WHEN lag > 0 THEN a WHEN lag < 0 THEN b ELSE 'simultaneous' END AS leader FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(round(corr, 12)) DESC, lag) = 1""")
def lead_lag(spark, sf):
    return rounded(cs.lead_lag(_panel(spark, sf)))


@query(f"WITH {COV}, x AS (SELECT a AS symbol, sum(cov) / 64 AS part FROM cov GROUP BY a) SELECT symbol, round(part / sum(part) OVER (), 6) AS contribution, 0.125::DOUBLE AS weight FROM x")
def risk_contribution(spark, sf):
    p = _panel(spark, sf)
    return rounded(cs.risk_contribution(p, cs.equal_weights(p)))


@query(f"WITH {COV}, s AS (SELECT (SELECT sum(mu) / 8 FROM mu) AS m, (SELECT sqrt(sum(cov) / 64) FROM cov) AS v) SELECT round(m, 6) AS ann_return, round(v, 6) AS ann_vol, round((m - 0.045) / v, 6) AS sharpe, round(m - 1.645 * v, 6) AS var_95 FROM s")
def portfolio_risk(spark, sf):
    p = _panel(spark, sf)
    return rounded(cs.portfolio_stats(p, cs.equal_weights(p)))


SEARCH = f"""{COV}, sy AS (SELECT DISTINCT symbol FROM p),
e AS (SELECT printf('r%06d', i) AS candidate, symbol, -ln((CAST('0x' || substr(md5('42:' || i || ':' || symbol), 1, 10) AS BIGINT) + 1) / {float(16**10 + 1)!r}::DOUBLE) AS e FROM sy CROSS JOIN (SELECT unnest(range(1, 2001)) AS i)),
ca AS (SELECT candidate, symbol, e / sum(e) OVER (PARTITION BY candidate) AS w FROM e UNION ALL SELECT 'one ' || symbol, symbol, 1 FROM sy UNION ALL SELECT 'equal', symbol, 1.0::DOUBLE / (SELECT count(*) FROM sy) FROM sy),
re AS (SELECT candidate, sum(mu * w) AS m FROM ca JOIN mu USING (symbol) GROUP BY candidate), vo AS (SELECT x.candidate, sqrt(sum(x.w * y.w * cov)) AS v FROM ca x JOIN ca y USING (candidate) JOIN cov ON cov.a = x.symbol AND cov.b = y.symbol GROUP BY x.candidate),
s AS (SELECT candidate, m, v, (m - 0.045) / v AS sh FROM re JOIN vo USING (candidate))"""


@query(f"""WITH {SEARCH}
SELECT goal, candidate, round(m, 6) AS ann_return, round(v, 6) AS ann_vol, round(sh, 6) AS sharpe FROM ((SELECT 'min_variance' AS goal, * FROM s ORDER BY round(v, 10), candidate LIMIT 1) UNION ALL (SELECT 'max_sharpe' AS goal, * FROM s ORDER BY round(sh, 10) DESC, candidate LIMIT 1))""")
def portfolio_weight_search(spark, sf):
    """Portfolios over all symbols."""
    return rounded(cs.portfolio_search(cs.portfolio_points(_panel(spark, sf))))


@query(f"""WITH {SEARCH}, t AS (SELECT step, lo + (hi - lo) * step / 9 AS target FROM (SELECT min(m) AS lo, max(m) AS hi FROM s) CROSS JOIN (SELECT unnest(range(10)) AS step))
SELECT CAST(step AS INT) AS step, round(target, 6) AS target, round(min(v), 6) AS ann_vol FROM s JOIN t ON round(m, 12) >= round(target, 12) GROUP BY step, target""")
def efficient_frontier(spark, sf):
    return rounded(cs.efficient_frontier(cs.portfolio_points(_panel(spark, sf))))


@query()
def granger_causality(spark, sf):
    return rounded(cs.granger(_panel(spark, sf)))


@query(f"""WITH {PRICES}, t AS (SELECT (SELECT arg_max(index_close, trading_date) / arg_min(index_close, trading_date) - 1 FROM idx) AS market_return), day AS (SELECT {SECTOR} AS industry, trading_date, avg(log_ret) AS x FROM r WHERE log_ret IS NOT NULL GROUP BY ALL), s AS (SELECT industry, exp(sum(x)) - 1 AS total FROM day GROUP BY industry)
SELECT round(market_return, 6) AS market_return, (SELECT arg_max(industry, total) FROM s) AS top_sector, (SELECT arg_min(industry, total) FROM s) AS bottom_sector, (SELECT round(avg(up), 6) FROM (SELECT industry, avg(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS up FROM (SELECT {SECTOR} AS industry, symbol, sum(log_ret) AS t FROM r WHERE log_ret IS NOT NULL GROUP BY ALL) GROUP BY industry)) AS breadth FROM t""")
def market_overview(spark, sf):
    p = _prices(spark, sf)
    s = cs.sector_index(ts.log_return(p), tables.sectors(p), tables.index_prices(spark, sf)).agg(F.max_by("industry", "total_return").alias("top_sector"), F.min_by("industry", "total_return").alias("bottom_sector"), F.avg("stocks_up").alias("breadth"))
    m = tables.index_prices(spark, sf).agg((F.max_by("close", "trading_date") / F.min_by("close", "trading_date") - 1).alias("market_return"))
    return rounded(m.join(F.broadcast(s)))


@query()
def contagion_report(spark, sf):
    """Significant causal links, pairs with a leader, and pairs that warn of crashing together."""
    p = _panel(spark, sf)
    return cs.contagion_summary(cs.granger(p), cs.lead_lag(p), cs.tail_dependence(p))

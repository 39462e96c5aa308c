"""Sums of all pairs by blocks against numpy, with gaps, lags, groups and constant series."""

import numpy as np
import pytest

from tidemark.operators import crosssection, gram


def table(spark, rng, groups, symbols, times):
    rows = []
    for g in range(groups):
        for s in range(symbols):
            x = np.zeros(times) if s == 1 else rng.normal(0.001, 0.01, times)
            rows += [(g, f"S{s:02d}", int(t) - 50, float(v) if rng.random() < 0.9 else None) for t, v in enumerate(x) if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows, "g int, symbol string, at long, x double")


@pytest.mark.parametrize("lags", [0, 3])
def test_gram(spark, lags):
    rows, values = table(spark, np.random.default_rng(1), 2, 11, 130)
    got = {(r.g, r.a, r.b, r.lag): r for r in gram.gram(values, lags, block=4, times=32).select("*", gram.corr().alias("corr"), gram.covar_samp().alias("cov")).collect()}
    series = {}
    for g, s, t, x in rows:
        if x is not None:
            series.setdefault((g, s), {})[t] = x
    want = 0
    for (g, a), x in series.items():
        for (h, b), y in series.items():
            if g != h or a >= b:
                continue
            for lag in range(-lags, lags + 1):
                at = [t for t in x if t + lag in y]
                if not at:
                    continue
                want += 1
                r, u, v = got[g, a, b, lag], np.array([x[t] for t in at]), np.array([y[t + lag] for t in at])
                assert r.n == len(at)
                np.testing.assert_allclose([r.sx, r.sy, r.sxx, r.syy, r.sxy], [u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()], atol=1e-12)
                if len(at) > 1 and u.std() > 0 and v.std() > 0:
                    np.testing.assert_allclose([r["corr"], r.cov], [np.corrcoef(u, v)[0, 1], np.cov(u, v)[0, 1]], rtol=1e-8, atol=1e-12)
                else:
                    assert r["corr"] is None
    assert want == len(got) > 0


def test_nothing(spark):
    assert gram.gram(spark.createDataFrame([], "g int, symbol string, at long, x double")).count() == 0


def test_no_row_for_a_pair_and_date(spark):
    """What is joined and grouped by pairs are panels and blocks."""
    rows = [(f"S{s}", f"2024-01-{1 + t:02d}", float((s * 7 + t * t) % 11)) for s in range(9) for t in range(28)]
    returns = spark.createDataFrame(rows, "symbol string, trading_date string, log_ret double").selectExpr("symbol", "cast(trading_date as date) AS trading_date", "log_ret")
    for df in (crosssection.correlation_matrix(returns), crosssection.lead_lag(returns)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert joins and not any("at#" in line or "trading_date" in line for line in joins)

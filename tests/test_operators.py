"""Operators on hand-made rows with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import asof, statements, strategy, text, timeseries, upsert, vectors


def one(spark, expr, **values):
    kinds = {str: "string", float: "double", int: "long", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("rate,percent", [("5", 5.0), ("100:5", 5.0), ("20:7", 35.0), ("", 0.0), ("0:5", 0.0), ("1,000", 1000.0)])
def test_rate_to_percent(spark, rate, percent):
    assert one(spark, sc.rate_to_percent(F.col("a")), a=rate) == pytest.approx(percent)


@pytest.mark.parametrize("raw,date", [("/Date(1775494800000)/", dt.date(2026, 4, 6)), ("1775494800000", dt.date(2026, 4, 6)), ("05/04/2026", dt.date(2026, 4, 5)), ("2025-01-10", dt.date(2025, 1, 10)), ("2024-12-20T10:30:00", dt.date(2024, 12, 20)), ("NaT", None), ("not-a-date", None)])
def test_parse_mixed_date(spark, raw, date):
    assert one(spark, sc.parse_mixed_date(F.col("a")), a=raw) == date


def test_labels_and_hosts(spark):
    assert one(spark, sc.normalize_label(F.col("a")), a="Tổng tài sản & Nợ") == "tong tai san and no"
    assert one(spark, sc.source_host(F.col("a")), a="https://x.example.com/a?b") == "x.example.com"
    assert one(spark, sc.source_host(F.col("a")), a="relative/path") is None
    assert one(spark, sc.news_id_from_url(F.col("a")), a="http://h/a-post12345.html") == 12345
    assert one(spark, sc.strip_html(F.col("a")), a="<p>a <b>b</b></p>\n c") == "a b c"
    assert one(spark, sc.derived_text(F.col("a"), F.col("b")), a="", b="") == ""


def test_periods(spark):
    y, q = sc.period_parts(F.col("a"))
    assert one(spark, F.struct(y, q, sc.quarter_end(y, q)), a="2024") == (2024, 4, dt.date(2024, 12, 31))
    assert one(spark, sc.clean_decimal(F.col("a")), a=float("nan")) == 0.0
    assert one(spark, sc.clean_decimal_nullable(F.col("a")), a=float("inf")) is None


def test_model_scores(spark):
    got = one(spark, sc.model_scores(F.col("a")), a='```json\n{"scores":[{"id":"7","score":3},{"id":8,"score":-0.5}]}\n```')
    assert got == {"7": 1.0, "8": -0.5}


def _series(spark, closes):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trading_date date, close double")


def test_position_state(spark):
    df = _series(spark, [1.0] * 6).withColumn("strategy", F.lit("S")).withColumn("signal", F.element_at(F.array(*map(F.lit, [0, 1, 0, -1, 0, 1])), F.dayofmonth("trading_date")))
    assert [r.position for r in strategy.position_state(df).orderBy("trading_date").collect()] == [0, 1, 1, 0, 0, 1]


def test_drawdown(spark):
    got = timeseries.drawdown(_series(spark, [10.0, 12.0, 9.0, 11.0])).orderBy("trading_date").collect()
    assert got[2].drawdown == pytest.approx(-0.25)


def test_recurrences_on_a_line(spark):
    df = _series(spark, [100.5 + 0.5 * i for i in range(60)]).withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "open": F.col("close"), "volume": F.lit(1.0)})
    last = timeseries.recurrences(df).orderBy(F.desc("trading_date")).first()
    assert last.rsi_14 == 100.0 and last.atr_14 == pytest.approx(2.0) and last.ema_12 > last.ema_26


def test_indicators_share_one_shuffle(spark):
    df = timeseries.log_return(timeseries.mfi(timeseries.bollinger(_series(spark, [1.0, 2.0]).withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)}))))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 3, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20)], "k string, t int, w int")
    got = {(r.k, r.t): r.w for r in asof.asof_join(left, right, "k", "t", ["w"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 20, ("b", 3): None}


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, v double")
    b = spark.createDataFrame([(2, "c", 3.0), (2, "d", 4.0), (3, "e", 5.0), (None, "m", 9.0)], "k int, s string, v double")
    assert {(r.k, r.s) for r in upsert.upsert(t, b, ["k"], ["v"]).collect()} == {(1, "a"), (2, "d"), (3, "e"), (None, "m")}
    assert {(r.k, r.s, r.v) for r in upsert.upsert_partial(t, b, ["k"], ["v"], ["v"]).collect()} == {(1, "a", 1.0), (2, "b", 4.0), (3, "e", 5.0), (None, "n", 9.0)}
    with pytest.raises(ValueError):
        upsert.chunked(t, 0, ["k"])


def test_statements(spark):
    df = spark.createDataFrame([(1, None, 125.0, 12.5, 13.0)], "id int, `Selling Expense` double, `Selling Expenses` double, `P/E` double, `P/E ` double")
    got = statements.coalesce_aliases(df, {"selling": ["Selling Expense", "Selling Expenses"], "pe": ["P/E"], "none": ["x"]}, ["id"]).first()
    assert (got.selling, got.pe, got.none) == (125.0, 12.5, None)
    b = spark.createDataFrame([(600000.0, None, None, 200000.0, 200000.0)], "total_assets double, total_liabilities double, total_equity double, short_term_liabilities double, long_term_liabilities double")
    got = statements.balance_identities(b.withColumns({c: F.lit(None).cast("double") for c in ("short_term_assets", "long_term_assets", "cash_and_equivalents")})).first()
    assert (got.total_liabilities, got.total_equity, got.short_term_assets) == (400000.0, None, None)
    items = spark.createDataFrame([(1, "Total Assets", 5.0), (1, "Assets", 4.0)], "k int, item string, value double")
    alias = spark.createDataFrame([("assets", "total assets", 0), ("assets", "assets", 1)], "metric string, alias string, priority int")
    assert statements.pick_metrics(items, ["k"], alias).first().assets == 5.0


def test_text_scores(spark):
    d = spark.createDataFrame([(1, "Renewable energy is renewable"), (2, "")], "id int, text string")
    got = {r.id: r.n for r in d.select("id", text.matches(F.col("text"), ["renewable energy", "renewable"]).alias("n")).collect()}
    assert got == {1: 2, 2: 0}
    assert text.topic_classify(d, "id", {"A": ["renewable"], "B": ["energy"]}).where("id = 2").first().topic == "Unknown"
    chunks = text.split_chunks(spark.createDataFrame([(1, "word " * 400)], "id int, text string"), "id").collect()
    assert len(chunks) >= 4 and all(len(c.chunk) <= 512 for c in chunks)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, q array<double>")
    assert [r.id for r in vectors.nearest(q, v, 2).orderBy("rank").collect()] == [1, 3]
    pooled = vectors.mean_pool(spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0])], "k string, v array<double>"), "k", "v").first().v
    assert pooled == pytest.approx([0.5**0.5] * 2)
